"""Ingest of nested records and the source that can be plugged in."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lacuna.sources import works as W


class PagedClient(W.WorksClient):
    """A client that is no folder: so many pages of made records, and a log of the pages that were read."""

    def pages(self, low, high, concepts):
        years = range(2000, 2010)
        return [(y, sorted(concepts) if concepts else None) for y in years if (low is None or y >= low) and (high is None or y <= high)]

    def records(self, page):
        year, concepts = page
        with open(os.path.join(self.options["log"], f"{year}"), "w") as f:
            f.write(str(concepts))
        for i in range(3):
            yield {"id": f"https://x.org/W{year}{i}/", "display_name": f"w{i}", "publication_year": year, "cited_by_count": i, "concepts": [{"id": "C1", "display_name": "one", "level": 2}, {"id": f"t/C{i}", "display_name": "o", "level": 3}]}


RECORDS = [
    json.dumps({"id": "https://x.org/W1", "display_name": "A \"quoted\"\n title", "publication_year": 1999, "cited_by_count": 3, "doi": "doi:10.1/x", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "concepts": [{"id": "https://x.org/C1/", "display_name": "One", "level": 2, "score": 0.5}, {"id": "C2"}, {"id": " ", "display_name": "no id"}]}),
    json.dumps({"id": "W1", "cited_by_count": 9, "publication_year": 2001, "concepts": [{"id": "C1", "display_name": "Alias", "level": 1}]}),
    json.dumps({"id": "W2", "display_name": " ", "extra": {"deep": [1]}}),
    json.dumps({"id": "W3", "publication_year": None, "concepts": None}),
    json.dumps({"id": "W4", "publication_year": "two thousand"}),
    json.dumps({"display_name": "nobody"}), json.dumps({"id": " / "}), '{"id": "W5", "conc', "[1, 2]", "", "   ", None,
]


def test_ingest_sets_aside_what_is_no_record(spark):
    got = W.ingest(spark.createDataFrame([(r,) for r in RECORDS], "value string"))
    works = {r.work: (r.title, r.text, r.year, r.cited, r.url) for r in got.works.collect()}
    assert set(works) == {"W1", "W2", "W3"} and works["W1"] == ("(untitled)", "", 2001, 9, "W1") and works["W2"][0] == "(untitled)"
    assert {tuple(r) for r in got.work_concepts.collect()} == {("W1", "C1", 1999, 0.5), ("W1", "C1", 2001, 0.0), ("W1", "C2", 1999, 0.0)}
    assert {tuple(r) for r in got.concepts.collect()} == {("C1", "Alias", 2), ("C2", "C2", 0)}
    assert {r.reason: r.n for r in got.rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()} == {"malformed": 3, "no id": 2, "empty": 3}
    one = W.ingest(spark.createDataFrame([(RECORDS[0],)], "value string")).works.first()
    assert (one.title, one.text, one.url) == ('A "quoted"\n title', "a b a", "https://doi.org/10.1/x")
    corpus = got.corpus()
    assert {(r.src, r.dst): r.cooc for r in corpus.edges.collect()} == {("C1", "C2"): 1, ("C2", "C1"): 1} and corpus.size.first()[0] == 1
    none = W.ingest(spark.createDataFrame([], "value string"))
    assert none.works.count() == none.work_concepts.count() == none.rejected.count() == 0


def test_a_window_reads_its_pages_alone(spark, tmp_path):
    W.register(spark)
    read = lambda table: spark.read.format("works").options(client=f"{__name__}:PagedClient", log=str(tmp_path), table=table).load()
    got = read("work_concepts").where("year between 2003 and 2004 and cid = 'C1' and work like '%1'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan works" in plan and "EndsWith" in plan and ">=" not in plan and "<=" not in plan and "= C1" not in plan  # taken over by the source
    assert got.distinct().count() == 2
    assert sorted(os.listdir(tmp_path)) == ["2003", "2004"] and (tmp_path / "2003").read_text() == "['C1']"
    assert read("works").where("year > 2008").count() == 3 and read("works").where("year >= 2009 and year < 2009").count() == 0
    assert read("works").count() == 30 and read("concepts").select("cid").distinct().count() == 3
    corpus = W.corpus_from(spark, year_from=2003, year_to=2004, client=f"{__name__}:PagedClient", log=str(tmp_path))
    assert {(r.src, r.dst): r.cooc for r in corpus.edges.where("src < dst").collect()} == {("C0", "C1"): 2, ("C1", "C2"): 2} and corpus.size.first()[0] == 6


@pytest.mark.parametrize("table, want", [("works", 5), ("rejected", 8)])
def test_a_folder_of_json_lines(spark, tmp_path, table, want):
    W.register(spark)
    for year, rows in (("1999", RECORDS[:1]), ("2001", RECORDS[1:2]), ("__HIVE_DEFAULT_PARTITION__", RECORDS[2:])):
        (tmp_path / f"year={year}").mkdir()
        (tmp_path / f"year={year}" / "part-0.json").write_text("\n".join(r or "" for r in rows) + "\n")
        (tmp_path / f"year={year}" / "_SUCCESS").write_text("not read")
    frame = spark.read.format("works").options(path=str(tmp_path), table=table).load()
    assert frame.count() == want - (table == "works")
    if table == "works":
        window = frame.where("year <= 1999")
        assert window.rdd.getNumPartitions() == 1 and [r.work for r in window.collect()] == ["W1"]
        again = W.fetched(spark, "works", path=str(tmp_path))
        assert again.count() == 4 and again.where("year is null").count() == 2 and W.fetched(spark, "works", F.col("year") > 1999, path=str(tmp_path)).count() == 1
