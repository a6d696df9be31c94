import os

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import agent, backtest, evidence, mining, report
from lacuna.operators.discovery import DiscoveryConfig, stages, stats
from lacuna.operators.filters import LevelFilter, RelevanceFilter
from lacuna.sources import corpus as C
from lacuna.sources.papers import parse_papers, result_count
from lacuna.streaming.edges import append_counts, totals

GRAPH = os.path.join(os.path.dirname(__file__), "fixtures", "graph.json")


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_backtest_precision(spark):
    concepts = spark.createDataFrame([("A", "Disease A", 2, 1000), ("B", "Marker B", 3, 2000), ("C1", "Drug Hit", 3, 1500), ("C2", "Drug Miss", 3, 1500)], "cid string, name string, level int, works_count long")
    edges = spark.createDataFrame([("A", "B", 100), ("B", "C1", 80), ("B", "C2", 70)], "src string, dst string, cooc long")
    hits = "src string, dst string, hits long"
    links = backtest.backtest_links(C.Corpus(concepts, edges, 250_000_000), spark.createDataFrame([("A",)], "a string"), spark.createDataFrame([], hits), spark.createDataFrame([("A", "C1", 12)], hits), DiscoveryConfig(filters=LevelFilter()))
    row = backtest.backtest_summary(links).first()
    assert (row.n_novel_in_pool, row.n_hits, row.precision_at_k) == (2, 1, 0.5)
    assert backtest.backtest_summary(links.where("false")).count() == 0


def test_agent_reports(spark):
    g = C.fixture(spark, GRAPH)
    hyps = agent.run_discover(g, spark.createDataFrame([("C_raynaud",)], "a string"), DiscoveryConfig(max_results=2), verify=True)
    bundle = report.report("Raynaud disease", hyps, True)
    assert [h["c_name"] for h in bundle["hypotheses"]] == ["Fish oil", "Eicosapentaenoic acid"] and bundle["stats"]["bridges"] == 5
    assert [t["step"] for t in bundle["trace"]] == ["resolve", "bridges", "candidates", "rank", "hypothesize", "verify", "done"]
    assert "Fish oil" in report.as_text(bundle) and '"verdict": "open"' in report.to_json(bundle)
    ex = agent.run_explain(g, spark.createDataFrame([("C_raynaud", "C_fishoil")], "a string, c string")).first()
    assert ex.bridges == ["Platelet aggregation", "Blood viscosity", "Vasospasm"] and round(ex.score, 6) == 0.467981


def test_edges_directions_self_and_stream(spark, tmp_path):
    wc = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, None), (None, "a")], "work long, cid string")
    got = {(r.src, r.dst): r.cooc for r in C.cooccurrence_edges(wc).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    assert {(r.src, r.dst): r.cooc for r in C.cooccurrence_edges(wc, include_self=True).collect()}[("a", "a")] == 2
    write = append_counts(str(tmp_path / "edges"))
    write(wc.where("work = 1"), 0)
    write(wc.where("work = 2"), 1)
    write(wc.where("work = 2"), 1)  # run again
    assert {(r.src, r.dst): r.cooc for r in totals(spark, str(tmp_path / "edges")).collect()} == got


def test_listing_parser(spark):
    text = "Found 1,204 papers\n  1. Lanosterol reverses cataract\n     \u001b[1mZhao L\u001b[0m\n     abc · pmc · 2015-07\n     doi:10.1/x\n     \"An abstract\"\n  2. Second\n     https://e.org/2\n"
    rows = parse_papers(spark.createDataFrame([(text,)], "output string")).orderBy("place").collect()
    assert [(r.title, r.url, r.abstract, r.id, r.source, r.date, r.authors) for r in rows] == [("Lanosterol reverses cataract", "https://doi.org/10.1/x", "An abstract", "abc", "pmc", "2015-07", "Zhao L"), ("Second", "https://e.org/2", None, None, None, None, None)]
    assert one(spark, result_count(F.lit(text), F.lit(2))) == 1204 and one(spark, result_count(F.lit("nothing"), F.lit(2))) == 2


def test_mining_and_comparison(spark):
    papers = spark.createDataFrame([("cataract", 1, "A new drug (lanosterol) in cataract"), ("cataract", 2, "Lens cataract and Fish Oil Therapy and New Drugs"), ("cataract", 1, "A new drug (lanosterol) in cataract"), ("cataract", 3, "(metformin) in other eyes"), ("cataract", 4, None)], "topic string, paper long, title string")
    rows = mining.mined(papers).orderBy("rank").collect()
    assert (rows[0].target, rows[0].paper_count, rows[0].distinct_papers) == ("lanosterol", 2, 1)
    summary = spark.createDataFrame([("p", True, False, 1), ("p", False, True, 3)], "pipeline string, nonsense boolean, actionable boolean, citations long")
    row = mining.compare_summary(summary).first()
    assert (row["count"], row.nonsense_rate, row.actionable_rate, row.avg_citations) == (2, 0.5, 0.5, 2.0)
    assert mining.proposals_as_links(mining.mined(papers)).first().c_level == 3


def test_text_functions(spark):
    assert one(spark, T.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, T.rebuilt_abstract(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    assert one(spark, T.year_from(F.lit("in 2015-07"))) == 2015 and one(spark, T.year_from(F.lit("n/a"))) is None
    assert one(spark, T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0)))) == 1.0
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0
    assert one(spark, T.char_ngrams(F.lit("Ab"))) == ["ab"] and one(spark, T.char_ngrams(F.lit(None).cast("string"))) == []


def test_semantic_filter(spark):
    e = spark.createDataFrame([("disease", [1.0, 0.0]), ("Illness", [0.99, 0.1]), ("Fish oil", [0.0, 1.0]), ("Omega oil", [0.05, 1.0]), ("Raynaud", [0.0, 0.9])], "name string, vec array<double>")
    flt = RelevanceFilter(embeddings=e)
    concepts = spark.createDataFrame([(i, n, 3, 10) for i, n in enumerate(("Illness", "Fish oil", "Other"))], "cid int, name string, level int, works_count long")
    f = {r.name: r.generic for r in flt.features(concepts).collect()}
    assert f == {"Illness": True, "Fish oil": False, "Other": False}


def test_resolution(spark):
    concepts = spark.createDataFrame([("m", "Medicine", 0, 86_000_000), ("c", "Cataract", 2, 50_000)], "cid string, name string, level int, works_count long")
    t = spark.createDataFrame([("cataract early stages",)], "topic string")
    assert C.resolve_by_tokens(t, concepts).first().cid == "c"
    works = spark.createDataFrame([(i, "Cataract early stages", "", 2000, 1) for i in range(3)], "work long, title string, text string, year int, cited long")
    wc = spark.createDataFrame([(0, "m"), (1, "m"), (2, "m"), (0, "c")], "work long, cid string")
    assert C.resolve_from_works(t, works, wc, concepts).first().cid == "c"


def test_env_and_models():
    env = agent.load_env("# x\nexport A='1'\nB=\"2\"\nbad\nC=3", {"C": "0"})
    assert env == {"A": "1", "B": "2", "C": "0"} and agent.load_env("C=3", {"C": "0"}, override=True) == {"C": "3"}
    assert agent.detect_model({"GROQ_API_KEY": "x", "ANTHROPIC_API_KEY": "y"}) == "anthropic" and agent.detect_model({}) is None


@pytest.mark.parametrize("name", ["open_discovery", "closed_discovery", "type_filter", "usable_pairs", "phrase_mining", "run_stats", "compare", "discover_run"])
def test_queries_match_their_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(str, ({c: v for c, v in sorted(zip(columns, r))} for r in cur.fetchall())))
    got = sorted(str({c: v for c, v in sorted(r.asDict().items())}) for r in entry.queries()[name](spark, d).collect())
    assert got == want and got


def test_runs_cite_verify_and_count_topics_without_links(spark):
    g = C.fixture(spark, GRAPH)
    wc = spark.createDataFrame([(1, "C_raynaud"), (1, "C_platelet"), (2, "C_platelet"), (2, "C_fishoil")], "work long, cid string")
    works = spark.createDataFrame([(1, "one", 2001, 5), (2, "two", 2002, 9)], "work long, title string, year int, cited long")
    full = g.__class__(g.concepts, g.edges, g.size, wc, works, g.comentions)
    ids = [r.cid for r in g.concepts.where("name = 'Vasospasm'").collect()]
    full = full.__class__(full.concepts, full.edges, full.size, wc.replace("C_platelet", ids[0]), works, full.comentions)
    topics = spark.createDataFrame([("C_raynaud",), ("C_nowhere",)], "a string")
    row = agent.run_discover(full, topics, verify=True).where("c_name = 'Fish oil'").first()
    assert row.n_citations == 2 and [w.title for w in row.works_cited] == ["one", "two"] and row.verdict == "open"
    ex = agent.run_explain(full, spark.createDataFrame([("C_raynaud", "C_fishoil")], "a string, c string"), verify=True).first()
    assert ex.verdict == "open" and ex.n_citations == 0  # no work is known for its two strongest bridges
    found = {r.a: tuple(r[1:]) for r in stats(topics, stages(g, topics, DiscoveryConfig(max_lift=-1.0))).collect()}
    assert found == {"C_raynaud": (5, 4, 4, 0), "C_nowhere": (0, 0, 0, 0)}
    mine = lambda hyps: hyps.withColumn("statement", F.lit("mine"))
    own = agent.run_discover(g, topics, reasoner=lambda links: mine(evidence.hypotheses(links)), provider=lambda pairs: pairs.select("a", "c", F.lit(40).alias("hits")), verify=True)
    assert {(r.statement, r.verdict) for r in own.collect()} == {("mine", "established")}


def test_a_kept_corpus_gives_the_same_and_gives_back_what_it_wrote(spark):
    g = C.fixture(spark, GRAPH)
    topics = spark.createDataFrame([("C_raynaud",), ("C_migraine",)], "a string")
    with g.kept(200) as kept:
        assert sorted(map(str, agent.run_discover(kept, topics).collect())) == sorted(map(str, agent.run_discover(g, topics).collect()))
        paths = [p for _, p in kept.held]
        assert len(paths) > 5 and all(os.path.isdir(p) for p in paths)
    assert not any(os.path.isdir(p) for p in paths)


def test_evidence_providers(spark):
    pairs = spark.createDataFrame([("a", "c", "Fish oil", "Raynaud"), ("a", "d", "Fish oil", "Lens")], "a string, c string, a_name string, c_name string")
    works = spark.createDataFrame([(1, "Fish oil and Raynaud", "x", 2001, 5), (2, "raynaud", "about fish-oil", 2002, 9)], "work long, title string, text string, year int, cited long")
    got = {r.c: (r.hits, [i.work for i in r["items"] or []]) for r in evidence.from_texts(works)(pairs).collect()}
    assert got == {"c": (2, [2, 1]), "d": (0, [])}
    results = spark.createDataFrame([("a", "c", i, f"title {i}", ["fish OIL", "raynaud"] if i % 2 else None, None) for i in range(6)], "a string, c string, place int, title string, excerpts array<string>, url string")
    row = evidence.from_search(results)(pairs).first()
    assert row.hits == 3 and [i.place for i in row["items"]] == [0, 1, 2, 3]
    assert evidence.choose_provider({"counts": 1, "search": 2}) == ("search", 2) and evidence.choose_provider({"counts": 1}, "texts") == ("counts", 1)
    assert evidence.choose_provider({"counts": 1, "search": 2}, "counts") == ("counts", 1) and evidence.choose_provider({}) is None


def test_compare_has_rows_for_topics_without_results(spark):
    g = C.fixture(spark, GRAPH)
    topics = spark.createDataFrame([("Raynaud disease", "C_raynaud"), ("unknown", None)], "topic string, a string")
    rows = {(r.topic, r.pipeline, r.target) for r in mining.run_compare(g, topics, max_rows=2).collect()}
    assert ("unknown", "graph", "(none)") in rows and ("unknown", "titles", "(skipped)") in rows and ("Raynaud disease", "graph", "Fish oil") in rows
    papers = spark.createDataFrame([("Raynaud disease", 1, "Raynaud and a drug (nifedipine)")], "topic string, paper long, title string")
    rows = {(r.topic, r.pipeline, r.target): r for r in mining.run_compare(g, topics, mining.searches(papers, papers), max_rows=2).collect()}
    assert rows["Raynaud disease", "titles", "nifedipine"].score == 2.0 and ("unknown", "titles", "(none)") in rows


def test_backtest_falls_back_to_the_edges(spark):
    g = C.fixture(spark, GRAPH)
    bare = g.__class__(g.concepts, g.edges, g.size)
    assert backtest.counted_hits(bare).columns == ["src", "dst", "hits"] and backtest.counted_hits(g) is g.comentions
    links = backtest.run_backtest(bare, bare, spark.createDataFrame([("C_raynaud",)], "a string"))
    assert links.where("novel_as_of_split").count() == 4 and backtest.backtest_summary(links).first().n_hits == 0


def test_terms_and_names_are_joined_by_equality(spark):
    works = spark.createDataFrame([(1, "The old mill, by the-sea"), (2, "sea"), (3, None), (4, "")], "work long, _t string")
    terms = spark.createDataFrame([("old MILL",), ("the sea",), ("mill by the sea",), ("se",), ("",)], "term string")
    assert {tuple(r) for r in C.mentioned(works, terms).collect()} == {(1, "old MILL"), (1, "the sea"), (1, "mill by the sea")}
    plan = C.mentioned(works, terms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    names = spark.createDataFrame([("a", "Fish oil", 5), ("b", "ab", 9), ("c", "", 1)], "cid string, name string, works_count long")
    t = spark.createDataFrame([("fish",), ("b",), ("xx fish oil yy",), ("日本",)], "topic string")
    assert {tuple(r) for r in C.resolve(t, names).collect()} == {("fish", "a"), ("b", "b"), ("xx fish oil yy", "a")}


def test_command_line(capsys):
    import json

    from lacuna.__main__ import main

    assert main(["--graph", GRAPH, "--json", "discover", "Raynaud disease", "--verify", "--max", "2", "--no-semantic", "--evidence", "counts", "--bridge-diversity", "0.5"]) == 0
    bundle = json.loads(capsys.readouterr().out)
    assert [h["verdict"] for h in bundle["hypotheses"]] == ["open", "open"]
    assert main(["--graph", GRAPH, "compare", "Raynaud disease"]) == 0 and "(skipped)" in capsys.readouterr().out
    assert main(["--graph", GRAPH, "--future", GRAPH, "backtest", "Raynaud disease", "--year", "2010"]) == 0 and "precision" in capsys.readouterr().out
    assert main(["--graph", GRAPH, "explain", "Raynaud disease", "Fish oil", "--verify"]) == 0
    assert main(["--graph", GRAPH, "discover", "no such thing"]) == 1
