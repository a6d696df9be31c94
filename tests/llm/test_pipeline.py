"""The pipeline's stages against plain versions of them."""

import os

import pytest

import corpus_pipeline as cp
from lacuna.llm import fertility, mixing, pieces, pii
from tests.llm.test_operators import jaccard_groups

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage gives, in order."""
    out, docs = [spark.read.parquet(f"{DATA}/documents.parquet")], None
    for i, (name, f) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return sorted(map(tuple, df.select(*cp.COLUMNS).collect()))


def test_stages(kept):
    raw, good, single, masked, mixed, ids = kept
    want = [x for x in rows(raw) if fertility._judge(x[1] or "", fertility.vocabulary_path(), fertility.BANDS, x[2])[6]]
    assert rows(good) == want
    low = jaccard_groups([x[1] for x in want])
    exact = [x for i, x in enumerate(want) if low[i] == i]  # rows are in order of doc_id
    got = rows(single)
    assert set(exact) <= set(got) and len(got) <= 1.02 * len(exact) and len(got) < len(want)
    for before, after in zip(rows(single), rows(masked)):
        assert before[0] == after[0] and not (after[1] != before[1] and not pii.base_spans(before[1]) and "<" not in after[1])
        assert not any(before[1][s:e] in after[1] for s, k, e in pii.base_spans(before[1]) if k == 0)
    taken = {x.doc_id: x for x in mixing.curriculum_mix(masked).collect()}
    words: dict = {}
    for doc_id, text, *_ in rows(mixed):
        words[doc_id] = words.get(doc_id, 0) + len(text.split())
    assert words == {d: x.taken for d, x in taken.items() if x.taken}
    p = pieces.Pieces.at(pieces.model_path())
    assert sorted(p.decode(x.ids) for x in ids.collect()) == sorted(x[1] for x in rows(mixed))
    want = sorted((x.doc_id, x.position) for x in mixing.training_passes(masked).collect())
    got = sorted((x.doc_id, x.position) for x in ids.collect())  # the training order survives to the end
    sources = {x[3] for x in rows(masked)}  # the last pass of each is cut, and so has another middle
    assert [d for d, _ in got] == [d for d, _ in want] and sum(abs(x - y) > 0.002 for (_, x), (_, y) in zip(got, want)) <= len(sources)


def test_run_gives_the_last_stage(spark, kept):
    from lacuna.llm import common

    mark = common.written()
    cp.run(spark, DATA).count()
    assert common.written() == mark + 1 and os.path.isdir(common._written[-1])  # of all it has written, the input of the last stage is left
    assert sorted((x.doc_id, tuple(x.ids)) for x in cp.run(spark, DATA).collect()) == sorted((x.doc_id, tuple(x.ids)) for x in kept[-1].collect())


def test_edge_cases(spark):
    from tests.llm.test_operators import EDGE, clashing, table

    docs = clashing(table(spark, EDGE))
    for _, f in cp.STAGES[:4]:
        assert f(spark, docs, DATA).columns == list(cp.COLUMNS)
        assert f(spark, docs, DATA).count() <= 3 * len(EDGE) and f(spark, docs.where("false"), DATA).count() == 0
    assert cp.STAGES[4][1](spark, docs, DATA).count() == len(EDGE)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_group_stays(spark):
    from tests.llm.test_operators import DOCS

    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(5, a, "en", "s", 1), (5, a, "en", "s", 1), (7, a + " x", "en", "s", 1), (8, b, "en", "s", 1), (8, b + " y", "en", "s", 1), (None, a, "en", "s", 1), (9, "other words " * 30, "en", "s", 1)]
    got = cp.deduplicate(spark, spark.createDataFrame(rows, DOCS), DATA).collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 5, 8, 9]
