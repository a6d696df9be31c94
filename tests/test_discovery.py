import os

import pytest
from pyspark.sql import functions as F

from lacuna.functions import novelty as N
from lacuna.operators import evidence
from lacuna.operators.discovery import DiscoveryConfig, discover, explain
from lacuna.operators.filters import RelevanceFilter, make_filter, nonsense_target
from lacuna.operators.typing import resolve_target
from lacuna.sources.corpus import fixture, resolve, text_comentions

GRAPH = os.path.join(os.path.dirname(__file__), "fixtures", "graph.json")


@pytest.fixture(scope="module")
def graph(spark):
    c = fixture(spark, GRAPH)
    return c.__class__(c.concepts.cache(), c.edges.cache(), c.size, comentions=c.comentions.cache())


def topics(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "a string")


EXPECTED = {
    "C_raynaud": [("Fish oil", 3, 0.518302, 0.154209, 0.150739, 0.150354), ("Eicosapentaenoic acid", 2, 0.314454, 0.103170, 0.100849, 0.100591), ("Vascular tone", 1, 0.144481, 0.051747, 0.050583, 0.050453), ("Serotonin", 1, 0.154457, 0.044790, 0.043782, 0.043670)],
    "C_migraine": [("Magnesium", 3, 0.162974, 0.149896, 0.146523, 0.146149), ("Calcium channel", 2, 0.165032, 0.140376, 0.137218, 0.136867)],
}


@pytest.mark.parametrize("mode, column", [("concept_lift", 3), ("hybrid", 4), ("comention", 5)])
def test_open_discovery_matches_the_goldens(spark, graph, mode, column):
    rows = discover(graph, topics(spark, "C_raynaud", "C_migraine"), DiscoveryConfig(novelty_mode=mode)).orderBy("a", "rank").collect()
    for a, want in EXPECTED.items():
        got = [(r.c_name, r.bridge_support, round(r.path_strength, 6), round(r.score, 6)) for r in rows if r.a == a]
        assert got == [(w[0], w[1], w[2], w[column]) for w in want]
        assert all(r.diversity == 1.0 and r.direct == 0 for r in rows if r.a == a)
    first = next(r for r in rows if r.a == "C_raynaud")
    assert first.n_bridges == 5 and first.n_candidates == 4


def test_topics_share_one_plan_and_unknown_ones_have_no_links(spark, graph):
    assert discover(graph, topics(spark, "C_nowhere")).count() == 0
    names = [r.topic for r in resolve(spark.createDataFrame([("Raynaud disease",), ("migra",), ("",), ("zzz",)], "topic string"), graph.concepts).collect()]
    assert sorted(names) == ["Raynaud disease", "migra"]


def test_closed_discovery(spark, graph):
    pairs = spark.createDataFrame([("C_raynaud", "C_fishoil"), ("C_migraine", "C_magnesium"), ("C_raynaud", "C_nowhere")], "a string, c string")
    rows = explain(graph, pairs).orderBy("a", "b_rank").collect()
    got = {a: [(r.b_name, round(r.strength, 6)) for r in rows if r.a == a] for a in ("C_raynaud", "C_migraine")}
    assert got["C_raynaud"] == [("Platelet aggregation", 0.194354), ("Blood viscosity", 0.160287), ("Vasospasm", 0.113340)]
    assert got["C_migraine"] == [("Serotonin", 0.109042), ("Cortical spreading depression", 0.076243), ("Vascular tone", 0.066259)]
    assert round(rows[-1].total, 6) == 0.467981 and round(rows[0].total, 6) == 0.251544


def test_verification_and_critique(spark, graph):
    links = discover(graph, topics(spark, "C_raynaud"))
    counts = graph.comentions.select(F.col("src").alias("a"), F.col("dst").alias("c"), "hits")
    rows = evidence.reranked(evidence.verify(evidence.hypotheses(links), counts)).orderBy("final_rank").collect()
    assert [(r.verdict, r.verified_novelty) for r in rows] == [("open", 0.95)] * 4
    assert [r.plausibility for r in rows] == [0.85, 0.7, 0.44, 0.44]
    assert "Fish oil" in rows[0].statement and "[critique]" in rows[0].rationale


@pytest.mark.parametrize("hits, verdict, novelty", [(-1, "unverified", None), (0, "open", 0.95), (1, "emerging", 0.838), (7, "emerging", 0.768), (10, "emerging", 0.733), (30, "emerging", 0.5), (31, "established", 0.4), (75, "established", 0.4), (76, "established", 0.395), (77, "established", 0.39), (100, "established", 0.3), (4846, "established", 0.006)])
def test_verdict_bands(spark, hits, verdict, novelty):
    row = spark.range(1).select(N.verdict(F.lit(hits)).alias("v"), N.verified_novelty(F.lit(hits)).alias("n")).first()
    assert (row.v, row.n) == (verdict, novelty)


def test_types(spark, graph):
    types = spark.createDataFrame([("Fish oil", ["D"]), ("Eicosapentaenoic acid", ["D"]), ("Serotonin", [])], "name string, letters array<string>")
    cfg = DiscoveryConfig(target_categories=resolve_target("drug"))
    assert {r.c_name for r in discover(graph, topics(spark, "C_raynaud"), cfg, types).collect()} == {"Fish oil", "Eicosapentaenoic acid"}
    assert discover(graph, topics(spark, "C_raynaud"), cfg, types.where("false")).count() == 4
    assert discover(graph, topics(spark, "C_raynaud"), cfg.with_(strict_types=True), types.where("false")).count() == 0
    assert discover(graph, topics(spark, "C_raynaud"), cfg).count() == 4
    assert [resolve_target(t) for t in ("drug", "disease", "any", None, "C", "nonsense")] == [("D",), ("C",), None, None, ("C",), None]


@pytest.mark.parametrize("name, generic", [("gene expression", True), ("in vitro", True), ("machine learning", True), ("disease", True), ("in_vitro", True), ("vitro model", False), ("cellular process", False), ("clinical investigation", False), ("Fish oil", False), ("日本", True), ("", True)])
def test_generic_names(spark, name, generic):
    assert spark.range(1).select(RelevanceFilter().is_generic(F.lit(name))).first()[0] is generic


def test_profiles_and_names(spark):
    flag = lambda f, n: spark.range(1).select(f(F.lit(n))).first()[0]
    assert flag(make_filter("general").is_generic, "machine learning") is False
    assert flag(make_filter("biomed", override_name_stop=("fish oil",)).is_generic, "Fish oil") is True
    assert flag(make_filter("biomed", extra_name_stop=("fish oil",)).is_generic, "disease") is True
    assert flag(RelevanceFilter().bad_parenthetical, "Amyloid (mycology)") and flag(RelevanceFilter().bad_parenthetical, "Scleroderma (fungus)")
    bad = [flag(lambda n: nonsense_target(n, F.lit(level)), name) for name, level in (("Medicine", 0), ("Government (linguistics)", 3), ("Fish oil", 3))]
    assert bad == [True, True, False]


def test_support_gate_and_levels(spark, graph):
    rows = discover(graph, topics(spark, "C_raynaud"), DiscoveryConfig(min_bridge_support=2)).collect()
    assert {r.c_name for r in rows} == {"Fish oil", "Eicosapentaenoic acid"}
    rows = discover(graph, topics(spark, "C_raynaud")).collect()
    assert all(0 < r.novelty <= 1 and r.score > 0 and r.bridge_support >= 1 for r in rows)
    assert not {"Vasospasm", "Medicine", "Dermatology"} & {r.c_name for r in rows}


def test_text_comentions(spark):
    works = spark.createDataFrame([(1, "Fish oil and Raynaud", "x", 2001, 5), (2, "raynaud", "about fish-oil", 2002, 9), (3, "fish", "oil", 2003, 1), (4, None, None, None, None)], "work long, title string, text string, year int, cited long")
    pairs = spark.createDataFrame([(1, "Raynaud", "Fish, oil"), (2, "nothing", "oil"), (3, "", "")], "pair_id long, a_name string, c_name string")
    got = {r.pair_id: (r.hits, [i.work for i in r["items"] or []]) for r in text_comentions(works, pairs).collect()}
    assert got == {1: (2, [2, 1]), 2: (0, []), 3: (0, [])}
