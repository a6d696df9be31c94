"""Joins and counts that don't grow with the square of a hot key, against plain computation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import backtest, similarity
from lacuna.operators.discovery import DiscoveryConfig, with_diversity
from lacuna.operators.filters import LevelFilter
from lacuna.operators.lookups import Memo
from lacuna.sources import corpus as C
from lacuna.streaming.edges import merge_works, merged


def test_a_hot_work_is_dealt_out_in_blocks(spark):
    hot = [(0, f"c{i}") for i in range(300)]
    rows = spark.createDataFrame(hot + [(1, "c1"), (1, "c2"), (2, "c1"), (3, None), (None, "c1")] + hot[:5], "work long, cid string")
    edges = {(r.src, r.dst): r.cooc for r in C.cooccurrence_edges(rows, block=16).collect()}
    assert len(edges) == 300 * 299 and edges[("c1", "c2")] == edges[("c2", "c1")] == 2 and edges[("c3", "c4")] == 1
    wc = rows.where("work is not null and cid is not null").distinct()
    # what a key is given: of a pair of blocks its rows, whatever the work has
    plan = C.concept_pairs(wc, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and plan.count("Join") >= 2
    dated = {(r.src, r.dst, r.year) for r in C.concept_pairs(spark.createDataFrame([(1, "a", 2000), (1, "b", 2003), (1, "c", None)], "work long, cid string, year int"), 1).collect()}
    assert ("a", "b", 2003) in dated and len(dated) == 3


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_lose_and_double_no_pair(spark, block):
    rng = random.Random(block)
    rows = {(w, f"c{rng.randrange(40)}") for w in range(12) for _ in range(rng.choice([1, 5, 60]))}
    got = C.concept_pairs(spark.createDataFrame(list(rows), "work long, cid string"), block).groupBy("src", "dst").count().collect()
    want = {}
    for w in range(12):
        for a, b in itertools.combinations(sorted({c for x, c in rows if x == w}), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    assert {(r.src, r.dst): r["count"] for r in got} == want


def test_division_is_led_by_the_rarest_member(spark):
    rng = random.Random(2)
    rows = [(w, c) for w in range(200) for c in "abcdef" if rng.random() < {"a": 1, "b": 0.9, "c": 0.5, "d": 0.1, "e": 0.02, "f": 0}[c]]
    wc = spark.createDataFrame(rows + rows[:50], "work long, cid string")
    have = {}
    for w, c in rows:
        have.setdefault(w, set()).add(c)
    sets = [("".join(s), list(s)) for n in (1, 2, 3, 4) for s in itertools.combinations("abcdef", n)] + [("aa", ["a", "a"]), ("", []), ("zz", ["a", "z"])]
    works = spark.createDataFrame([(w, None if w % 3 else f"t{w}", w % 7) for w in range(200)], "work long, title string, cited int")
    got = {}
    for r in C.works_with_all(wc, spark.createDataFrame(sets, "set_id string, cids array<string>"), works, 3).orderBy("set_id", "w_rank").collect():
        got.setdefault(r.set_id, []).append(r.work)
    for name, members in sets:
        able = sorted((w for w in have if members and set(members) <= have[w]), key=lambda w: (-(w % 7), w))
        assert got.get(name, []) == able[:3], name


def test_terms_are_found_alike_by_automaton_and_by_runs(spark):
    texts = [(1, "The Red widget, the red-widget"), (2, "red"), (3, None), (4, ""), (5, "a red  WIDGET of 7 small gears"), (6, "reddish widgets"), (7, "red widget red widget " * 20_000), (8, "naïve café red")]
    works = spark.createDataFrame(texts, "work long, _t string")
    terms = spark.createDataFrame([(t,) for t in ("red widget", "Red", "red", "widget of 7", "gears", "the", "***", "", "na ve", "widget red", None)], "term string")
    one, two = ({(r.work, r.term) for r in C.mentioned(works, terms, most).collect()} for most in (1000, 0))
    assert one == two and {(1, "red widget"), (5, "widget of 7"), (8, "na ve"), (7, "widget red"), (2, "Red")} <= one and not any(w in (3, 4, 6) for w, _ in one)
    assert C.mentioned(works, terms.where("false")).count() == 0 and C.mentioned(works.where("false"), terms).count() == 0


def test_text_mentions_read_the_texts_once(spark, tmp_path):
    rows = [(i, "", f"alpha beta {'gamma' if i % 2 else 'delta'} {i}", 2000 + i % 3, i) for i in range(40)]
    spark.createDataFrame(rows, "work long, title string, text string, year int, cited int").write.parquet(f"{tmp_path}/w")
    works = spark.read.parquet(f"{tmp_path}/w")
    pairs = spark.createDataFrame([(1, "alpha", "Gamma"), (2, "delta", "gamma"), (3, "beta", "alpha beta")], "pair_id int, a_name string, c_name string")
    found = C.text_comentions(works, pairs, 2)
    got = {r.pair_id: (r.hits, [i.work for i in r["items"] or []]) for r in found.collect()}
    assert got == {1: (20, [39, 37]), 2: (0, []), 3: (40, [39, 38])}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line.split("ReadSchema")[-1] for line in plan.split("\n") if "ReadSchema" in line and "work" in line)


def test_names_within_names_by_the_rarest_string(spark):
    rng = random.Random(4)
    stems = ["disease", "disorder", "dis", "di", "d", "heart disease", "xdisx", "ab", "", "diseas e", "zzz"]
    hay = stems + ["disease " + "".join(rng.choice("abc ") for _ in range(5)) for _ in range(60)]
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.q, r.n) for r in C.within(one(hay, "q"), one(hay, "n")).collect()}
    assert got == {(q, n) for q in hay for n in hay if q and q in n}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_are_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(7)
    base = [{rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.randint(0, 12))} for _ in range(50)]
    sets = base + [set(list(s)[: max(1, len(s) - 1)]) for s in base[:25]] + base[:5] + [s | {"hot"} for s in base[5:15]]
    rows = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "name int, g array<string>")
    got = {(r.a, r.b): r.jaccard for r in similarity.similar_sets(rows, threshold).collect()}
    want = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a | b and len(a & b) / len(a | b) >= threshold - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    with pytest.raises(ValueError):
        similarity.similar_sets(rows, 0.0)


def test_prefixes_meet_few_pairs(spark):
    rng = random.Random(1)
    names = [f"common word {rng.choice('abcdefgh')}{rng.randrange(4000)} {rng.randrange(4000)}" for _ in range(600)]
    ranked = similarity.ordered_sets(spark.createDataFrame([(n,) for n in set(names)], "name string").withColumn("g", T.char_ngrams(F.col("name"))), "name", "g")
    few, all_ = (similarity.candidate_pairs(ranked, 0.8, prefix).count() for prefix in (True, False))
    print(f"pairs met before verification: {few} of {all_}")
    assert few < all_ / 10


def test_works_are_dealt_out_by_the_number_of_rows(spark, monkeypatch):
    from lacuna import session

    rows = spark.createDataFrame([(w, f"c{(w * k) % 7}") for w in range(40) for k in range(4)] + [(None, "c1")], "work long, cid string")
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    assert session.tasks(rows) == 17 and session.tasks(rows.limit(5)) == spark.sparkContext.defaultParallelism
    dealt, plain = (C.Corpus.from_work_concepts(rows, tasks=n) for n in (session.tasks(rows), None))
    for of in (lambda c: c.edges, lambda c: c.concepts, lambda c: c.size, lambda c: C.anchored_edges(rows, spark.createDataFrame([("c1",), ("c4",)], "cid string"), 17)):
        assert sorted(of(dealt).collect()) == sorted(of(plain).collect())
    assert dealt.size.first()[0] == 40
    kept = C.concept_pairs(C.by_work(rows.dropna(), 17), keep=True)
    assert kept.rdd.getNumPartitions() >= 17 and kept.groupBy("src", "dst").count().count() * 2 == dealt.edges.count()


def test_sets_are_met_by_pairs_of_concepts(spark):
    rng = random.Random(5)
    of = {w: set(rng.sample("abcdef", rng.randint(1, 5))) for w in range(60)}
    wc = spark.createDataFrame([(w, c) for w, cs in of.items() for c in cs] + [(0, sorted(of[0])[0])], "work long, cid string")
    sets = {"one": ["a"], "two": ["b", "a"], "same": ["a", "a", "b"], "three": ["a", "c", "d"], "four": ["f", "a", "c", "d"], "unknown": ["a", "z"], "none": []}
    asked = spark.createDataFrame(list(sets.items()), "set_id string, cids array<string>")
    want = {(s, w) for s, cs in sets.items() for w, have in of.items() if cs and set(cs) <= have}
    for most in (100, 0):  # sent to every task, or joined by equality
        found = C.works_with_all(wc, asked, limit=100, tasks=3, most=most)
        assert sorted((r.set_id, r.work) for r in found.collect()) == sorted(want)


def test_a_vector_goes_in_few_rows(spark):
    rng = random.Random(3)
    rows = [(g, [rng.uniform(-1, 1) for _ in range(k)]) for g, k in ((1, 70), (1, 64), (1, 3), (2, 70), (2, 70))] + [(2, None), (3, None), (3, [0.0])]
    frame = spark.createDataFrame(rows, "g int, vec array<double>")
    unit = [(g, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for g, v in rows if v and any(v)]
    pairs = {g: [sum(a * b for a, b in zip(u, v)) for (h, u), (i, v) in itertools.combinations(unit, 2) if h == i == g] for g in (1, 2, 3)}
    got = {r.g: (r.n, r.mean_cosine) for r in similarity.mean_cosine(frame, "g", members=frame.select("g")).collect()}
    assert {g: n for g, (n, _) in got.items()} == {1: 3, 2: 3, 3: 2}
    assert all(m == pytest.approx(sum(pairs[g]) / 3) for g, (_, m) in got.items())
    plan = similarity.mean_cosine(frame, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and similarity.STRIP == 64  # rows go by strips, not by components


def test_mean_cosine_is_the_mean_over_pairs(spark):
    rng = random.Random(3)
    rows = [(g, None if rng.random() < 0.1 else [rng.gauss(0, 1) if rng.random() < 0.9 else 0.0 for _ in range(5)]) for g in ("a", "b", None) for _ in range(9)]
    rows += [("zero", [0.0] * 5), ("zero", [1.0, 0.0, 0.0, 0.0, 0.0]), ("one", [1.0] * 5), ("none", None), ("none", []), ("nan", [float("nan"), 1.0]), ("nan", [0.0, 2.0])]
    got = {r.g: (r.n, r.mean_cosine) for r in similarity.mean_cosine(spark.createDataFrame(rows, "g string, vec array<double>"), "g").collect()}

    def cosine(x, y):
        x, y = ([0.0 if v != v else v for v in z or []] for z in (x, y))
        size = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return sum(p * q for p, q in zip(x, y)) / size if size else 0.0

    for group in {g for g, _ in rows}:
        own = [v for g, v in rows if g == group]
        pairs = [cosine(x, y) for x, y in itertools.combinations(own, 2)]
        n, mean = got[group]
        assert n == len(own) and (mean is None if not pairs else abs(mean - sum(pairs) / len(pairs)) < 1e-9)
    links = spark.createDataFrame([("A", "C", [{"name": "x"}, {"name": "y"}, {"name": "z"}]), ("A", "D", [{"name": "x"}])], "a string, c string, found array<struct<name:string>>")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0]), ("x", [1.0, 0.0])], "name string, vec array<double>")
    assert {r.c: r.diversity for r in with_diversity(links, vectors).collect()} == {"C": 0.667, "D": 1.0}


def test_all_splits_at_once_are_the_splits_one_by_one(spark):
    rng = random.Random(9)
    rows = [(w, f"k{rng.randrange(25)}", 2000 + w % 6 if w % 17 else None) for w in range(400) for _ in range(rng.randint(1, 4))]
    wc = spark.createDataFrame(list(set(rows)), "work long, cid string, year int")
    names = wc.select("cid").distinct().select("cid", F.concat(F.lit("name "), "cid").alias("name"), F.lit(3).alias("level"))
    cfg = DiscoveryConfig(filters=LevelFilter(), bridge_pool=6)
    topics = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "a string")
    cube = backtest.TimeCube.from_work_concepts(wc, names)
    at_once = backtest.run_splits(cube, topics, (2001, 2003, 2004), cfg, k=3, emergence_threshold=1)
    columns = ("a", "c", "past_comentions", "future_comentions", "hit", "chosen", "bridge_ids")
    got = {}
    for r in at_once.collect():
        got.setdefault(r.split, set()).add((*(str(r[c]) for c in columns), round(r.score, 9)))
    for split in (2001, 2003, 2004):
        past, future = backtest.by_year(lambda lo, hi: C.Corpus.from_work_concepts(wc, names, year_from=lo, year_to=hi), split)
        assert got[split] == {(*(str(r[c]) for c in columns), round(r.score, 9)) for r in backtest.run_backtest(past, future, topics, cfg, k=3, emergence_threshold=1).collect()}
    summary = backtest.splits_summary(at_once)
    assert summary.count() == at_once.select("split", "a").distinct().count() and summary.columns[:2] == ["split", "a"]


def test_works_that_come_late_and_twice_are_counted_once(spark, tmp_path):
    rng = random.Random(6)
    rows = list({(w, f"c{rng.randrange(12)}") for w in range(30) for _ in range(6)}) + [(None, "c1"), (1, None)]
    batches = [[r for r in rows if rng.random() < 0.5] for _ in range(4)] + [rows, [], rows[:7]]
    write, frame = merge_works(str(tmp_path), shards=4), lambda b: spark.createDataFrame(b, "work long, cid string")
    for i, b in enumerate(batches):
        write(frame(b), i)
        if i in (2, 4):
            write(frame(b), i)  # run again
    want = {(r.src, r.dst): r.cooc for r in C.cooccurrence_edges(frame(rows)).collect()}
    assert {(r.src, r.dst): r.cooc for r in merged(spark, str(tmp_path)).collect()} == want


def test_what_was_answered_is_not_asked_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def service(keys):
        for k in keys:
            (log / f"{k}-{len(list(log.glob(k + '-*')))}").write_text("")
            yield k, None if k == "down" else "" if k == "empty" else k.upper()

    memo = Memo(spark, str(tmp_path / "memo"))
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("down", 3), ("empty", 4), (None, 5)], "name string, n int")
    want = {(1, "A"), (2, "A"), (3, None), (4, ""), (5, None)}
    assert {(r.n, r.answer) for r in memo.ask(keys, service, "name").collect()} == want
    assert {(r.n, r.answer) for r in Memo(spark, str(tmp_path / "memo")).ask(keys.unionByName(spark.createDataFrame([("b", 6)], "name string, n int")), service, "name").collect()} == want | {(6, "B")}
    assert sorted(p.name for p in log.iterdir()) == ["a-0", "b-0", "down-0", "down-1", "empty-0"]


def test_names_are_resolved_before_they_are_counted(spark):
    concepts = spark.createDataFrame([("A", "Red Sea", 2, 5), ("B", "Blue Moon", 2, 3), ("C", None, 2, 1)], "cid string, name string, level int, works_count long")
    graph = C.Corpus(concepts, spark.createDataFrame([("A", "B", 4), ("B", "A", 4)], "src string, dst string, cooc long"), 10)
    pairs = spark.createDataFrame([("red sea", " BLUE moon "), ("the red sea now", "moon"), ("red sea", "green"), (None, "moon"), ("", "moon"), ("red sea", "red sea"), ("red sea", "red sea")], "a_name string, c_name string")
    got = sorted(((r.a_name, r.c_name, r.a, r.c, r.hits) for r in C.comentions_by_name(graph, pairs).collect()), key=str)
    assert got == sorted([("red sea", " BLUE moon ", "A", "B", 4), ("the red sea now", "moon", "A", "B", 4), ("red sea", "green", "A", None, 0), (None, "moon", None, "B", 0), ("", "moon", None, "B", 0)] + [("red sea", "red sea", "A", "A", 0)] * 2, key=str)
    made = C.stand_in_works(spark.createDataFrame([("s", ["B", "A", "C"]), ("t", ["A"])], "set_id string, cids array<string>"), concepts).orderBy("set_id").collect()
    assert [(r.work, r.title, r.year, r.cited) for r in made] == [("stand-in:s", "Blue Moon, Red Sea and C", 2011, 0), ("stand-in:t", "Red Sea", 2011, 0)]


def test_evidence_has_snippets_years_and_sources_and_reads_the_first_results(spark):
    from lacuna.operators import evidence, report

    pairs = spark.createDataFrame([("A", "C", "alpha", "gamma")], "a string, c string, a_name string, c_name string")
    results = spark.createDataFrame([("A", "C", i, f"Alpha {i}", ["gamma" if i % 2 else "none", "x" * 300], f"u{i}", "web", f"May {2000 + i}") for i in range(12)] + [("Z", "C", 1, "Alpha gamma", None, None, None, None)], "a string, c string, place int, title string, excerpts array<string>, url string, source string, date string")
    row = evidence.from_search(results, 3)(pairs).first()
    assert row.hits == 3 and [(i.place, i.year, i.source, i.kind, len(i.snippet)) for i in row["items"]] == [(0, 2000, "web", "web", 240), (1, 2001, "web", "web", 240), (2, 2002, "web", "web", 240)]
    assert evidence.from_search(results, 3, read=12)(pairs).first().hits == 6
    works = spark.createDataFrame([(1, "Alpha", "of gamma and more", 1999, 5, "http://x"), (2, "", "gamma alpha", None, 9, None), (3, "", "alpha", 2001, 1, None)], "work long, title string, text string, year int, cited int, url string")
    both = spark.createDataFrame([("A", "C", "alpha", "gamma"), ("A", "D", "alpha", "delta")], "a string, c string, a_name string, c_name string")
    got = {r.c: (r.hits, [tuple(i) for i in r["items"]]) for r in evidence.from_texts(works)(both).collect()}
    assert got == {"C": (2, [(1, "", None, "gamma alpha", "corpus", None, "paper", 2), (2, "Alpha", "http://x", "of gamma and more", "corpus", 1999, "paper", 1)]), "D": (0, [])}
    hyp = {"statement": "s", "bridges": ["b"], "score": 1.0, "novelty": 1.0, "plausibility": 1.0, "works_cited": [{"work": 1, "title": "T", "year": 2000, "url": "u"}], "items": [{"title": "I", "year": None, "url": None, "kind": "web"}], "verification_note": "note"}
    text = report.as_text({"topic": "t", "source_concept": "c", "hypotheses": [hyp], "trace": []})
    assert "cites T (2000) u" in text and "evidence [web] I" in text and "note" in text


def test_targets_need_types_on_the_command_line(spark, tmp_path, capsys):
    import json
    import os

    from lacuna.__main__ import main

    graph = os.path.join(os.path.dirname(__file__), "fixtures", "graph.json")
    types = tmp_path / "types.json"
    types.write_text("".join(json.dumps({"name": n, "letters": x}) + "\n" for n, x in (("Fish oil", ["D"]), ("Eicosapentaenoic acid", ["D"]), ("Serotonin", []))))
    with pytest.raises(SystemExit):
        main(["--graph", graph, "discover", "Raynaud disease", "--target", "drug"])
    capsys.readouterr()
    assert main(["--graph", graph, "--json", "discover", "Raynaud disease", "--target", "drug", "--types", str(types)]) == 0
    assert [h["c_name"] for h in json.loads(capsys.readouterr().out)["hypotheses"]] == ["Fish oil", "Eicosapentaenoic acid"]


def test_concepts_alike_are_compared_once_and_every_pair_comes_out(spark):
    from lacuna.operators.filters import LevelFilter, make_filter, usable_pairs

    names = ["fish oil", "oil of fish", "magnesium", "disease", "Magnesium (film)", None, "blood viscosity"]
    rows = spark.createDataFrame([(i, names[i * 7 % 11 % 7], i % 5 if i % 6 else None) for i in range(120)], "cid long, name string, level int")
    for flt in (make_filter("biomed"), LevelFilter()):
        f = flt.features(rows)
        packed = lambda n: f.select(F.struct(*f.columns).alias(n))
        want = packed("a").where("a.cid % 3 = 0").crossJoin(packed("c")).where(flt.usable("c", "a", 2)).select("a.cid", "c.cid").collect()
        got = usable_pairs(flt, rows.where("cid % 3 = 0"), rows, 2, most=40, sent=3).collect()
        assert len(got) == len(want) > 100 and {tuple(r) for r in got} == {tuple(r) for r in want}


def test_pairs_of_concepts_alike_are_unfolded_by_spark_and_no_row_holds_every_topic(spark, monkeypatch):
    from lacuna.operators import filters

    counts = []
    keep = filters.stored
    monkeypatch.setattr(filters, "stored", lambda frame, name: (counts.append(frame.count()), keep(frame, name))[1])
    rows = spark.createDataFrame([(i, ["fish oil", "magnesium", "blood viscosity"][i % 3], i % 4) for i in range(240)], "cid long, name string, level int")
    got = filters.usable_pairs(filters.make_filter("biomed"), rows.where("cid % 5 = 0"), rows, 2, most=40, sent=7)
    assert counts == [12, 12]  # parts are made of the largest group, not of all rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    steps = [line.split()[0].lstrip("+-:*") or line.split()[1] for line in plan.splitlines() if any(s in line for s in ("Generate explode(a#", "Generate explode(c#", "Coalesce ", "NestedLoopJoin", "MapIn"))]
    assert steps == ["Generate", "Coalesce", "Generate", "Coalesce", "BroadcastNestedLoopJoin"], plan
    assert {tuple(r) for r in got.collect()} == {(a, c) for a in range(0, 240, 5) for c in range(240) if c % 4 >= 2 and a % 3 != c % 3} and got.count() == 48 * 80
    assert filters.usable_pairs(filters.LevelFilter(), rows.where("false"), rows, 2).count() == 0


def test_results_of_one_place_and_title_come_in_the_order_of_their_excerpts(spark):
    from lacuna.operators import evidence

    pairs = spark.createDataFrame([("A", "C", "alpha", "gamma")], "a string, c string, a_name string, c_name string")
    made = [("A", "C", 1, "Alpha", [f"{'gamma' if i < 2 else 'none'} {i}"], None) for i in range(6)]
    for rows in (made, made[::-1], made[3:] + made[:3]):
        row = evidence.from_search(spark.createDataFrame(rows, "a string, c string, place int, title string, excerpts array<string>, url string"), 2, read=3)(pairs).first()
        assert row.hits == 2 and [i.snippet for i in row["items"]] == ["gamma 0", "gamma 1"]


def test_cosines_by_blocks_are_those_pair_by_pair(spark):
    rng = random.Random(5)
    some = lambda i: None if i % 19 == 3 else [] if i % 19 == 4 else [1.0, None, 2.0] if i % 19 == 5 else [0.0] * 4 if i % 19 == 6 else [rng.gauss(0, 1) for _ in range(3 + (i % 23 == 0))]
    for make in (some, lambda i: [rng.gauss(0, 1) for _ in range(5)]):
        rows = spark.createDataFrame([(i, make(i)) for i in range(150)], "k long, v array<float>").localCheckpoint()
        q = rows.where("k % 7 = 0")
        pairs = q.select(F.col("k").alias("a"), F.col("v").alias("x")).crossJoin(rows.select(F.col("k").alias("b"), F.col("v").alias("y"))).where("a <> b")
        want = {(r.a, r.b): r.c for r in pairs.select("a", "b", F.round(T.cosine(F.col("x"), F.col("y")), 6).alias("c")).collect()}
        got = similarity.cosines(q, rows, "k", "v", block=9).collect()
        assert {(r.a, r.b): r.cosine for r in got} == want and len(got) == len(want)
    assert similarity.cosines(q.where("false"), rows, "k", "v").count() == 0


def test_a_text_is_indexed_within_its_row(spark):
    texts = ["a b a  c", "", " ", "x", "b a\nb é b", "w " * 3000, None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("index", T.inverted_index(F.col("t")))
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    for r in frame.withColumn("again", T.rebuilt_abstract(F.col("index"), 1 << 30)).collect():
        want = None if r.t is None else {w: [p for p, x in enumerate(r.t.split(" ")) if x == w] for w in set(r.t.split(" "))}
        assert r["index"] == want and r.again == (r.t or "")


def test_a_title_is_read_once_whichever_papers_have_it(spark):
    from lacuna.operators import mining

    titles = ["magnesium and (Magnesium sulfate Mix1) as a drug", "Fish Compound3 therapy of magnesium", "magnesium alone"]
    papers = spark.createDataFrame([("magnesium", i, titles[i % 3]) for i in range(30)] + [("magnesium", 0, titles[0]), ("oil", 1, titles[1])], "topic string, paper int, title string")
    found = mining.mined(papers)
    got = {(r.topic, r.target): (r.paper_count, r.distinct_papers, r.supporting) for r in found.collect()}
    assert got == {("magnesium", "Fish Compound3"): (10, 10, [titles[1]] * 2)}
    assert "regexp_extract_all" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_late_works_is_as_many_files_as_it_needs(spark, monkeypatch):
    from lacuna.plans import queries as Q

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(Q, "FILE_ROWS", 2000)
    want = {tuple(r) for r in Q.cooccurrence_edges(spark, d).collect()}
    assert {tuple(r) for r in Q.late_works(spark, d).collect()} == want and want
