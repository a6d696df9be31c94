"""Periodic runs, chat windows and the filter audit against brute force and SQL, on small tables; and their edge cases."""

import hashlib
import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import audit, chat, periods

DATA = "/root/testdata/sf0.001"
CLASHING = ("part", "mask", "digest", "n", "first", "kind", "stripe", "tokens", "window", "loss", "runs", "w", "a", "g", "p", "best", "quality_")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"_{name}", frame.toPandas())
        con.execute(f"CREATE TABLE {name} AS SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in ((f.name, {'bigint': 'BIGINT', 'int': 'INT', 'string': 'VARCHAR'}[f.dataType.simpleString()]) for f in frame.schema))} FROM _{name}")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return {tuple(str(x) for _, x in sorted(zip(names, row))) for row in out.fetchall()}


def rows_of(frame):
    names = sorted(frame.columns)
    rows = [tuple(str(r[c]) for c in names) for r in frame.collect()]
    assert len(rows) == len(set(rows)) or "conv_id" not in names
    return set(rows)


# --- periodic runs ------------------------------------------------------------------------------------------------


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(least, exponent * p) and not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force_for_any_block_of_probes():
    rng = random.Random(5)
    for _ in range(700):
        k, w = rng.choice([1, 2, 2, 3, 5]), []
        for _ in range(rng.randint(0, 12)):
            w += [rng.randrange(k) for _ in range(rng.randint(1, 6))] * (rng.randint(1, 7) if rng.random() < 0.6 else 1)
        for exponent, least in ((4, 6), (3, 3), (5, 9)):
            assert periods.find_runs(np.array(w, np.int64), least, exponent, rng.choice([1, 9, 1000])) == brute_runs(w, least, exponent), w
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(9, np.int64), 4, 2)


def test_long_texts_take_about_linear_time():
    n = 400_000
    i = np.arange(n)
    for words in (np.zeros(n, np.int64), i % 2, np.where(i % 10_007 == 0, 9, i % 2), np.repeat(np.arange(n // 6) % 7, 6), np.random.default_rng(0).integers(0, 2, n)):
        began = time.time()
        periods.find_runs(words)
        assert time.time() - began < 30


def test_op11_is_the_contract_on_a_whole_table_and_on_odd_rows(spark, tmp_path):
    odd = [(1, None), (2, ""), (3, " \n\t "), (30, "a b\x1c c " * 9), (None, "x " * 30), (5, "a b a b a b a b q"), (5, "a b a b a b a b q"), (6, "w" * 70_000), (7, "一 二 " * 40_000)] + [(i, f"{'one two three ' * (i % 9)} tail{i}") for i in range(100, 160)]
    table = spark.createDataFrame(odd, "doc_id long, text string").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    clashing(table).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periods.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in table.collect():
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
        n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w) if n < 3000 else periods.find_runs(periods.numbered(w))
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 50
    assert periods.periodic_runs(clashing(table).where("false")).count() == 0


# --- chat windows -------------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def odd_chats(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        turn = rng.choice([0, 0, -3, 250])
        for i in range(rng.choice([1, 2, 7, 30])):
            role = "system" if i == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool", "[TURN] x\n", None, "system"])
            text = rng.choice([None, "", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [AGAIN][\\AGAIN] <", "word " * rng.randint(1, 90), "über 12345 日本 😀"])
            rows.append((conv, turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 5, 300])
    long = [(77, i, ("user", "assistant")[i % 2], f"turn {i} " + "so " * (i % 40)) for i in range(2000)] + [(77, -1, "system", "be brief")]
    nulls = [(None, None, "system", "s"), (None, None, "user", "u"), (None, 1, "assistant", "a")] + [(78, 255, "system", "only here"), (78, 256, "user", "q"), (78, 257, "assistant", "b " * 900)]
    return spark.createDataFrame(rows + long + nulls + [(79, 1, "assistant", "same")] * 3, CHAT)


@pytest.mark.parametrize("options", [{}, {"budget": 60, "history": 25, "history_turns": 3, "stripe": 16}, {"budget": 10, "history": 0, "history_turns": 0, "stripe": 1000}])
def test_windows_are_those_of_the_sql_and_read_back_whole(spark, options):
    chats = odd_chats(spark)
    made = chat.windows(clashing(chats), **options)
    planted = f" UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{chat.PLANTED}'), (-7, 1, 'assistant', '{chat.PLANTED}'))"
    assert rows_of(chat.digests(made)) == duck(chat.oracle(**options).replace(planted, ""), conversations=chats)
    turns = chat.read_back(made).where("not repeated").groupBy("conv_id", "role", "text").count().collect()
    plain = chats.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "role", "text").count().collect()
    assert {tuple(r) for r in turns} == {tuple(r) for r in plain}
    assert chat.windows(chats.where("false")).count() == 0


def test_windows_keep_to_budget_system_turn_and_history(spark):
    chats = odd_chats(spark)
    budget, history = 80, 30
    made = chat.windows(chats, budget, history, 3, 64)
    seen = {}
    for r in chat.read_back(made).orderBy("conv_id", "stripe", "window", "place").collect():
        seen.setdefault((r.conv_id, r.stripe, r.window), []).append(r)
    sizes = {(r.conv_id, r.stripe, r.window): (r.n_tokens, r.n_turns) for r in made.collect()}
    assert any(n > budget for n, _ in sizes.values()) and all(n <= budget or fresh == 1 or (fresh == 2 and seen[k][0].role == "system") for k, (n, fresh) in sizes.items())
    long = [v for k, v in sorted(seen.items(), key=str) if k[0] == 77]
    assert all(w[0].role == "system" and w[0].text == "be brief" for w in long) and sum(not w[0].repeated for w in long) == 1
    assert sum(any(r.repeated and r.role != "system" for r in w) for w in long) > len(long) // 2
    learnt = [r for w in seen.values() for r in w if r.learnt]
    assert all(r.role == "assistant" and not r.repeated for r in learnt) and len(learnt) == chats.where("role = 'assistant'").count()


@given(st.text(st.sampled_from("<>[]/\\sINTSYUROAG x"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_leaves_no_mark(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not chat._MARK.search(out)
    window = "<s>" + "".join(chat._turn(r, text, a)[0] for r, a in (("user", False), ("assistant", True), (text, False), ("system", False)))
    assert [(r, t, a) for r, t, a, _, _ in chat.turns_of(window)] == [(r, text, a) for r, a in (("user", False), ("assistant", True), (text, False), ("system", False))]


def test_other_counts_of_tokens_can_be_given(spark):
    chats = odd_chats(spark).where("conv_id = 77")
    assert chat.windows(chats, tokens=lambda t: F.octet_length(t)).count() > chat.windows(chats).count()


# --- audit of filters ---------------------------------------------------------------------------------------------


def test_the_walk_visits_every_order_by_single_swaps_and_keeps_its_steps_right():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5):
        orders = list(audit.adjacent_swaps(n))
        assert {o for o, _ in orders} == set(itertools.permutations(range(n)))
        for (a, _), (b, i) in zip(orders, orders[1:]):
            assert a[:i] + (a[i + 1], a[i]) + a[i + 2 :] == b
        cells, good, toxic = (rng.integers(0, 9, (3, 1 << n)) for _ in range(3))
        found, out, shapley = audit.walk(cells, good, toxic)
        total = np.zeros((3, n), int)
        for o, order in enumerate(found):
            for place, f in enumerate(order):
                before = sum(1 << g for g in order[:place])
                here = np.array([m & before == 0 and m >> f & 1 == 1 for m in range(1 << n)])
                kept = np.array([m & (before | 1 << f) == 0 for m in range(1 << n)])
                late = np.array([m & before != 0 and m >> f & 1 == 1 for m in range(1 << n)])
                want = [cells[:, kept].sum(1), cells[:, here].sum(1), cells[:, late].sum(1), cells[:, 1 << f], good[:, here].sum(1), toxic[:, here].sum(1)]
                assert (np.stack(want) == out[:, :, o, place]).all()
                total[:, f] += cells[:, here].sum(1)
        assert (total == shapley).all()


def test_op13_is_the_sql_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, None), (2, "", "a"), (3, "", "a"), (None, "", "b"), (None, long, "b"), (4, long, "b"), (5, long, ""), (5, long, ""), (5, "other", "a"), (6, "ABC def" * 90, "a"), (7, "a " * 70_000, "ü"), (8, "x y\x1cz # " * 40, "a")]
    rows += [(i, long if i % 3 else f"{long} {i} %", "hot") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (4, 0, 1), (5, None, 1), (None, 1, 1), (7, 0, 0), (999, 1, 1)] + [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(100, 300)], "doc_id long, quality int, toxic int")
    clashing(docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("n", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.op13_filter_audit(spark, str(tmp_path))
    assert got.count() == 600 * len({s or "" for _, _, s in rows})
    assert rows_of(got) == duck(audit.ORACLE, documents=docs, labels=labels)
    assert audit.interactions(docs.where("false"), labels).count() == 0


def test_an_audit_takes_filters_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b c", "s"), (3, "", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit.interactions(docs, labels, {"X": lambda t, w: len(w) < 3, "Y": lambda t, w: not t}, None).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in out} == {
        ("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 3),
    }
