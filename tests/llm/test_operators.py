"""The ten operators against brute force, round trips and held-out accuracy, on small tables; and their edge cases."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lacuna.llm import fertility, html, labelled, mixing, pieces, pii, pivots, ranking, registry, simhash, suffixes, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()), S.StructField("source", S.StringType()), S.StructField("n_chars", S.LongType())])
#: Names that the operators use inside.
CLASHING = ("doc", "hash", "fp", "node", "size", "target", "taken", "h", "skey", "slice", "score", "kept", "spans", "at", "bucket", "component_id", "y", "rank")
EDGE = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "x" * 70_000, "en", "b"), (5, "one two three four", "en", "a"), (5, "one two three four", "en", "a"), (6, "word " * 30_000, "de", "a"), (7, "日本語 тест ▁ 😀 é", "xx", "z"), (None, "null id here", None, None)]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def table(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    return clashing(table(spark, EDGE))


OPERATORS = {
    "op1": lambda d: suffixes.dedup(d),
    "op3": lambda d: pii.spans(d),
    "op4": lambda d: fertility.measure(d),
    "op5": lambda d: mixing.curriculum_mix(d),
    "op6": lambda d: simhash.near_duplicates(d),
    "op8": lambda d: ranking.score(d, ranking.fit([], [])),
    "op9": lambda d: pieces.round_trips(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases_give_a_row_each_and_empty_tables_none(spark, edge, name):
    assert OPERATORS[name](edge).count() == len(EDGE)
    assert OPERATORS[name](edge.where("false")).count() == 0


def test_the_registry_has_all_queries():
    names = set(registry.queries())
    assert {re.match(r"op\d+", n)[0] for n in names if n != "pipeline"} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


# --- 1 ------------------------------------------------------------------------------------------------------------


def brute_dedup(docs):
    """docs: key -> text, in order of their keys."""
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out[d] = len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    return out


@pytest.mark.parametrize("large", [suffixes.LARGE, 2])
def test_op1_removes_what_brute_force_removes(spark, large):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = [text(100) for _ in range(4)], text(30)
    docs = {}
    for i in range(70):
        t = base[i % 4]
        if i % 6 == 1:
            t = " ".join("edit%d" % i if r.random() < 0.05 else w for w in t.split(" "))
        elif i % 6 == 2:
            t = text(30) + passage + text(20)
        elif i % 6 == 3:
            t = text(10) + "x" * r.randrange(350) + "ab" * r.randrange(150)
        elif i % 6 == 4:
            t = base[0][r.randrange(90) :] + base[1][: r.randrange(400)]
        docs[i * 7 % 71 - 5] = t
    rows = suffixes.dedup(table(spark, [(k, v, "", "") for k, v in docs.items()]).repartition(4), large).collect()
    assert {x.doc_id: tuple(x[1:5]) for x in rows} == brute_dedup(docs)


def test_op1_rows_that_share_a_doc_id_or_have_none_are_documents_of_their_own(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdef ghij") for _ in range(n))
    inner = text(150)
    rows = [(None, inner + text(40) + inner), (None, text(300)), (7, inner + text(40) + inner), (7, text(300)), (7, text(50) + inner), (3, text(200)), (3, inner)]
    rows += rows[3:5]  # rows given twice
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    want = brute_dedup({(-(2**63) if d is None else d, hashes[t]): t for d, t in rows})
    for large in (suffixes.LARGE, 1):
        got = suffixes.dedup(table(spark, [(d, t, "", "") for d, t in rows]).repartition(3), large).collect()
        assert sorted((x.doc_id or 0, *x[1:5]) for x in got) == sorted((d or 0, *want[-(2**63) if d is None else d, hashes[t]]) for d, t in rows)


def test_op1_ranks_are_lexicographic_and_settle_ties():
    r = random.Random(2)
    data = np.frombuffer(b"".join(r.choice([b"a" * 40, b"ab", b"c\0", b"\0", bytes([r.randrange(256)])]) for _ in range(400)), np.uint8)
    at = np.arange(0, len(data) - suffixes.LONG, 3)
    strings = [data[i : i + suffixes.LONG].tobytes() for i in at]
    assert suffixes.sample_ranks(data, at).tolist() == [sum(x < y for x in strings) for y in strings]
    starts = np.arange(len(data) - suffixes.WINDOW + 1)
    seen, want = set(), []
    for i in starts:
        w = data[i : i + suffixes.WINDOW].tobytes()
        want.append(w in seen)
        seen.add(w)
    none = np.zeros(len(starts), np.int64)
    assert suffixes.repeated(data, starts, none, none, starts).tolist() == want and any(want)


def test_op1_repeated_rows_and_segments(spark, monkeypatch):
    assert len({tuple(x) for x in suffixes.dedup(table(spark, [(1, "ab" * 200, "", "")] * 3)).select("doc_id", "n_removed", "kept_sha256").collect()}) == 1
    for v in (suffixes.PERIOD, 16):
        cover = suffixes.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) <= v // 2
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    import pyarrow as pa

    t = "".join(random.Random(1).choice("abc") for _ in range(2000))
    batch = pa.RecordBatch.from_pydict({"doc": [1], "text": [t]})
    parts = [(bases, bounds) for _, bases, _, bounds in suffixes._segments(batch)]
    assert len(parts) > 3  # every window is in a segment
    covered = {int(b) + i for bases, bounds in parts for b, n in zip(bases, np.diff(bounds)) for i in range(n - 99)}
    assert covered == set(range(2000 - 99))


# --- 2 ------------------------------------------------------------------------------------------------------------


def test_op2_links_what_brute_force_links(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    x = [list(map(float, centres[i % 40] + r.normal(size=16) * 0.12)) for i in range(400)]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(400, x[0], 1), (401, [2 * v for v in x[0]], 1), (402, None, 0), (403, [0.0] * 16, 0), (404, [float("nan")] * 16, 0), (405, [None] + x[0][1:], 0), (406, x[0][:8], 0), (407, x[0][:8], 0), (None, x[0], 0)]
    got = {g.vec_id: g for g in pivots.near_duplicates(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))).collect()}
    ids = [*range(402)]
    u = pivots.unit([rows[i][1] for i in ids])
    links = (u @ u.T >= 0.95) & ~np.eye(len(ids), dtype=bool)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * links.sum() and all(got[i].n_links <= links[i].sum() for i in ids)
    assert found == links.sum()
    label = np.arange(len(ids))
    while True:
        low = np.array([min(label[i], label[links[i]].min(initial=label[i])) for i in ids])
        if (low == label).all():
            break
        label = low
    assert [got[i].component_id for i in ids] == label.tolist() and all(got[i].kept == (label[i] == i) for i in ids)
    assert [got[i].n_links for i in (402, 403, 404, 405, 406, 407)] == [0, 0, 0, 0, 1, 1] and got[None].n_links == 0
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def plain_links(u):
    """Links and components of unit vectors by all pairs, in blocks."""
    links, label = np.zeros(len(u), int), np.arange(len(u))
    near = [np.flatnonzero(u @ x >= 0.95) for x in u]
    links = np.array([len(n) - 1 for n in near])
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            return links, label
        label = low


@pytest.mark.parametrize("n,dim,block", [(4000, 64, pivots.BLOCK), (4000, 256, 100), (20_000, 64, pivots.BLOCK)])
def test_op2_recall_on_planted_pairs(spark, n, dim, block):
    r = np.random.default_rng(n + dim)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n // 2, 2):  # pairs at cosines over the threshold, and below it
        c = (0.952, 0.97, 0.99, 0.9)[i // 2 % 4]
        y = r.normal(size=dim)
        y -= (y @ x[i]) * x[i]
        x[i + 1] = c * x[i] + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)
    x[-30:] = x[-1] + r.normal(size=(30, dim)) * 0.1 / dim**0.5  # a cluster
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(pivots.near_duplicates(rows, block=block).collect())
    links, label = plain_links(pivots.unit(x))
    found = np.array([g.n_links for g in got])
    assert found.sum() >= 0.95 * links.sum() > 0 and (found <= links).all()
    assert np.mean([g.component_id == c for g, c in zip(got, label)]) > 0.99


def test_op2_candidates_are_those_of_counted_shared_pivots():
    r = np.random.default_rng(3)
    perms = np.array([r.permutation(14)[: pivots.NEAREST] for _ in range(40)])
    for name in range(14):
        on = perms[(np.sort(perms, 1)[:, : pivots.POSTINGS] == name).any(1)]
        got = pivots.candidate_pairs(name, on, on)
        for i, p in enumerate(on.tolist()):
            for j, q in enumerate(on.tolist()):
                both = set(p) & set(q)
                score = sum((pivots.NEAREST - p.index(z)) * (pivots.NEAREST - q.index(z)) for z in both)
                assert got[i, j] == (len(both) >= pivots.SHARED and min(both) == name and score >= pivots.ORDER)
    for p in perms:  # pairs with enough in common meet in the list of the smallest pivot they share
        for q in perms:
            both = set(p) & set(q)
            assert len(both) < pivots.SHARED or all(min(both) in np.sort(v)[: pivots.POSTINGS] for v in (p, q))


# --- 3 ------------------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_op3_base_spans_are_those_of_the_patterns(spark):
    r = random.Random(5)
    for _ in range(1500):
        t = "".join(r.choice(["a", "@", ".", "1", "25", "4111", " ", "-", "+1", "(", ")", "b.c", "@x.y", "\n", "4111111111111111", "192.168.0.1", "é"]) for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {x.doc_id: x for x in pii.spans(rows).collect()}
    for x in rows.collect():
        base = plain_spans(x.text)
        g = got[x.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert g.base_sha256 == hashlib.sha256(pii._joined(base).encode()).hexdigest() and set(pii._joined(base).split(",")) - {""} <= set(g.spans.split(","))


def test_op3_the_network_finds_disguised_data_and_leaves_the_rest_alone(spark):
    tagger = pii.trained()
    held = pii.labelled_sentences(200, seed=99)
    found = pii.model_spans([t for t, _ in held], tagger)
    hit = sum(any(s <= a < e or a <= s < b for a, k, b in f) for f, (_, spans) in zip(found, held) for s, k, e in spans)
    assert hit >= 0.85 * sum(len(s) for _, s in held)
    clean = [x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect() if not re.search(r"[0-9@]", x.text)]
    assert not any(pii.model_spans(clean, tagger))
    text = "hello " * 60 + "write to jane.roe (at) example.org now" + " bye" * 60
    (spans,) = pii.model_spans([text], tagger)
    assert [text[s:e] for s, k, e in spans if k == 0] == ["jane.roe (at) example.org"]
    masked = pii.mask(table(spark, [(1, "mail a@b.co now", "en", "s"), (2, None, "en", "s")])).orderBy("doc_id").collect()
    assert masked[0].text == "mail <EMAIL> now" and masked[0].n_chars == 16 and masked[1].text is None


def test_op3_the_crf_is_that_of_enumeration_and_gradients_are_right():
    tagger = pii.Tagger(3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    r = np.random.default_rng(0)
    tagger.p["A"] = r.normal(0, 0.5, tagger.p["A"].shape)
    x, y = r.integers(97, 123, (1, 4)), r.integers(0, pii.TAGS, (1, 4))
    paths = list(itertools.product(range(pii.TAGS), repeat=4))

    def scores():
        e, a = tagger.emissions(x)[:, 0], tagger.p["A"]
        return np.array([sum(e[t, p[t]] for t in range(4)) + sum(a[p[t], p[t + 1]] for t in range(3)) for p in paths])

    def loss():  # of the labels, by all paths
        s = scores()
        return np.log(np.exp(s - s.max()).sum()) + s.max() - s[paths.index(tuple(y[0].tolist()))]

    assert tuple(tagger.decode(tagger.emissions(x))[:, 0].tolist()) == paths[int(scores().argmax())]
    g = tagger._gradients(x, y)
    for name in tagger.p:
        for _ in range(6):
            at = tuple(int(r.integers(n)) for n in tagger.p[name].shape)
            if name == "E":
                at = int(x[0, r.integers(4)]), at[1]
            keep, eps, both = tagger.p[name][at], 1e-3, []  # states are kept in single precision
            for d in (eps, -eps):
                tagger.p[name][at] = keep + d
                both.append(loss())
            tagger.p[name][at] = keep
            assert abs((both[0] - both[1]) / (2 * eps) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_op3_spans_longer_than_windows_overlap_are_whole():
    join = pii.joined_halves
    assert join([(10, 0, 192, 5.0, False, True), (96, 0, 288, 5.0, True, True), (192, 0, 300, 5.0, True, False)]) == [(10, 0, 300, 290 * 15 / 482)]
    assert join([(96, 0, 288, 5.0, True, True)]) == [] and join([(5, 0, 192, 1.0, False, True), (96, 1, 200, 1.0, True, False)]) == []

    class Marks:  # labels every "x" as an email, whatever stands around it
        def emissions(self, x):
            e = np.zeros((x.shape[1], x.shape[0], pii.TAGS), np.float32)
            e[:, :, 1] = np.where(x.T == ord("x"), 3, -3)
            return e

        decode = pii.Tagger.decode
        p = {"A": np.zeros((pii.TAGS, pii.TAGS), np.float32)}

    r = random.Random(1)
    for n in (5, 95, 97, 150, 191, 192, 193, 500, 2000):
        mail = "x" * n + "@" + "x.x"
        text = "a " * r.randrange(300) + mail + " a" * r.randrange(300)
        tagger = Marks()
        tagger.emissions = lambda x, f=Marks.emissions: np.where(np.isin(x.T, [ord(c) for c in "x@."])[:, :, None] & (np.arange(pii.TAGS) == 1), 3.0, np.where(np.arange(pii.TAGS) == 1, -3.0, 0.0)).astype(np.float32)
        (got,) = pii.model_spans([text], tagger)
        assert [text[s:e] for s, _, e in got] == [mail], n


def test_op3_reconciles_windows_globally():
    r = random.Random(2)
    for _ in range(300):
        spans = [(s := r.randrange(20), r.randrange(3), s + r.randrange(1, 8), r.random()) for _ in range(r.randrange(7))]
        spans = list({x[:3]: x for x in spans}.values())
        best = 0.0
        for bits in range(1 << len(spans)):
            part = sorted(x for i, x in enumerate(spans) if bits >> i & 1)
            if all(a[2] <= b[0] for a, b in zip(part, part[1:])):
                best = max(best, sum(x[3] for x in part))
        got = pii.reconcile(spans)
        assert all(a[2] <= b[0] for a, b in zip(got, got[1:])) and abs(sum(x[3] for x in spans if x[:3] in got) - best) < 1e-9


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_op4_base_counts_and_bands(spark):
    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        at: dict = {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        cover = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)

    r = random.Random(1)
    for _ in range(400):
        t = "".join(r.choice(["a", "b", " ", " ", "\n", "#", "a b a b ", "\x85", " ", "|", "<"]) for _ in range(r.randrange(150)))
        assert fertility.base_counts(t) == plain(t), t
    rows = fertility.measure(spark.read.parquet(f"{DATA}/documents.parquet")).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) for x in rows)
    assert all(x.kept for x in rows if x.quality == 1 and not x.base_failed)
    noise = "".join(chr(33 + i * 7 % 90) + (" " if i % 4 == 0 else "") for i in range(400))
    judged = [fertility._judge(t, fertility.vocabulary_path(), fertility.BANDS)[6] for t in (noise, "The river ran past the old mill and on to the sea, where boats lay waiting for the tide to turn and the wind to rise.")]
    assert judged == [False, True]
    assert [fertility.script_of(t) for t in ("abc", "привет", "日本", "123", "ばか")] == ["latin", "cyrillic", "han", "none", "kana"]


def test_op4_measures_are_those_of_a_plain_computation():
    import tiktoken

    f = fertility.Fertility.at(fertility.vocabulary_path())
    r = random.Random(7)
    for t in ["a", "日本語 тест 😀", *(" ".join(r.choice(["river", "Straße", "été", "😀", "日", "###", "\n", "x"]) for _ in range(r.randrange(1, 80))) for _ in range(60))]:
        ids = f.encoding.encode_ordinary(t)
        counts = [ids.count(i) for i in set(ids)]
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts) / math.log2(len(ids)) if len(ids) > 1 else 1.0
        partial = sum(not f.encoding.decode_single_token_bytes(i).decode("utf-8", "ignore") for i in ids)
        n, ratio, share, got = f.measures(t)
        assert n == len(ids) and abs(ratio - len(t) / len(ids)) < 1e-12 and abs(share - partial / len(ids)) < 1e-12 and abs(got - entropy) < 1e-9, t
    assert isinstance(f.encoding, tiktoken.Encoding) and f.measures("") == (0, None, None, None)


def test_op4_bands_by_language_then_by_script(spark):
    rows = [("xx", 3.0, 0.0, 0.9), ("xx", 3.2, 0.02, 0.8)] * 20 + [("yy", 1.0, 0.0, 0.5)] * 3
    bands = fertility.fitted_bands(rows)
    assert list(bands) == ["xx"] and bands["xx"].chars_per_token[0] == 2.8 and bands["xx"].entropy[0] == 0.7
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = fertility.measure(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    other = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 2 == 1]  # the half that the bands weren't set on
    clean, junk = [x.kept for x in other if x.quality == 1], [x.kept for x in other if x.quality == 0]
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) <= 0.6 * len(junk)
    text = "The river ran past the old mill and on to the sea, where boats lay waiting for the tide to turn and the wind to rise."
    assert fertility.in_band(text, 30, 2.0, 0.0, 0.9) and not fertility.in_band(text, 30, 2.0, 0.0, 0.9, lang="en")


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_op5_matches_its_sql_and_targets(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = table(spark, EDGE).union(docs)
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.curriculum_mix(clashing(extra)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(mixing.ORACLE).fetchall()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[4], x[5] or 0)
    assert sorted(map(tuple, mixing.op5_curriculum_mix(spark, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
    assert all((x.positions or [None])[0] == x.position and len(x.positions or []) == -(-x.taken // max(x["size"], 1)) for x in got)
    assert all(x.taken <= 3 * x["size"] for x in got)
    sums: dict = {}
    for x in got:
        sums.setdefault((x.source_size, x.target), []).append(x.taken)
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in sums.items() if len(v) > 1 and sum(k[1] == t for k in sums) == 1)
    assert abs(sum(t for _, t in sums) - sum(x["size"] for x in got)) < 1
    positions = [x.position for x in got if x.position is not None]
    assert positions == sorted(positions) and got == mixing.curriculum_mix(extra.repartition(7)).collect()
    mixed = mixing.mixed_documents(extra)
    assert mixed.select(F.sum(mixing.word_count("text"))).first()[0] == sum(x.taken for x in got)


def test_op5_each_pass_has_its_place_in_training(spark):
    size = {"a": 20, "b": 60, "c": 400}
    rows = [(1000 * k + i, "w " * (3 + i % 5), "en", s) for k, s in enumerate(size) for i in range(size[s])]
    docs = table(spark, rows)
    passes = mixing.training_passes(docs, carry=("source",)).collect()
    assert [x.position for x in passes] == sorted(x.position for x in passes) and max(x["pass"] for x in passes) == 3
    for s in size:
        own, done = [x for x in passes if x.source == s], 0
        for x in own:  # cumulative words follow F(t)
            t = x.position
            assert abs((done + x.words / 2) - ((1 - x.slope) * t + x.slope * t * t) * x.target) <= x["size"]
            done += x.words
        assert abs(done - own[0].target) <= 1
    mixed = mixing.mixed_documents(docs)
    again = sorted((x.doc_id, x.position) for x in mixing.positions(mixed.repartition(5)).collect())
    want = sorted((x.doc_id, x.position) for x in passes)
    assert [d for d, _ in again] == [d for d, _ in want] and all(abs(x - y) < 0.01 for (_, x), (_, y) in zip(again, want))  # a cut pass differs in its middle
    order = [x.doc_id for x in mixed.where("source = 'a'").collect()]
    assert len(order) == 60 and order[:20] == order[20:40] == order[40:] and len(set(order)) == 20


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_op6_links_what_brute_force_links(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(500)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(8)]
    rows = list(EDGE)
    for i in range(150):
        t = list(base[i % 8])
        for _ in range(i % 5):
            t[r.randrange(150)] = r.choice(words)
        rows.append((100 + i, " ".join(t), "en", "s"))
    rows = [x for x in rows if x[0] is not None]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    fp = np.array([x.fp for x in got], np.int64).view(np.uint64)
    assert {(x.doc_id, int(f)) for x, f in zip(got, fp)} == {(d, simhash.fingerprint(t)) for d, t, *_ in rows}
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    low = np.array([x.doc_id for x in got])
    while True:
        new = np.array([low[n].min() for n in near])
        if (new == low).all():
            break
        low = new
    assert [x.component_id for x in got] == low.tolist() and len(set(low)) < len(low)


def test_op6_fingerprints_are_those_of_64_counters():
    r = random.Random(9)
    for t in [None, "", " \n", "One", "a b", "a b c", "x\u00a0y z\x0bq  w"] + [" ".join(r.choice(["ab", "Ä", "Cd", "e"]) for _ in range(r.randrange(60))) for _ in range(60)]:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if w]
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(t) == want, t


def test_op6_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    r = np.random.default_rng(1)
    fp = np.unique((r.integers(0, 1 << 12, 600).astype(np.uint64) << np.uint64(32)) | np.uint64(7))
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3, 1))
    want = sorted(zip(*simhash.forest(a, b)))
    assert sorted(zip(*simhash._bucket_links(fp[:, None], np.arange(len(fp)), 3))) == want
    rows = spark.createDataFrame([(k, i, int(x)) for k in (5, 9) for i, x in enumerate(fp.view(np.int64).tolist())] + [(7, 3, 0)], "key long, node long, f0 long").repartition(6)
    for large in (50, 10_000):  # dealt out as blocks, and in one task
        got = np.array([tuple(x) for x in simhash.ball_links(rows, 3, 1, large).collect()]).T
        assert sorted(zip(*simhash.forest(got[0], got[1]))) == want


def jaccard_groups(texts, n=5, similarity=0.8):
    """Smallest index reachable over pairs of texts whose sets of n-word shingles are alike enough, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    low = list(range(len(sets)))
    near = [[j for j, y in enumerate(sets) if len(x & y) >= similarity * len(x | y)] for x in sets]
    while True:
        new = [min(low[j] for j in js) for js in near]
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("large, held", [(simhash.LARGE, simhash.HELD), (20, 12)])
def test_similar_texts_are_those_of_all_pairs(spark, monkeypatch, large, held):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 4000 if large == 20 else simhash.BLOCK_SHINGLES)
    r = random.Random(4)
    words = ["w%d" % i for i in range(800)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(12)]
    rows = [x for x in EDGE if x[0] is not None]
    for i in range(160):
        t = list(base[i % 12] if i % 5 else base[0])  # one large group
        for _ in range(i % 6):
            t[r.randrange(200)] = r.choice(words)
        rows.append((100 + i, " ".join(t), "en", "s"))
    got = sorted({(x.doc_id, x.component_id) for x in simhash.similar(clashing(table(spark, rows)).repartition(5), large=large, held=held).collect()})
    ids = sorted({d: t for d, t, *_ in rows}.items())
    low = jaccard_groups([t for _, t in ids])
    want = [(d, ids[low[i]][0]) for i, (d, _) in enumerate(ids)]
    assert sum(x == y for x, y in zip(got, want)) >= 0.97 * len(want) and len(got) == len(want)
    exact = {d: c for d, c in want}
    assert all(exact[d] == exact[c] for d, c in got)  # nothing is joined that all pairs don't join
    assert simhash.similar(table(spark, rows).where("false")).count() == 0 and simhash.similar(table(spark, [(None, "a b", "", "")])).first().component_id is None


def test_the_plan_for_similar_texts_holds_its_recall_and_its_size():
    for n in (2, 100, 10**5, 10**7, 10**9, 10**12):
        x = simhash.plan(n)
        assert x.parts << x.bits < 2**62 and x.top <= x.bits and x.total >= x.bits * x.parts and (x.top == x.bits or n * (1 + x.top) <= simhash.HELD << x.top)
        r = np.random.default_rng(0)
        p = math.acos(1.6 / 1.8) / math.pi
        differ = r.random((3000, x.total)) < p
        parts = differ[:, : x.parts * x.bits].reshape(3000, x.parts, x.bits)
        assert (parts.sum(2).min(1) <= 2).mean() >= simhash.RECALL - 0.02 and (differ.sum(1) <= x.radius).mean() > 0.99
        print(f"{n} texts: {x.bits} bits, {x.parts} parts, {x.rows} rows, {x.bytes} bytes shuffled a text")
    assert simhash.plan(13_300_000).bytes < 2 * 2200  # a document has 2.2 KB of input


@pytest.mark.parametrize("held, compared, piece", [(10**6, 10**9, 50_000), (10**6, 400, 7), (60, 10**9, 20)])
def test_parts_meet_where_their_balls_do(spark, monkeypatch, held, compared, piece):
    """Every pair that has a part with two differing bits or less, and not too many in all, is linked; nothing else is; whatever is dealt out."""
    monkeypatch.setattr(simhash, "SLICE", piece)
    monkeypatch.setattr(simhash, "COMPARED", compared)
    r = np.random.default_rng(1)
    for bits, parts, top in ((9, 3, 3), (9, 3, 0), (9, 3, 9), (40, 2, 4)):
        p = simhash.Plan(bits, parts, top, 128, 28)
        base = r.integers(0, 2**63, (30, 2), np.uint64)
        fp = base[r.integers(0, 30, 900) ** 2 // 31]  # one fingerprint has many neighbours
        for _ in range(14):
            fp[np.arange(900), r.integers(0, 2, 900)] ^= np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64)
        fp = np.unique(fp, axis=0)
        n = len(fp)
        near = np.zeros((n, n), bool)
        for k in range(parts):
            x = simhash.part_of(fp, k, bits)
            near |= np.bitwise_count(x[:, None] ^ x[None]) <= 2
        near &= simhash.distances(fp[:, None], fp[None]) <= 28
        want = sorted(zip(*simhash.forest(*np.nonzero(np.triu(near, 1)))))
        rows = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp.view(np.int64).tolist())], "node long, f0 long, f1 long").repartition(4)
        got = np.array([tuple(e) for e in simhash.part_links(rows, p, held, 50).collect()], np.int64).reshape(-1, 2).T
        assert len(want) > 20 and sorted(zip(*simhash.forest(got[0], got[1]))) == want


def test_op6_verified_links_by_search_are_those_of_all_pairs():
    r = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.unique(r.integers(0, 30, r.integers(1, 25)).astype(np.uint64)) for _ in range(25)]
        node = np.arange(25) * 7
        pairs = [(i, j) for i in range(25) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])) - 1e-9]
        want = simhash.forest(node[[i for i, _ in pairs]], node[[j for _, j in pairs]]) if pairs else ((), ())
        assert sorted(zip(*simhash.verified(node, sets, 0.5))) == sorted(zip(*want))


# --- 7, 8 ---------------------------------------------------------------------------------------------------------


def held_out_scores(spark, query, label, modulus, fold, d):
    """(label, score, lang) of the labelled rows of the held-out fold."""
    labels = {x.doc_id: x[label] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = query(spark, d).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % modulus == fold) for x in got)
    return [(labels[x.doc_id], x.score, lang[x.doc_id]) for x in got if x.held_out and x.doc_id in labels]


def test_op7_finds_held_out_toxic_texts_of_every_language(spark):
    rows = held_out_scores(spark, toxicity.op7_subsequence_svm, "toxic", 4, 2, "/root/testdata/sf0.1")
    hit = lambda xs: sum(s >= toxicity.THRESHOLD for y, s, _ in xs if y) / max(1, sum(y for y, _, _ in xs))
    assert hit(rows) >= 0.85 and all(hit([x for x in rows if x[2] == lang]) >= 0.85 for lang in ("en", "de", "fr", "es"))
    flagged = [y for y, s, _ in rows if s >= toxicity.THRESHOLD]
    assert sum(flagged) >= 0.9 * len(flagged)


def test_op7_disguised_insults(spark):
    d = "/root/testdata/sf0.1"
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), 4, 2)
    p = lambda texts: model.probability(toxicity.text_features(model, texts, {})) >= 0.3
    assert p(["you are an idiot", "what an i.d.i.o.t", "i d i o t you", "a stuupid idea", "you IDIOT!!"]).all()
    assert not p(["", "12 34", "the sea and the wind", "a kind and lovely day"]).any()


def test_op7_the_kernel_is_that_of_enumerated_subsequences():
    words = ["idiot", "i.d.i.o.t", "ab", "a", "réeuxé", "бездельник", "x" * 30, "日本語"]

    def plain(w):
        letters = ["^", *(c for c in w if c.isalpha())]
        out: dict = {}
        for i, j, k in itertools.combinations(range(len(letters)), 3):
            if j - i <= toxicity.GAP + 1 and k - j <= toxicity.GAP + 1:
                key = tuple(letters[x] for x in (i, j, k))
                out[key] = out.get(key, 0) + toxicity.LAMBDA ** (k - i - 2)
        return out

    def norm(w):  # each place of a subsequence by itself
        letters = 1 + sum(c.isalpha() for c in w)
        gaps = [(j - i, k - j) for i, j, k in itertools.combinations(range(letters), 3)]
        return max(sum(toxicity.LAMBDA ** (2 * (g + h - 2)) for g, h in gaps if max(g, h) <= toxicity.GAP + 1) ** 0.5, 1e-9)

    f = toxicity.phi(words)
    assert len({int(toxicity._CODE[ord(c)]) for c in "рабочий"}) > 1
    for i, a in enumerate(words[:5]):
        for j, b in enumerate(words[:5]):
            x, y = plain(a), plain(b)
            want = sum(v * y.get(k, 0) for k, v in x.items()) / norm(a) / norm(b)
            assert abs(float(f[i] @ f[j]) - want) < 1e-3, (a, b)
    r = np.random.default_rng(0)
    table = r.normal(size=toxicity.TABLE).astype(np.float32)
    assert np.allclose(toxicity.applied(table, words), f @ table, atol=1e-3)
    assert np.allclose(toxicity.applied(np.stack([table, 2 * table], 1), words)[:, 1], 2 * (f @ table), atol=1e-3)
    long = toxicity.applied(table, ["a" * 20 + "idiot" + "b" * 400])  # words over WIDTH in windows that overlap
    assert np.isfinite(long).all()


def test_op7_parts_against_plain_versions():
    share, n = 0.2, 12
    for k in range(n + 1):
        assert abs(np.exp(toxicity.log_tail(k, n, share)) - sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, n + 1))) < 1e-9
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 3)), np.where(r.random(80) < 0.5, 1.0, -1.0)
    x[y > 0] += 1
    weight = np.ones(80)
    w, b = toxicity.svm(x, y, weight)
    loss = lambda w, b: toxicity.PENALTY * (w @ w) + (np.maximum(0, 1 - y * (x @ w + b)) ** 2).mean()
    least = loss(w, b)
    for _ in range(200):
        assert loss(w + r.normal(size=3) * 0.05, b + r.normal() * 0.05) >= least - 1e-6
    p, t = np.array([0.1, 0.4, 0.5, 0.9, 0.95]), np.array([0, 0, 1, 1, 1])
    assert 0.4 < toxicity.best_cut(p, t) <= 0.5


def test_op8_held_out_texts(spark):
    rows = held_out_scores(spark, ranking.op8_bradley_terry, "quality", 3, 1, "/root/testdata/sf0.01")
    assert np.mean([(s >= 0.5) == y for y, s, _ in rows]) >= 0.95


def test_op8_newton_finds_what_gradient_descent_finds():
    d = np.random.default_rng(3).normal(size=(60, 4)) + 0.3
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.01 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) + ranking.PENALTY * w)
    assert np.allclose(ranking.prefer(d), w, atol=1e-6)
    x = np.zeros((40, len(ranking.FEATURES)))
    x[:, 0] = np.arange(40)
    model = ranking.fit(x, (np.arange(40) >= 25).astype(int))
    assert ((model.probability(x) >= 0.5) == (np.arange(40) >= 25)).mean() >= 0.9  # the steps are quantiles, so not every place is one
    assert abs(model.quantile - 25 / 40) < 0.11


CLASSIFIERS = ((toxicity, toxicity.op7_subsequence_svm, "toxic"), (ranking, ranking.op8_bradley_terry, "quality"))


@pytest.mark.parametrize("module,query,label", CLASSIFIERS)
def test_classifiers_as_queries_on_edge_tables(spark, tmp_path, module, query, label):
    docs = [*EDGE, *((100 + i, "you idiot " * (i % 3) + f"text {i}", "en", "s") for i in range(40))]
    labels = [(r[0], i % 2, i % 3 == 0, "x") for i, r in enumerate(docs)] + [(None, 1, 1, "x"), (3, None, None, "x"), (100, 0, 1, "x")]
    sets = {"some": (docs, labels), "nolabels": (docs, []), "one": (docs, [(r[0], 1, 1, "x") for r in docs]), "empty": ([], [])}
    for name, (d, y) in sets.items():
        at = f"{tmp_path}/{name}"
        clashing(table(spark, d)).write.parquet(f"{at}/documents.parquet")
        frame = spark.createDataFrame([(a, int(b) if b is not None else None, int(c) if c is not None else None, t) for a, b, c, t in y], "doc_id long, quality int, toxic int, text string")
        frame.write.parquet(f"{at}/labels.parquet")
        got = query(spark, at).collect()
        assert len(got) == len(d) and all(0 <= x.score <= 1 and x.predicted in (0, 1) for x in got)
        assert len({x.score for x in got}) <= 1 or name == "some"


def test_labels_of_the_held_out_fold_are_not_learnt_from(spark):
    docs = table(spark, [(i, f"text {i}", "en", "s") for i in range(40)] + [(0, "another", "en", "s")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = labelled.examples(docs, labels, "quality", 3, 1).collect()
    assert sorted(x.doc_id for x in rows) == [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1] and all(x.y == x.doc_id % 2 for x in rows)
    assert labelled.examples(docs, labels, "quality", 3, 1, max_rows=5).count() == 5


# --- 9 ------------------------------------------------------------------------------------------------------------


def test_op9_round_trips_and_the_best_path(spark):
    p = pieces.Pieces.at(pieces.model_path())

    def brute(s):
        """Viterbi over the whole text, no window."""
        chars = list(p._chars(s))
        best, back = [0.0], [(0, None)]
        for e in range(1, len(chars) + 1):
            top, at = best[e - 1] + p.by_bytes * len(chars[e - 1]), (e - 1, None)
            for k in range(1, p.longest + 1):
                if k > e or any(len(c) > 1 for c in chars[e - k : e]):
                    break
                w = "".join(chars[e - k : e])
                if w in p.score and best[e - k] + p.score[w] > top:
                    top, at = best[e - k] + p.score[w], (e - k, w)
            best.append(top)
            back.append(at)
        ids, e = [], len(chars)
        while e:
            start, w = back[e]
            ids = ([p.id_of[w]] if w else [p.bytes[b] for b in chars[start][0].encode()]) + ids
            e = start
        return ids

    r = random.Random(1)
    texts = ["".join(r.choice("abthe  erin▁é漢\n😀x,.") for _ in range(r.randrange(150))) for _ in range(200)]
    texts += [x.text[:300] for x in spark.read.parquet(f"{DATA}/documents.parquet").limit(30).collect()]
    for t in texts:
        ids = p.encode(t)
        assert p.decode(ids) == t and ids == (brute(" " + t) if t else []) == (p.stream(p._chars(" " + t)) if t else []), t
    assert all(x.exact for x in pieces.round_trips(spark.read.parquet(f"{DATA}/documents.parquet")).collect())
    again = {x.doc_id: x.text for x in pieces.decode(pieces.encode(spark.read.parquet(f"{DATA}/documents.parquet"))).collect()}
    assert again == {x.doc_id: x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op9_commits_where_paths_meet_and_keeps_a_small_window(spark):
    p = pieces.Pieces.at(pieces.model_path())
    for text in ("internationalisation" * 3000, "x" * 20_000, "▁the▁old▁mill" * 500):
        commits: list = []
        ids = p.stream(text, commits)
        assert commits[-1] == len(text) and max(np.diff([0, *commits])) <= 4 * p.longest
        done, at = [], 0
        for i in ids:  # a commit is a boundary between ids
            done.append(at := at + len(p.piece[i]))
        assert set(commits) <= set(done)
        assert all(ids[: done.index(c) + 1] == p.stream(text[:c] + text[c : c + 40])[: done.index(c) + 1] for c in commits[:20])
    text = "".join(random.Random(3).choice("the an in of stone river ") for _ in range(3000))
    commits = []
    p.stream(p._chars(text), commits)
    spaces = {i for i in range(1, len(text)) if text[i] == " " and text[i - 1] != " "}
    assert spaces <= set(commits)  # all paths meet before a space


def test_op9_needs_about_as_many_ids_as_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    p, library = pieces.Pieces.at(pieces.model_path()), SentencePieceProcessor(model_file=pieces.model_path())
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ours, theirs = sum(len(p.encode(t)) for t in texts), sum(map(len, library.encode(texts)))
    assert abs(ours / theirs - 1) < 0.02
    assert [p.piece[i] for i in p.encode("internationalisation")] == library.encode("internationalisation", out_type=str)


# --- 10 -----------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="main-menu"><ul><li><a>x</a></ul></div><main><article class="post"><header><h1>T &amp; U</h1></header>
<p>one<br>two <b>b</b>&nbsp;&lt;x&gt;<p>three<div class="share-buttons">share</div><ul><li>a<li>b</ul><section id="comments"><p>bad</p></section></article></main><aside>s</aside><div class="cookie-notice">c</div><form>f</form><script>if(a<b)"</p>"</script></body></html>"""


def test_op10_main_text(spark):
    assert html.main_text(PAGE) == "T & U\n\none two b <x>\n\nthree\n\na\n\nb"
    assert html.main_text("") == "" and html.main_text("<p>a <!-- x --> b<p>c <di") == "a b\n\nc"
    body = lambda i, box: f"<html><body><div><span>Our shop, est. 1900</span></div><p>story {i} of many</p><p>{'x ' * i}</p>{box}</body></html>"
    rows = [(i, f"https://h.example/{i}", body(i, "<div><div>Buy now</div></div>")) for i in range(1, 9)] + [(9, None, None), (10, "https://g.example/", body(3, "")), (11, "https://g.example/a", ""), (8, "https://h.example/8", body(8, "<div><div>Buy now</div></div>"))]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((x.page_id, x.text) for x in html.extract(pages).collect())
    assert got == sorted((x.page_id, x.text) for x in html.extract(pages, broadcast=0).collect())
    assert dict(got)[3] == "story 3 of many\n\nx x x" and dict(got)[10].startswith("Our shop") and dict(got)[9] == ""
    assert html.extract(pages.where("false")).count() == 0


def test_op10_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div><p>A long story that is copied.</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"https://h.example/{i}", page) for i in range(20)], "page_id long, url string, html string")
    assert {x.text for x in html.extract(pages).collect()} == {"A long story that is copied."}


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>%s</div>", "<div class='no-sidebar'><div id='share'>%s</div></div>", "<form id='aspnetForm'>%s</form>", "<div role='search'>%s</div>"])
def test_op10_what_holds_the_article_stays(wrap):
    side = "<div class='sidebar'>menu</div><div class='related'><article>Next one</article></div><form>find</form><div class='comments'><article class='comment'>me too</article></div>"
    story = "<p>A story of several words that is the page.</p>"
    want = "A story of several words that is the page."
    for tag in ("<article>%s</article>", "<main>%s</main>", "<div role='main'>%s</div>", "<div role='article' class='widget'>%s</div>"):
        assert html.main_text(f"<html><body>{wrap % (tag % story)}{side}</body></html>") == want
    assert html.main_text(f"<html><body><article>{story}</article><div hidden class='menu'><article>x</article></div></body></html>") == want
    assert html.main_text(f"<html><body>{wrap % story}<div class='sidebar'>menu</div></body></html>") == want


def test_op10_cut_and_long_pages_take_one_pass():
    began = time.time()
    assert html.main_text("<p>a</p><a " + 'x="y" ' * 170_000) == "a"
    assert html.main_text("<p>a</p>" + "<a " * 300_000) == "a"
    assert html.main_text("<p>b</p><i x=\"" + "'> " * 300_000).startswith("b")
    assert html.main_text("<p>" + "<b>x</b> " * 60_000).count("x") == 60_000
    assert len(html.main_text("<div>" * 50_000 + "deep")) == 4
    assert html.main_text("<p>1 < 2 <3 <!bad> <?pi?> <![CDATA[x]]> <!-- cut") == "1 < 2 <3 x"
    assert time.time() - began < 12


def plain_templates(rows):
    """Hashes by place that recur enough, counted in plain Python: host -> set of (hash, place)."""
    on: dict = {}
    articles: dict = {}
    for _, url, page in rows:
        host, text = html.host_of(url), html.main_text(page or "")
        articles.setdefault(host, set()).add(text)
        root = html.parse(page or "")
        parents = {id(x): n for n in html.nodes_of(root) for x in n.parts if isinstance(x, html.Node)}
        for n, where, h in html.candidates(root):
            told = [x for x in parents[id(n)].parts if isinstance(x, html.Node) or x.strip()]
            first, last = on.setdefault((host, h, where), {}).get(text, (True, True))
            on[host, h, where][text] = (first and told[0] is n, last and told[-1] is n)
    out = set()
    for (host, h, where), texts in on.items():
        n, pages = len(texts), len(articles[host])
        many = lambda share, least: n >= max(least, math.ceil(round(share * pages, 6)))  # noqa: B023, E731
        edge = max(sum(e[k] for e in texts.values()) for k in (0, 1)) >= html.EDGE_PLACES * n
        if where == html.OUTER:
            fits = n >= html.MANY_PAGES or many(html.OUTER_SHARE, html.LEAST_PAGES)
        elif where == html.INNER:
            fits = many(html.INNER_SHARE, html.LEAST_PAGES) or edge and many(html.EDGE_SHARE, html.MANY_PAGES)
        else:
            fits = many(html.PROSE_SHARE, html.PROSE_PAGES)
        if n >= html.LEAST_PAGES and fits:
            out.add((host, h - 2**63, where))
    return out


@pytest.mark.parametrize("inner", ["<h1 class='page-header'>%s</h1>", "<div class='ad-hoc-analysis'>%s</div>", "<section class='related-work'>%s</section>", "<div class='share-price'>%s</div>", "<p id='notice-period'>%s</p>", "<div class='menu-of-the-day note'>%s</div>"])
def test_op10_names_inside_an_article_count_as_wholes(inner):
    assert html.main_text(f"<html><body><article><p>one</p>{inner % 'the point'}</article></body></html>") == "one\n\nthe point"
    for gone in ("ad", "ad-box", "cookie-notice", "share_buttons", "x comments"):
        assert html.main_text(f"<html><body><article><p>one</p><div class='{gone}'>away</div></article></body></html>") == "one"


def test_op10_boxes_that_a_few_articles_of_a_large_host_share_are_theirs(spark):
    r = random.Random(8)
    words = lambda n: " ".join(f"{r.choice(['sea', 'wind', 'boat'])}{r.randrange(9999)}" for _ in range(n))
    code, advert, note = "<div class='code'><pre>pip install numpy</pre></div>", "<div><span>Buy the mug</span></div>", "<div><em>In our series: tea</em></div>"
    rows = []
    for i in range(300):
        story = [f"<p>{words(9)}</p>" for _ in range(4)]
        story.insert(r.randrange(1, 4), code * (i < 15))
        story.insert(r.randrange(1, 4), note * (30 <= i < 110))  # on a quarter of the articles, anywhere
        rows.append((i, f"https://big.example/{i}", f"<html><body><article>{advert * (100 < i < 160)}{''.join(story)}</article></body></html>"))
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("pip install numpy" in got[i] for i in range(15)) and all("In our series" in got[i] for i in range(30, 110))
    assert not any("Buy the mug" in t for t in got.values())  # a fifth of the articles, always first


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</p>" * 90_000, "<b>" * 90_000 + "<div></div>" * 90_000, "<script>" + "</script x" * 100_000, "<p><x>" + "<b>" * 90_000 + "<div></div>" * 90_000, "<div>" * 90_000 + "<li></li>" * 90_000, "<div>" * 90_000 + "</i><td>" * 50_000, "<i>" * 90_000 + "</u>" * 90_000])
def test_op10_stray_and_open_tags_take_one_pass(page):
    began = time.time()
    html.main_text(page + "<p>end</p>")
    assert time.time() - began < 8 and len(page) > 600_000


def test_op10_templates_are_those_that_a_plain_count_finds_and_they_change_pages(spark):
    r = random.Random(6)
    words = lambda n: " ".join(r.choice(["sea", "wind", "boat", "hill", "town", "bread", "stone"]) + str(r.randrange(90)) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        host = "abc"[i % 3] + ".example"
        story = [words(12) for _ in range(3)]
        box = "<section><p>More from us: tea, cups</p></section>" if i % 2 else ""
        note = "<p>All rights reserved by the site.</p>" if host[0] == "a" else ""
        menu = "<div><span>Start</span> <span>Prices</span></div>"
        mark = ("<article>%s</article>" if i % 4 else "<div>%s</div>") % ("".join(f"<p>{x}</p>" for x in story[:2]) + box + f"<p>{story[2]}</p>" + note)
        rows.append((i, f"https://{host}/{i}", f"<html><body>{menu}{mark}<div>Imprint of the house</div></body></html>"))
        want[i] = "\n\n".join(story)
    rows += [(100 + i, f"https://d.example/{i}", rows[0][2]) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {tuple(x) for x in html.templates(pages).collect()} == plain_templates(rows)
    got = {x.page_id: x.text for x in html.extract(pages).collect()}
    assert {i: got[i] for i in want} == want  # menus, boxes and notices without any telling name are gone
    assert sum(got[i] != html.main_text(page) for i, _, page in rows) >= 45
    assert {got[100 + i] for i in range(30)} == {html.main_text(rows[0][2])}  # one article under many addresses is no template
    real = [tuple(x) for x in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    assert {tuple(x) for x in html.templates(spark.read.parquet(f"{DATA}/pages.parquet")).collect()} == plain_templates(real)
