"""Exact-substring dedup over suffixes, one bucket at a time, ties resolved by difference-cover ranks.

A byte is removed if it is covered by a WINDOW-byte string that also starts earlier: in a document of smaller doc_id, or before in the
same one. Suffixes matter only to WINDOW bytes and never cross documents.

1. Buckets. Shipping all suffixes would be WINDOW times the text. Every window is put in the bucket of one GRAM-byte string
   inside it, the least under a fixed order of strings; equal windows choose the same string at the same place. The windows that choose one
   occurrence are neighbours and form a block: their common stretch of text. Only the blocks' hashes are shuffled.
   The order puts strings that a bounded sample of documents has often last (any order is right), so a common passage is chosen by
   windows wholly inside it, whose blocks are alike wherever it stands.
2. Equal blocks of a bucket are copies: all but the first are removed as a whole. Blocks that one Python batch has twice are
   settled there, before the shuffle, so a passage in a third of all documents is one row a batch.
3. Buckets that have different blocks are sorted suffix by suffix, one bucket at a time. Texts of those blocks are fetched. For the
   positions of a difference cover modulo PERIOD, lexicographic ranks of the LONG bytes that follow are computed once. Two windows
   have, within PERIOD bytes, an offset at which both are on the cover; at every such offset the windows are sorted by the bytes
   before it, then by the rank there, which settles ties of any length at once, then by the few bytes after it. So no
   comparison reads more than PERIOD bytes and a rank, and equality is that of bytes. Buckets over LARGE blocks are
   dealt out by window in Spark (names of 128 bits), as one task could not hold them.

Rows are told apart by doc_id and, in tables where rows share a doc_id, by a hash of their text, which also orders such rows.

Cases. Null text is an empty text; documents under WINDOW bytes lose nothing. Texts of any length are read whole, in overlapping
segments. A null doc_id sorts before all others. Rows of one doc_id (or none) and different texts are different documents, the
one with the smaller hash of its text first; rows alike in both each get that document's result. Empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, few, stored

WINDOW = 100
GRAM = 32
SPREAD = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
CHUNK = 2 << 20  # bytes hashed at once; longer texts are read in segments
PERIOD = 8
LONG = WINDOW - PERIOD + 1
LARGE = 20_000
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
COMMON_BITS = 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def substring_hashes(prefix: np.ndarray, start, end) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, down = _power(len(prefix))
    return _mix((prefix[end] - prefix[start]) * down[start])


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` values; len(x) - width + 1 results."""
    have, y = 1, x
    while 2 * have <= width:
        y = f(y[: len(y) - have], y[have:])
        have *= 2
    rest = width - have
    return f(y[: len(y) - rest], y[rest:]) if rest else y


def blocks(data: np.ndarray, starts: np.ndarray, common: np.ndarray | None):
    """data: segments one after another, starts: their bounds. Returns for each block: bucket, hash, position of its
    string, start, end (all in data)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none
    prefix = prefix_hashes(data)
    _, down = _power(n + 1)
    grams = _mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    order = (grams >> np.uint64(1)) | np.uint64(1)
    if common is not None:
        order |= common[grams & np.uint64((1 << COMMON_BITS) - 1)].astype(np.uint64) << np.uint64(63)
    least = _slide(order, SPREAD, np.minimum)  # of the strings of each window; n - WINDOW + 1
    valid = np.ones(n - WINDOW + 1, bool)
    for b in starts[1:-1]:  # windows that cross a segment's end
        valid[max(0, b - WINDOW + 1) : b] = False
    least[~valid] = 0
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, SPREAD, np.maximum) == order)
    first, last = np.empty(len(chosen), np.int64), np.empty(len(chosen), np.int64)
    for at in range(0, len(chosen), 50_000):
        p = chosen[at : at + 50_000]
        mine = padded[p[:, None] + np.arange(SPREAD)] == order[p][:, None]
        first[at : at + 50_000] = p - (SPREAD - 1) + mine.argmax(1)
        last[at : at + 50_000] = p - mine[:, ::-1].argmax(1)
    end = last + WINDOW
    whole = substring_hashes(prefix, first, end) ^ _mix(((chosen - first) * 1000 + end - first).astype(np.uint64))
    return grams[chosen].view(np.int64), whole.view(np.int64), chosen, first, end


def common_strings(texts: list[str], share: float = 0.003, least: int = 4) -> np.ndarray:
    """A fixed-size table over string hashes: 1 for those that many of the sample's texts have."""
    out = np.zeros(1 << COMMON_BITS, np.uint8)
    seen = []
    for t in texts:
        data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) >= GRAM:
            prefix = prefix_hashes(data)
            at = np.arange(len(data) - GRAM + 1)
            seen.append(np.unique(substring_hashes(prefix, at, at + GRAM) & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64))
    if seen:
        count = np.bincount(np.concatenate(seen), minlength=len(out))
        out[count >= max(least, share * len(texts))] = 1
    return out


def _segments(b: pa.RecordBatch):
    """Texts (the last column): (rows, bases, bytes, bounds) of chunks of about CHUNK bytes; long texts in segments that overlap by a window."""
    column = b.column(b.num_columns - 1).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    rows, bases, parts, size = [], [], [], 0
    for r in range(len(column)):
        s, e = int(offsets[r]), int(offsets[r + 1])
        for at in range(s, max(s + 1, e - WINDOW + 1), CHUNK):
            if e - at < WINDOW:
                continue
            part = data[at : min(e, at + CHUNK + WINDOW - 1)]
            rows.append(r)
            bases.append(at - s)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(rows), np.array(bases), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                rows, bases, parts, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(bases), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _packed(place, left, span):
    return (place << 16) | (left << 8) | span


def _run(start, length):
    return -1 - ((start << 31) | length)


def merged(start: np.ndarray, end: np.ndarray):
    """Maximal runs of intervals; runs that touch are one."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]


def _scan(common: np.ndarray):
    """doc, tie, text -> bucket, hash, doc, tie, at: a block at its place; or, with at < 0, a run that the batch knows to be removed."""
    names = ["bucket", "hash", "doc", "tie", "at"]

    def run(batches):
        for b in batches:
            ids, ties = b.column(0).to_numpy(), b.column(1).to_numpy()
            g_, h_, r_, p_, l_, s_ = [], [], [], [], [], []
            for rows, bases, data, bounds in _segments(b):
                g, h, p, first, end = blocks(data, bounds, common)
                seg = np.searchsorted(bounds, p, side="right") - 1
                g_.append(g)
                h_.append(h)
                r_.append(rows[seg])
                p_.append(p - bounds[seg] + bases[seg])
                l_.append(p - first)
                s_.append(end - first)
            if not g_:
                continue
            g, h, r, p, left, span = map(np.concatenate, (g_, h_, r_, p_, l_, s_))
            d, t = ids[r], ties[r]
            o = np.lexsort((p, t, d, h, g))
            g, h, d, t, p, left, span = (x[o] for x in (g, h, d, t, p, left, span))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            other = np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
            again = ~new & other  # a row given twice is no copy of itself
            out = [[g[new]], [h[new]], [d[new]], [t[new]], [_packed(p[new], left[new], span[new])]]
            if again.any():
                da, ta, sa, ea = d[again], t[again], p[again] - left[again], p[again] - left[again] + span[again]
                o = np.lexsort((ta, da))
                da, ta, sa, ea = da[o], ta[o], sa[o], ea[o]
                cuts = [0, *(np.flatnonzero((np.diff(da) != 0) | (np.diff(ta) != 0)) + 1), len(da)]
                for s, e in zip(cuts, cuts[1:]):
                    rs, re = merged(sa[s:e], ea[s:e])
                    bucket = _mix(np.full(len(rs), da[s], np.int64).view(np.uint64) + rs.astype(np.uint64)).view(np.int64)
                    for x, y in zip(out, (bucket, np.zeros(len(rs), np.int64), np.full(len(rs), da[s]), np.full(len(rs), ta[s]), _run(rs, re - rs))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return run


def _settle(batches):
    """Rows sorted by bucket, hash, doc, tie, at -> bucket (null for a run to remove), doc, tie, at: runs, and the first of every
    different block of buckets that have several. Keeps one row between batches."""
    state = None  # the first row of the last block, and whether it has been given out

    def out(bucket, doc, tie, at, run):
        return pa.RecordBatch.from_arrays([pa.array(bucket, mask=run), pa.array(doc), pa.array(tie), pa.array(at)], names=["bucket", "doc", "tie", "at"])

    for b in batches:
        g, h, d, t, at = (b.column(i).to_numpy() for i in range(5))
        runs = at < 0
        if runs.any():
            yield out(g[runs], d[runs], t[runs], at[runs], np.ones(int(runs.sum()), bool))
            g, h, d, t, at = (x[~runs] for x in (g, h, d, t, at))
        if not len(g):
            continue
        given = False
        if state is not None:
            g, h, d, t, at = (np.concatenate([[s], x]) for s, x in zip(state[:5], (g, h, d, t, at)))
            given = state[5]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        heads = np.flatnonzero(new)
        again = ~new
        # the same place as the block's first row: a row given twice
        head = heads[np.cumsum(new) - 1]
        again &= (d != d[head]) | (t != t[head]) | (at >> 16 != at[head] >> 16)
        p, left, span = at >> 16, (at >> 8) & 255, at & 255
        same = np.zeros(len(heads), bool)
        same[1:] = g[heads[1:]] == g[heads[:-1]]
        several = same | np.concatenate([same[1:], [False]])
        if given:
            several[0] = False
        ask = heads[several]
        take = np.flatnonzero(again)
        both = np.concatenate([take, ask])
        yield out(g[both], d[both], t[both], np.concatenate([_run((p - left)[take], span[take]), at[ask]]), np.arange(len(both)) < len(take))
        k = heads[-1]
        state = g[k], h[k], d[k], t[k], at[k], bool(several[-1]) or (given and len(heads) == 1)


def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one of two of them; greedily, the smallest first."""
    cover, have = [0], {0}
    while len(have) < v:
        best = max(range(v), key=lambda x: (len(have | {(x - c) % v for c in cover} | {(c - x) % v for c in cover}), -x))
        have |= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


_COVER = np.array(difference_cover(PERIOD))


def sample_ranks(data: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Lexicographic ranks of the LONG bytes at each sampled position; equal strings have equal ranks."""
    strings = np.lib.stride_tricks.sliding_window_view(data, LONG)[sampled]
    padded = np.zeros((len(sampled), -(-LONG // 8) * 8), np.uint8)
    padded[:, :LONG] = strings
    words = padded.view(">u8").astype(np.uint64)
    rank = np.zeros(len(sampled), np.int64)  # of the bytes so far
    open_ = np.arange(len(sampled))  # those whose rank is not theirs alone
    for k in range(words.shape[1]):
        o = open_[np.lexsort((words[open_, k], rank[open_]))]
        differ = (rank[o][1:] != rank[o][:-1]) | (words[o, k][1:] != words[o, k][:-1])
        start = np.concatenate([[True], differ])
        group = np.concatenate([[True], rank[o][1:] != rank[o][:-1]])
        # a rank is the number of smaller strings, so ranks of one group stay below those of the next
        base = np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[o] += np.flatnonzero(start)[np.cumsum(start) - 1] - base
        alone = start & np.concatenate([start[1:], [True]])
        open_ = o[~alone]
        if not len(open_):
            break
    return rank


def _bytes_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes at each position (n below 8) as a number, so that numbers sort as the bytes do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def repeated(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the windows at ``starts`` in data, which equal one that is earlier by (doc, tie, place)."""
    in_cover = np.zeros(PERIOD, bool)
    in_cover[_COVER] = True
    needed = np.zeros(len(data), bool)  # the cover's positions that some window looks at
    for shift in range(PERIOD):
        at = starts + shift
        needed[at[in_cover[at % PERIOD]]] = True
    sampled = np.flatnonzero(needed)
    rank = np.zeros(len(data) + 1, np.int64)
    if len(sampled):
        rank[sampled] = sample_ranks(data, sampled)
    o = np.lexsort((place, tie, doc))
    # windows of one place and document are the same window
    first = np.ones(len(o), bool)
    for x in (doc, tie, place):
        x = x[o]
        first[1:] &= x[1:] == x[:-1]
    first[1:] = ~first[1:]
    number = np.empty(len(o), np.int64)
    number[o] = np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.zeros(len(starts), bool)
    for shift in range(PERIOD):
        mine = np.flatnonzero(in_cover[(starts + shift) % PERIOD])
        if not len(mine):
            continue
        s = starts[mine]
        # the bytes before the cover's position, the rank there, and the bytes after the ranked ones
        keys = _bytes_at(data, s, shift), rank[s + shift], _bytes_at(data, s + shift + LONG, PERIOD - 1 - shift)
        o = np.lexsort((number[mine], *keys[::-1]))
        new = np.zeros(len(o), bool)
        new[0] = True
        for k in keys:
            k = k[o]
            new[1:] |= k[1:] != k[:-1]
        n = number[mine][o]
        out[mine[o]] |= n > n[new][np.cumsum(new) - 1]
    return out


def _fetch(batches):
    """doc, tie, text, asked -> bucket, doc, tie, at, bytes of the asked blocks."""
    for b in batches:
        columns: list[list] = [[] for _ in range(5)]
        for d, t, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
            data = (text or "").encode("utf-8", "surrogatepass")
            for x in asked:
                p, left, span = x["at"] >> 16, (x["at"] >> 8) & 255, x["at"] & 255
                piece = data[p - left : p - left + span]
                if len(piece) == span:
                    for c, v in zip(columns, (x["bucket"], d, t, x["at"], piece)):
                        c.append(v)
        types = (*[pa.int64()] * 4, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "doc", "tie", "at", "piece"])


def _windows(at: np.ndarray, pieces: list[bytes], *keys: np.ndarray):
    """All windows of the pieces: data, start in it, place in the document, then the keys of each window's piece."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = size - WINDOW + 1
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = (at >> 16) - ((at >> 8) & 255)
    return data, np.repeat(base, n) + inside, np.repeat(place, n) + inside, *(np.repeat(k, n) for k in keys)


def _sort_buckets(batches):
    """Blocks sorted by bucket -> doc, tie, at: runs to remove. Whole buckets are sorted, several small ones together."""
    held = None

    def flush(bucket, doc, tie, at, pieces):
        data, starts, place, d, t = _windows(at, pieces, doc, tie)
        hit = repeated(data, starts, d, t, place)
        d, t, place = d[hit], t[hit], place[hit]
        o = np.lexsort((place, t, d))
        d, t, place = d[o], t[o], place[o]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (place[1:] > place[:-1] + WINDOW)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(d) - 1]]) if len(d) else first
        runs = _run(place[first], place[last] + WINDOW - place[first])
        return pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(t[first]), pa.array(runs)], names=["doc", "tie", "at"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [*(b.column(i).to_numpy() for i in range(4)), b.column(4).to_pylist()]
        if held is not None:
            rows = [*(np.concatenate([x, y]) for x, y in zip(held[:4], rows[:4])), held[4] + rows[4]]
        bucket = rows[0]
        ends = np.flatnonzero(np.diff(bucket)) + 1
        at = 0
        while len(ends) and len(bucket) - at > 4000:
            e = int(ends[min(np.searchsorted(ends, at + 4000), len(ends) - 1)])
            if e <= at:
                break
            yield flush(*(x[at:e] for x in rows))
            at = e
        held = [x[at:] for x in rows]
    if held is not None and len(held[0]):
        yield flush(*held)


def _window_rows(batches):
    """Blocks of large buckets (doc, tie, at, piece) -> name, doc, tie, place of each window; names are 128 bits."""
    for b in batches:
        for s in range(0, b.num_rows, 2000):
            part = b.slice(s, 2000)
            data, starts, place, d, t = _windows(part.column(2).to_numpy(), part.column(3).to_pylist(), part.column(0).to_numpy(), part.column(1).to_numpy())
            prefix = prefix_hashes(data)
            one, two = substring_hashes(prefix, starts, starts + WINDOW), substring_hashes(prefix, starts, starts + WINDOW // 2)
            columns = one.view(np.int64), two.view(np.int64), d, t, place
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "doc", "tie", "place"])


def _clean(batches):
    """doc_id, text, ats -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    for b in batches:
        rows = []
        for text, ats in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = (text or "").encode("utf-8", "surrogatepass")
            spans = []
            if ats:
                x = -1 - np.array(ats, np.int64)
                s, e = merged(x >> 31, np.minimum((x >> 31) + (x & 0x7FFFFFFF), len(data)))
                spans = [(int(i), int(j)) for i, j in zip(s, e) if i < j]
            h, end = hashlib.sha256(), 0
            for i, j in spans:
                h.update(data[end:i])
                end = j
            h.update(data[end:])
            rows.append((len(data), sum(j - i for i, j in spans), len(spans), h.hexdigest(), [{"start": i, "end": j} for i, j in spans]))
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc, tie, text: doc and tie tell documents apart and order them. tie is 0 unless rows share a doc_id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63))))
    shared = base.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    return base.select("doc_id", "doc", (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("tie"), "text")


def repeated_runs(base: DataFrame, large: int = LARGE) -> DataFrame:
    """doc, tie, at: runs to remove (packed), not yet merged. base: rows of ``_keyed``."""
    sample = few(base.where(F.length("text") <= SAMPLE_CHARS), "doc", SAMPLE_DOCS, base.count())
    common = common_strings([r[0] for r in sample.select("text").collect()])
    rows = base.select("doc", "tie", "text").mapInArrow(_scan(common), "bucket long, hash long, doc long, tie long, at long")
    order = "bucket", "hash", "doc", "tie", "at"
    settled = rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_settle, "bucket long, doc long, tie long, at long")
    settled = stored(settled, "settled")
    runs = settled.where("bucket is null").select("doc", "tie", "at")
    asked = settled.where("bucket is not null")
    by_doc = asked.groupBy("doc", "tie").agg(F.collect_list(F.struct("bucket", "at")).alias("asked"))
    whole = base.select("doc", "tie", "text").join(by_doc, ["doc", "tie"]).select("doc", "tie", "text", "asked")
    fetched = whole.mapInArrow(_fetch, "bucket long, doc long, tie long, at long, piece binary")
    sizes = cut(asked.groupBy("bucket").count().where(F.col("count") > large).select("bucket"))
    sort = lambda df: df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, "doc long, tie long, at long")
    if sizes.limit(1).count() == 0:
        return runs.union(sort(fetched))
    pieces = stored(fetched, "pieces")
    small = sort(pieces.join(sizes, "bucket", "left_anti").select(*pieces.columns))
    dealt = pieces.join(sizes, "bucket", "left_semi").select("doc", "tie", "at", "piece")
    windows = stored(dealt.mapInArrow(_window_rows, "a long, b long, doc long, tie long, place long"), "windows")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "tie", "place")).alias("first"))
    hit = windows.join(first, ["a", "b"]).where(F.struct("doc", "tie", "place") > F.col("first"))
    at = -1 - (F.shiftleft("place", 31).bitwiseOR(F.lit(WINDOW).cast("long")))
    return runs.union(small).union(hit.select("doc", "tie", at.alias("at")))


def dedup(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>> (byte offsets that are removed)."""
    base = _keyed(docs)
    runs = repeated_runs(base, large).groupBy("doc", "tie").agg(F.collect_list("at").alias("ats"))
    joined = base.join(runs, ["doc", "tie"], "left").select("doc_id", "text", "ats")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return joined.mapInArrow(_clean, schema)


def op1_suffix_dedup(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
