"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``near_duplicates`` links fingerprints at Hamming distance 3 or less. Of the two 32-bit halves of such a pair, one differs in at
most half the radius, that is one bit. So every fingerprint emits, for either half, the half itself and all its variants
within one bit (the ball of half the radius: 2 x 33 rows); the variants are shuffled; a pair meets in a bucket where the
half of one is exact and lies in the other's ball. Colliding pairs are verified on all 64 bits. No link is lost: the
half that differs in at most one bit always meets. (Balls of radius 2 over all 64 bits would be 2,081 rows each.)

``similar`` links texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more. At 0.8 two fingerprints
differ in 15 % of their bits, far beyond what one ball reaches, so each text has several independent fingerprints of few bits:
parts, each emitting its ball of radius 1, so that a pair meets where one part differs in two bits or less. ``plan``
sets the bits by the number of texts, so that chance meetings stay a few dozen a variant at any size, and the number of parts so that a pair at the
threshold meets with a probability of RECALL or more (closer pairs meet more surely). Variants that begin with the same bits go to the same
task, so they are shipped as one row and told apart there: a part costs one row and one for each of its leading bits, not one for each of all.
Pairs whose bits all together are too far apart for the threshold are left out, and the rest are verified exactly, on their sets of shingles.

Only distinct fingerprints, or texts, take part, with the smallest doc_id of each as its node. A bucket gives a spanning forest of
its links, not its pairs; components over all buckets are the same. A bucket over LARGE rows is not held in one task but dealt out
in Spark as pairs of blocks, and so is a group of texts to verify over BLOCK_SHINGLES; nothing is lost and nothing capped.

Cases. Null or empty text, or white space only: fingerprint 0, linked like any other. Fewer words than a shingle: the
whole sequence is one shingle. Repeated rows share a component. A null doc_id is fingerprinted but linked
with nothing, and has a null component. Empty tables give empty results. Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import connected_components, forest, groups, stored

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints of a bucket that are compared all with all at once.
BLOCK = 512
#: Rows of a bucket that one task holds.
LARGE = 50_000
#: ``similar``: words of a shingle, the similarity that links, the least probability with which a pair at that similarity is found.
WORDS, SIMILARITY, RECALL = 5, 0.8, 0.95
#: Rows of one beginning that a task holds, the rows it tells apart at once, and the fewest bits by which two texts are compared.
HELD, SLICE, LEAST_BITS = 1_000_000, 50_000, 128
#: Comparisons of one variant's rows that a task makes; beyond, they are dealt out.
COMPARED = LARGE**2 // 2
#: Shingles of the texts that a task verifies against each other, for either block.
BLOCK_SHINGLES = 1_000_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if it is set in over half the shingles' hashes, repeats counted."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    m = max(1, len(words) - n + 1)
    h = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for at in range(0, m, 65536):  # bounded memory for texts of any length
        hashes = np.fromiter((h(b" ".join(words[i : i + n]), SEED) for i in range(at, min(m, at + 65536))), np.uint64)
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > m, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _balls(batches):
    """fp, node -> key, node, f0: both halves, exact and with each bit turned."""
    turn = np.concatenate([[0], 1 << np.arange(32, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        node = b.column(1).to_numpy()
        for half in (0, 1):
            part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            key = ((part[:, None] ^ turn) | np.uint64(half << 32)).ravel()
            columns = pa.array(key.view(np.int64)), pa.array(np.repeat(node, 33)), pa.array(np.repeat(fp, 33).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns), names=["key", "node", "f0"])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; a, b: (..., words) of 64 bits."""
    return sum(np.bitwise_count(a[..., i] ^ b[..., i]).astype(np.int16) for i in range(a.shape[-1]))


def _bucket_links(fp: np.ndarray, node: np.ndarray, radius: int, left: np.ndarray | None = None, right: np.ndarray | None = None):
    """Links of one bucket as a forest: of all its rows, or of the rows in ``left`` with those in ``right``. fp: (rows, words)."""
    us, vs = [node[:0]], [node[:0]]
    same = left is None
    left = np.arange(len(node)) if same else left
    right = left if same else right
    for i in range(0, len(left), BLOCK):
        for j in range(i if same else 0, len(right), BLOCK):
            l, r = left[i : i + BLOCK], right[j : j + BLOCK]
            a, b = np.nonzero(distances(fp[l][:, None], fp[r][None]) <= radius)
            keep = l[a] != r[b]
            u, v = forest(node[l[a[keep]]], node[r[b[keep]]])
            us.append(u)
            vs.append(v)
    return forest(np.concatenate(us), np.concatenate(vs))


def _edges(u: np.ndarray, v: np.ndarray, words: int) -> pa.RecordBatch:
    none = pa.array(np.zeros(len(u), np.int64), mask=np.ones(len(u), bool))
    return pa.RecordBatch.from_arrays([none, pa.array(u, pa.int64()), pa.array(v, pa.int64()), *[none] * words], names=_names(words))


def _names(words: int) -> list[str]:
    return ["key", "u", "v", *(f"f{i}" for i in range(words))]


def _links(radius: int, words: int = 1, large: int = LARGE):
    """Rows (key, node, f0, f1, ...) sorted by key -> rows of (key, u, v, f0, ...): key null: a forest edge (u, v) of the links; else a row
    (u the node) of a bucket of over ``large`` rows, which is passed on. A task holds ``large`` rows of a bucket and a batch."""

    def passed(key, node, fp):
        none = pa.array(np.zeros(len(key), np.int64), mask=np.ones(len(key), bool))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), none, *(pa.array(fp[:, i].view(np.int64)) for i in range(words))], names=_names(words))

    def flush(key, node, fp):
        change = np.flatnonzero(np.diff(key)) + 1
        start, end = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
        size = end - start
        us, vs = [], []
        small = size <= 32
        row_end = np.repeat(np.where(small, end, start), size)
        index = np.arange(len(key))
        for d in range(1, int(size[small].max(initial=1))):
            i = index[index + d < row_end]
            if not len(i):
                break
            ok = distances(fp[i], fp[i + d]) <= radius
            us.append(node[i[ok]])
            vs.append(node[(i + d)[ok]])
        for s, e in zip(start[~small], end[~small]):
            u, v = _bucket_links(fp[s:e], node[s:e], radius)
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])
        return _edges(*forest(u, v), words)

    def run(batches):
        held = None
        passing = None  # the key of a bucket that is passed on
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = np.stack([b.column(2 + i).to_numpy().view(np.uint64) for i in range(words)], axis=1)
            if passing is not None:
                n = np.searchsorted(key, passing, side="right")
                if n:
                    yield passed(key[:n], node[:n], fp[:n])
                if n == len(key):
                    continue
                key, node, fp, passing = key[n:], node[n:], fp[n:], None
            if held is not None:
                key, node, fp = (np.concatenate([x, y]) for x, y in zip(held, (key, node, fp)))
            at = np.searchsorted(key, key[-1])  # the last bucket may go on
            if at:
                yield flush(key[:at], node[:at], fp[:at])
            held = key[at:], node[at:], fp[at:]
            if len(held[0]) > large:
                passing = held[0][0]
                yield passed(*held)
                held = None
        if held is not None:
            yield flush(*held)

    return run


def _block_links(radius: int, words: int):
    """Rows (key, low, high, block, node, f0, ...) sorted by key, low, high -> forest edges between blocks low and high of a bucket."""

    def one(rows):
        fp = np.stack([r.view(np.uint64) for r in rows[5:]], axis=1)
        low, high = np.flatnonzero(rows[3] == rows[1][0]), np.flatnonzero(rows[3] == rows[2][0])
        return _edges(*_bucket_links(fp, rows[4], radius, low, high), words)

    return lambda batches: (one(x) for x in groups(batches, 3))


def ball_links(rows: DataFrame, radius: int, words: int = 1, large: int = LARGE) -> DataFrame:
    """u, v: forests of the links, at ``radius`` or less, within each bucket. rows: key, node, f0, f1, ..."""
    columns = ", ".join(f"{n} long" for n in _names(words))
    found = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius, words, large), columns), "links")
    edges, passed = found.where("key is null").select("u", "v"), found.where("key is not null")
    if passed.limit(1).count() == 0:
        return edges
    fp = [f"f{i}" for i in range(words)]
    parts = passed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (large / 2)).cast("int").alias("blocks"))
    dealt = passed.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("u", *fp), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", F.col("u").alias("node"), *fp)
    more = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_block_links(radius, words), columns)
    return edges.union(more.select("u", "v"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id reachable over links, itself included."""
    fps = stored(fingerprints(docs, n), "fingerprints")
    nodes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = ball_links(nodes.mapInArrow(_balls, "key long, node long, f0 long"), RADIUS)
    comp = connected_components(edges)
    named = stored(nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "components")
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- texts by their sets of shingles ------------------------------------------------------------------------------


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different n-word shingles; of the whole sequence if it is shorter, of nothing if it is empty."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + n]), SEED) for i in range(max(1, len(words) - n + 1))), np.uint64))


@dataclass(frozen=True)
class Plan:
    """Bits of a part, number of parts, leading bits by which variants are shipped, bits of the whole fingerprint, largest distance over all of them."""

    bits: int
    parts: int
    top: int
    total: int
    radius: int

    @property
    def words(self) -> int:
        return -(-self.total // 64)

    @property
    def rows(self) -> int:
        """Rows that are shuffled for a text."""
        return self.parts * (1 + self.top)

    @property
    def bytes(self) -> int:
        """Bytes of these rows: key, node and fingerprint."""
        return self.rows * 8 * (2 + self.words)


def plan(n: int, similarity: float = SIMILARITY, recall: float = RECALL, held: int = HELD) -> Plan:
    """How n texts are compared.

    Two sets of Jaccard similarity s have a cosine of 2 s / (1 + s) if they are alike in size, so each bit differs with the chance
    acos of that over pi. A part has one bit less than it takes to number the texts, so that about as many texts as twice its bits meet at a
    variant by chance, at any number of them. The distance allowed is three standard deviations beyond the mean. As many leading bits are
    shipped as leave ``held`` rows a task."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 2))) - 1)
    meets = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    parts = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    top = next(t for t in range(min(3, bits), bits + 1) if t == bits or n * (1 + t) <= held << t)
    total = max(bits * parts, LEAST_BITS)
    return Plan(bits, parts, top, total, math.floor(total * p + 3 * math.sqrt(total * p * (1 - p))))


def wide_fingerprint(shingles: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of shingle hashes with as many bits as asked, in words of 64; unused bits are 0."""
    out = np.zeros(-(-bits // 64), np.uint64)
    for w in range(len(out)):
        sums = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 65536):
            h = shingles[at : at + 65536] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * sums > len(shingles), bitorder="little").view(np.uint64)[0]
    if bits % 64:
        out[-1] &= np.uint64((1 << bits % 64) - 1)
    return out


def _described(n: int, bits: int, words: int):
    """doc_id, h, text -> doc_id, h, node (a hash of the set of shingles), f0, f1, ..."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            fp = np.array([wide_fingerprint(x, bits) for x in sets], np.uint64).reshape(len(sets), words)
            columns = [b.column(0), b.column(1), pa.array(node), *(pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(words))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", *(f"f{i}" for i in range(words))])

    return run


def part_of(fp: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th part of fingerprints (rows, words)."""
    w, shift = divmod(k * bits, 64)
    part = fp[:, w] >> np.uint64(shift)
    if shift + bits > 64:
        part = part | (fp[:, w + 1] << np.uint64(64 - shift))
    return part & np.uint64((1 << bits) - 1)


def _part_balls(p: Plan):
    """node, f0, f1, ... -> key, node, f0, f1, ...: of each part's ball of radius 1 the part itself, standing for all variants that begin as it does, and its
    variants with a leading bit turned. key: the number of the part, then the variant."""
    turn = np.concatenate([[0], 1 << np.arange(p.bits - p.top, p.bits, dtype=np.uint64)]).astype(np.uint64)

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy()
            fp = np.stack([b.column(1 + i).to_numpy().view(np.uint64) for i in range(p.words)], axis=1)
            wide = [pa.array(np.repeat(x, len(turn))) for x in (node, *(np.ascontiguousarray(fp[:, i]).view(np.int64) for i in range(p.words)))]
            for k in range(p.parts):
                key = ((part_of(fp, k, p.bits)[:, None] ^ turn) | np.uint64(k << p.bits)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *wide], names=["key", "node", *(f"f{i}" for i in range(p.words))])

    return run


def _variants(key: np.ndarray, whole: np.ndarray, turned) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the rows they are of: every key, and those of the rows in ``whole`` with each bit of ``turned`` turned."""
    rows = np.flatnonzero(whole)
    more = [key[rows] ^ np.int64(1 << i) for i in turned]
    return np.concatenate([key, *more]), np.concatenate([np.arange(len(key)), *[rows] * len(more)])


def _meetings(key: np.ndarray, row: np.ndarray, own: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int):
    """(u, v, dealt): links of the rows that share a key, and the places of those whose key has too many to compare here. Rows of the same exact part
    are compared at that part alone, not again at each of its variants."""
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    us, vs, dealt = [], [], []
    small = size <= 128
    ends = np.repeat(np.where(small, start + size, start), size)
    i = np.arange(len(key))
    for d in range(1, int(size[small].max(initial=1))):
        i = i[i + d < ends[i]]
        a, b = row[i], row[i + d]
        near = distances(fp[a], fp[b]) <= radius
        us.append(node[a[near]])
        vs.append(node[b[near]])
    for s, n in zip(start[~small].tolist(), size[~small].tolist()):
        at, home = row[s : s + n], own[row[s : s + n]]
        here = at[home == key[s]]
        homes, counts = np.unique(home[home != key[s]], return_counts=True)
        hot = homes[counts > 1000]
        rest = at[(home != key[s]) & ~np.isin(home, hot)]
        groups_ = [at[home == h] for h in hot]
        pairs = len(here) * n + len(rest) * n + sum(len(g) for g in groups_) ** 2 - sum(len(g) ** 2 for g in groups_)
        if pairs > COMPARED:
            dealt.append(order[s : s + n])
            continue
        them = [(here, None), (here, rest), (rest, None)]
        for j, g in enumerate(groups_):
            them += [(here, g), (rest, g), *((g, x) for x in groups_[j + 1 :])]
        for left, right in them:
            if len(left) and (right is None or len(right)):
                both = left if right is None else np.concatenate([left, right])
                sides = () if right is None else (np.arange(len(left)), np.arange(len(left), len(both)))
                u, v = _bucket_links(fp[both], node[both], radius, *sides)
                us.append(u)
                vs.append(v)
    u, v = (np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])
    return *forest(u, v), np.concatenate(dealt) if dealt else np.zeros(0, np.int64)


def _part_links(p: Plan, held: int):
    """Rows (key, node, f0, ...) sorted by key -> rows of (key, u, v, f0, ...): key null: a forest edge of the links; else a row (u the node) of a whole
    variant that has too many to compare in one task. A task holds the rows of one beginning, ``held`` of them, and a slice of their variants."""
    low = p.bits - p.top

    def out(key, node, fp):
        none = pa.array(np.zeros(len(key), np.int64), mask=np.ones(len(key), bool))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), none, *(pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(p.words))], names=_names(p.words))

    def own_keys(key, fp):
        k = int(key[0] >> p.bits)
        return part_of(fp, k, p.bits).astype(np.int64) | np.int64(k << p.bits)

    def links(key, node, fp):
        own = own_keys(key, fp)
        more = min(low, max(0, math.ceil(math.log2(max(1, len(key) / SLICE)))))  # further leading bits, told apart here
        keys, rows = _variants(key, key == own, range(low - more, low))
        whole = keys == own[rows]
        order = np.argsort(keys >> (low - more), kind="stable")
        keys, rows, whole = keys[order], rows[order], whole[order]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(keys >> (low - more)) != 0, [True]]))
        us, vs = [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            each, of = _variants(keys[s:e], whole[s:e], range(low - more))
            u, v, dealt = _meetings(each, rows[s:e][of], own, node, fp, p.radius)
            us.append(u)
            vs.append(v)
            if len(dealt):
                r = rows[s:e][of[dealt]]
                yield out(each[dealt], node[r], fp[r])
        yield _edges(*forest(np.concatenate(us), np.concatenate(vs)), p.words)

    def passed(key, node, fp):
        for s in range(0, len(key), SLICE):
            k, n, f = key[s : s + SLICE], node[s : s + SLICE], fp[s : s + SLICE]
            each, of = _variants(k, k == own_keys(k, f), range(low))
            yield out(each, n[of], f[of])

    def run(batches):
        kept: list[tuple] = []
        beginning, passing = None, False
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            fp = np.stack([b.column(2 + i).to_numpy().view(np.uint64) for i in range(p.words)], axis=1)
            top = key >> low
            cuts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if top[s] != beginning:
                    if kept:
                        yield from links(*map(np.concatenate, zip(*kept)))
                    kept, beginning, passing = [], top[s], False
                part = key[s:e], node[s:e], fp[s:e]
                if passing:
                    yield from passed(*part)
                    continue
                kept.append(part)
                if sum(len(x[0]) for x in kept) > held:
                    passing = True
                    yield from passed(*map(np.concatenate, zip(*kept)))
                    kept = []
        if kept:
            yield from links(*map(np.concatenate, zip(*kept)))

    return run


def part_links(nodes: DataFrame, p: Plan, held: int = HELD, large: int = LARGE) -> DataFrame:
    """u, v: forests of the links at the plan's radius or less between nodes that meet in a part's balls. nodes: node, f0, f1, ... A beginning of more than
    twice ``held`` rows is shipped variant by variant, and so is a variant that has too many rows to compare in a task."""
    fp = [f"f{i}" for i in range(p.words)]
    balls = nodes.select("node", *fp).mapInArrow(_part_balls(p), ", ".join(f"{x} long" for x in ("key", "node", *fp)))
    dealt = balls.repartition(F.shiftright("key", p.bits - p.top)).sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(_part_links(p, 2 * held), ", ".join(f"{x} long" for x in _names(p.words))), "links")
    edges, passed = found.where("key is null").select("u", "v"), found.where("key is not null")
    if passed.limit(1).count() == 0:
        return edges
    return edges.union(ball_links(passed.select("key", F.col("u").alias("node"), *fp), p.radius, p.words, large))


def verified(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of sets whose Jaccard similarity is high enough. A search from set to set: each one reached is held against
    those not reached yet, so a large group of copies costs little more than one comparison a member."""
    us, vs = [], []
    size = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        values = np.concatenate([sets[i] for i in left]) if len(left) else np.zeros(0, np.uint64)
        starts = np.cumsum(size[left]) - size[left]
        there = np.ones(len(left), bool)  # those of ``left`` not reached
        while todo and there.any():
            i = todo.pop()
            if there.sum() < len(left) / 2:
                todo.append(i)
                break
            at = np.searchsorted(sets[i], values)
            at[at == size[i]] = 0
            shared = np.add.reduceat((sets[i][at] == values).astype(np.int64), starts)
            near = there & (shared >= similarity * (size[left] + size[i] - shared) - 1e-9)
            new = left[near]
            us += [node[i]] * len(new)
            vs += node[new].tolist()
            todo += new.tolist()
            there &= ~near
        left = left[there]
    return forest(np.array(us, np.int64), np.array(vs, np.int64))


def _verify(similarity: float, n: int):
    """Rows (component, low, high, block, node, text) sorted by component, low, high -> u, v: a forest of the verified links."""

    def run(batches):
        for x in groups(batches, 3):
            u, v = verified(np.asarray(x[4]), [shingle_set(t, n) for t in x[5]], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def similar(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, large: int = LARGE, held: int = HELD) -> DataFrame:
    """doc_id, h (hash of the text), component_id: the smallest doc_id reachable over links between texts whose sets of n-word
    shingles have ``similarity`` or more; rows without a doc_id have none and link with nothing."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    p = plan(base.count(), similarity, recall, held)
    fp = [f"f{i}" for i in range(p.words)]
    described = base.mapInArrow(_described(n, p.total, p.words), ", ".join(f"{x} long" for x in ("doc_id", "h", "node", *fp)))
    described = stored(described, "described")
    known = described.where("doc_id is not null")
    nodes = stored(known.groupBy("node", *fp).agg(F.min(F.struct("doc_id", "h")).alias("first")), "texts")
    loose = connected_components(part_links(nodes, p, held, large)).withColumnRenamed("component", "loose")
    members = stored(nodes.join(loose, "node").select("node", "loose", "first.*"), "members")
    # the texts of groups, one a node, verified against each other; large groups as pairs of blocks
    texts = base.join(members, ["doc_id", "h"]).groupBy("loose", "node").agg(F.min("text").alias("text"))
    texts = stored(texts, "members-texts")
    many = texts.groupBy("loose").agg(F.ceil(F.sum(F.length("text") / 6) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = texts.join(many, "loose").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)))))
    dealt = dealt.select("loose", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "text")
    links = dealt.repartition("loose", "low", "high").sortWithinPartitions("loose", "low", "high", "node").mapInArrow(_verify(similarity, n), "u long, v long")
    comp = connected_components(links)
    named = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("first.doc_id").alias("low"))
    named = stored(named, "named")
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "component").select("node", "component_id")
    return described.join(of, "node", "left").select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash_balls(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
