"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample. Each vector is described by the permutation of its NEAREST pivots, the nearest
first. Inverted lists hold, for each pivot, the vectors that have it among their nearest, with their permutations. Two vectors are
candidates if they share at least SHARED pivots and the shared ones stand near the front of both: the sum over shared pivots of
(NEAREST - place) in the one times the same in the other is at least ORDER. Candidates are verified by cosine in double precision. The
index holds every vector; only the pivots are a sample: for each length of vector those of the PIVOTS_MAX rows with the smallest hash, 2
sqrt(n) of n vectors and at least PIVOTS_MIN.

Two vectors that share SHARED of NEAREST pivots share one among the first NEAREST - SHARED + 1 of each in order of pivot number, so a
vector is posted to those lists alone; a pair is looked at in one list only, that of the smallest pivot it shares.

Equal vectors are one entry with a count, so copies cost nothing; a vector's links are counted with them. A list gives counts per vector and a
spanning forest of its verified links, never its pairs. Lists over BLOCK entries are dealt out as pairs of blocks, so no
task holds more than two blocks, and nothing is capped. Postings carry the vector as the table has it (float or double).

Cases. Null vectors, zero vectors and those with a null or non-finite component link with nothing: no links, a component of
their own. Vectors of different lengths don't link; where a length has fewer vectors than NEAREST, all are on one list. A null vec_id
links with nothing and has a null component. Rows that repeat a vec_id are rows of their own, linked like any. Ties in distance to
pivots: the pivot of the smaller number is nearer. Cosine exactly at the threshold links. Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrays_of, connected_components, cut, few, forest, groups, stored

THRESHOLD = 0.95
NEAREST = 8
SHARED = 3
ORDER = 30
#: Lists that a vector is posted to.
POSTINGS = NEAREST - SHARED + 1
PIVOTS_MIN, PIVOTS_MAX = 64, 4096
BLOCK = 2048


def unit(rows) -> np.ndarray:
    """Rows of one length as unit vectors in double precision; safe for very large and very small components."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """Numbers of the k nearest pivots of each unit vector, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


def _described(pivots: dict[int, np.ndarray]):
    """node, embedding -> node, order: numbers of its nearest pivots, the nearest first; of the lists' names, that is with the length."""

    def run(batches):
        for b in batches:
            rows = arrays_of(b.column(1))
            sizes = np.array([len(r) for r in rows], np.int64)
            out: list = [None] * len(rows)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                own = pivots.get(d)
                if own is None or len(own) < NEAREST:  # fewer vectors than a permutation has places
                    near = np.full((len(at), 1), d * PIVOTS_MAX, np.int64)
                else:
                    near = d * PIVOTS_MAX + nearest(unit([rows[i] for i in at]), own)
                for i, x in zip(at.tolist(), near.tolist()):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "order"])

    return run


def order_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of permutations (pairs, places): the sum over shared pivots of (places - place) in the one times that in the other."""
    weight = np.arange(a.shape[1], 0, -1)
    return ((a[:, :, None] == b[:, None, :]) * (weight[:, None] * weight)).sum((1, 2))


def candidate_pairs(name: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) 0/1 for the permutations (vectors, places) on the list ``name``: whether they share enough pivots in good order and
    none smaller than ``name``."""
    if left.shape[1] < NEAREST:
        return np.ones((len(left), len(right)), bool)
    ids, flat = np.unique(np.concatenate([left.ravel(), right.ravel()]), return_inverse=True)
    both = np.zeros((len(left) + len(right), len(ids)), np.float32)
    both[np.repeat(np.arange(len(both)), left.shape[1]), flat] = 1
    l, r = both[: len(left)], both[len(left) :]
    smaller = int(np.searchsorted(ids, name))
    ok = (l @ r.T >= SHARED) & (l[:, :smaller] @ r[:, :smaller].T == 0)
    p, q = np.nonzero(ok)
    for at in range(0, len(p), 200_000):
        pp, qq = p[at : at + 200_000], q[at : at + 200_000]
        ok[pp, qq] = order_scores(left[pp], right[qq]) >= ORDER
    return ok


def _verify(threshold: float):
    """Postings (list, low, high, node, weight, block, order, embedding) of a partition, sorted by list and blocks -> kind 0: (node, links);
    kind 1: an edge (node, node)."""

    def one(rows) -> pa.RecordBatch:
        name, low, high, node, weight, block = rows[0][0], rows[1][0], rows[2][0], *rows[3:6]
        orders, x = np.array(rows[6]), unit(rows[7])
        count = np.zeros(len(node), np.int64)
        us, vs = [node[:0]], [node[:0]]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in range(0, len(left), BLOCK):
            for j in range(0, len(right), BLOCK):
                l, r = left[i : i + BLOCK], right[j : j + BLOCK]
                ok = candidate_pairs(int(name), orders[l], orders[r])
                if low == high:
                    ok &= l[:, None] < r[None, :]
                if not ok.any():
                    continue
                ok &= x[l] @ x[r].T >= threshold
                count[l] += ok @ weight[r]
                count[r] += weight[l] @ ok
                p, q = np.nonzero(ok)
                u, v = forest(node[l[p]], node[r[q]])
                us.append(u)
                vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        some = np.flatnonzero(count)
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(u), np.int32)])
        columns = kind, np.concatenate([node[some], u]), np.concatenate([count[some], v])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "u", "v"])

    return lambda batches: (one(x) for x in groups(batches, 3) if len(x[0]) > 1)


def usable(vectors: DataFrame) -> F.Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & good & F.exists("embedding", lambda x: x != 0), F.lit(False))


def choose_pivots(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by length of vector: a sample of at most PIVOTS_MAX nodes of each, those with the smallest hash."""
    out = {}
    for size, n in nodes.groupBy(F.size("embedding")).count().collect():  # a row a length
        k = min(PIVOTS_MAX, max(PIVOTS_MIN, 2 * math.isqrt(n)))
        out[size] = unit([r[0] for r in few(nodes.where(F.size("embedding") == size), "node", k, n).select("embedding").collect()])
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ok = base.where(usable(base)).withColumn("node", F.xxhash64("embedding"))
    nodes = stored(ok.groupBy("node", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low_id")), "vectors")
    pivots = choose_pivots(nodes)
    orders = stored(nodes.select("node", "embedding").mapInArrow(_described(pivots), "node long, order array<long>"), "permutations")
    postings = orders.select("node", "order", F.explode(F.slice(F.array_sort("order"), 1, POSTINGS)).alias("list"))
    sizes = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # a row a pivot
    dealt = postings.join(F.broadcast(sizes), "list")  # no more rows than pivots, PIVOTS_MAX a length
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.join(nodes.select("node", "weight", "embedding"), "node")
    rows = rows.select("list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "weight", "block", "order", "embedding")
    rows = rows.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "node")
    found = stored(rows.mapInArrow(_verify(threshold), "kind int, u long, v long"), "links")
    counts = found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("links"))
    comp = connected_components(found.where("kind = 1").select("u", "v"))
    named = nodes.select("node", "weight", "low_id").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    each = cut(named.join(lows, "component").join(counts, "node", "left").select("node", n_links, "component_id"))
    keys = base.select("vec_id", F.when(usable(base), F.xxhash64("embedding")).alias("node"))
    out = keys.join(each, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_pivot_permutation(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
