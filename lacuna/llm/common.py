"""What several operators share: the shared folder, cuts of lineage, connected components, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import session

#: The white space of the contracts, as a regex class body: space, tab to carriage return.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: kept in the shared folder, so that a lost executor costs no recomputation."""
    session.shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as Parquet in the shared folder; for what is read more than once and wider than a few numbers."""
    out, path = session.stored(df, name)
    _written.append(path)
    return out


#: Paths that ``stored`` has written and nobody has deleted.
_written: list[str] = []


def written() -> int:
    """A mark for ``sweep``."""
    return len(_written)


def sweep(spark, mark: int, keep: DataFrame | None = None) -> None:
    """Deletes what ``stored`` has written since ``mark``, but for the table ``keep`` reads. For callers that have written what they made of it."""
    kept = [] if keep is None else [f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()]
    for path in _written[mark:]:
        if not any(path.split(":", 1)[-1].lstrip("/") == k for k in kept):
            session.forget(spark, path)
    _written[mark:] = [p for p in _written[mark:] if any(p.split(":", 1)[-1].lstrip("/") == k for k in kept)]


def few(df: DataFrame, key: str, k: int, n: int | None = None) -> DataFrame:
    """At most k rows, those with the smallest hash of ``key``. Only hashes below what about 2 k of all rows have are sorted, so what
    tasks send to the driver doesn't grow with their number. n: the number of rows, if it is known."""
    h = F.shiftrightunsigned(F.xxhash64(key), 2)
    bound = int(min(1.0, 2.0 * k / max(df.count() if n is None else n, 1)) * (1 << 62))
    return df.where(h < bound).orderBy(h, key).limit(k)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph. edges: (u long, v long). Returns (node, component), component being the
    smallest node reachable; nodes without an edge to another node don't appear.

    Each round joins every node and its neighbours to the smallest of them, until only stars around the smallest node
    are left; the number of rounds grows with the logarithm of the longest path. The minima are materialised, so that
    both sides of the join are plain exchanges and adaptive execution can split the partition of a hub.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        lifted = both.join(low, F.col("u") == F.col("n")).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(lifted.where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes without cycles: each node to the smallest of its group."""
    if not len(u):
        return u, v
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low)  # a group follows its root
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty ones."""
    return [t or "" for t in column.to_pylist()]


def arrays_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of lists of numbers without nulls, as arrays over its buffer."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return [values[e - n : e] for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]


def groups(batches, keys: int):
    """Batches of rows that are sorted by their first ``keys`` columns -> the columns of one group after another: numpy arrays, or lists for
    what isn't a number (of arrays for lists of numbers). A task holds one group and a batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy() if pa.types.is_integer(c.type) else arrays_of(c) if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns]
        key = np.stack(columns[:keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for s, e in zip(cuts, cuts[1:]):
            part = [c[s:e] for c in columns]
            if held is not None and all(h[0][0] == p[0] for h, p in zip(held[:keys], part)):
                for h, p in zip(held, part):
                    h.append(p)
                continue
            if held is not None:
                yield [_together(h) for h in held]
            held = [[p] for p in part]
    if held is not None:
        yield [_together(h) for h in held]


def _together(parts: list):
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]
