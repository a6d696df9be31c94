"""Interaction of filters: what each filter removes at each place of every order, and its Shapley value.

Filters are judged once a document, into a mask of failures. Documents of equal part, mask and labels are one cell, so that what follows
grows with the number of parts, not of documents. The orders of a part are visited by swaps of neighbours (each next order differs
from the one before in two adjacent places), and only the two swapped steps are worked out anew from the cells; all others stand. What a
filter removes is summed along the walk: over all orders that is its Shapley value times their number.

A copy fails the filter for duplicates if a smaller doc_id has its text. Texts are known by their SHA-256: the smallest doc_id of each
text comes from a partial aggregate, and rows meet it by (doc_id, text), so that a text that stands in a third of all rows is a
third of no task.

Cases. Null text: empty. Null source: part "". Null doc_id: has no labels, is no copy and makes none. Several labels of a doc_id: one that is 1
counts. Repeated rows (same doc_id and text) count each, and none is a copy of the other. An empty table gives no row. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored

_UPPER, _MARKS = re.compile("[A-Z]"), re.compile("[#$%&*|]")

#: The filters of the query by letter: each says from a text and its words (bytes) whether it fails. E, for copies, is ``copies`` below.
CONDITIONS = {
    "A": lambda text, words: len(words) < 200,
    "B": lambda text, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, words: 100 * len(_UPPER.findall(text)) > 2 * len(text),
    "D": lambda text, words: _MARKS.search(text) is not None,
}
COPIES = "E"
MEASURES = ("n", "good", "toxic")


def adjacent_swaps(n: int):
    """(order, place) of every permutation of range(n): each after the first comes from the one before by swapping ``place`` and the next."""
    order, heads = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        movable = [x for x in order if 0 <= order.index(x) + heads[x] < n and order[order.index(x) + heads[x]] < x]
        if not movable:
            return
        x = max(movable)
        i = order.index(x)
        j = i + heads[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            heads[y] = -heads[y]
        yield tuple(order), min(i, j)


def passing(cells: np.ndarray) -> np.ndarray:
    """cells (parts, masks) of documents by the filters they fail -> by each set of filters the documents that pass all of it."""
    n = cells.shape[1].bit_length() - 1
    fails = cells.copy()
    for f in range(n):  # fails[S]: documents whose failures lie in S
        has = np.arange(1 << n) >> f & 1 == 1
        fails[:, has] += fails[:, np.flatnonzero(has) ^ (1 << f)]
    return fails[:, ::-1]  # those that pass S fail only in what S leaves


def walk(cells: np.ndarray, good: np.ndarray, toxic: np.ndarray):
    """(orders, out, shapley) of cells (parts, masks): out has (parts, orders, places) of kept, removed, redundant, unique_fails,
    good_lost, toxic_lost; shapley (parts, filters)."""
    n = cells.shape[1].bit_length() - 1
    left = [passing(x) for x in (cells, good, toxic)]
    fails = np.stack([cells[:, np.arange(1 << n) >> f & 1 == 1].sum(1) for f in range(n)], 1)
    alone = cells[:, [1 << f for f in range(n)]]
    orders, steps = [], []
    now = np.zeros((6, len(cells), n), np.int64)
    shapley = np.zeros((len(cells), n), np.int64)
    for order, swapped in adjacent_swaps(n):
        for place in range(n) if swapped is None else (swapped, swapped + 1):
            f, before = order[place], sum(1 << g for g in order[:place])
            kept = left[0][:, before | 1 << f]
            removed = left[0][:, before] - kept
            lost = [x[:, before] - x[:, before | 1 << f] for x in left[1:]]
            now[:, :, place] = (kept, removed, fails[:, f] - removed, alone[:, f], *lost)
        shapley[:, list(order)] += now[1]
        orders.append(order)
        steps.append(now.copy())
    return orders, np.stack(steps, 2), shapley


_OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _enumerate(letters: str, batch: int = 64):
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (*_OUT, "shapley"))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                cells = [np.array(c.to_pylist(), np.int64).reshape(b.num_rows, -1) for c in b.columns[1:]]
                orders, out, shapley = walk(*cells)
                m, n = len(orders), len(letters)
                by_place = np.stack([shapley[:, list(o)] for o in orders], 1)
                names = np.repeat(["".join(letters[f] for f in o) for o in orders], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), m * n))),
                        pa.array(np.tile(names, b.num_rows)),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows * m)),
                        *(pa.array(x.ravel()) for x in (*out, by_place)),
                    ],
                    schema=schema,
                )

    return run


def _judge(conditions):
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            masks, digests = [], []
            for text in texts:
                raw = text.encode()
                words = raw.split()  # bytes split at the white space of the contract
                masks.append(sum(1 << i for i, fails in enumerate(conditions) if fails(text, words)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    return run


def judged(docs: DataFrame, conditions: dict = CONDITIONS) -> DataFrame:
    """doc_id, part, mask (bit i: the i-th condition fails), digest: the text's SHA-256. Each text is read once; nothing wider leaves the scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_judge(list(conditions.values())), "doc_id long, part string, mask int, digest binary")


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``judged`` rows with ``bit`` set where a smaller doc_id has the same text."""
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where("doc_id is not null").join(first, ["doc_id", "digest"], "left")
    marked = known.withColumn("mask", F.col("mask") + F.when(F.col("first").isNull(), bit).otherwise(0))
    return marked.select("doc_id", "part", "mask").unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """One row a part: part and three arrays by mask: documents, those labelled good, those labelled toxic."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    both = masks.where("doc_id is not null").join(known, "doc_id", "left").unionByName(masks.where("doc_id is null"), allowMissingColumns=True)
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    cells = both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count(F.col("quality")).alias("good"), count(F.col("toxic")).alias("toxic"))
    by_mask = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << n)]).alias(c)
    return cells.groupBy("part").agg(*[by_mask(c) for c in MEASURES])


def interactions(docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, copies: str | None = COPIES) -> DataFrame:
    """part, filter_order, step, then per step kept, removed, redundant, unique_fails, good_lost, toxic_lost and the filter's shapley
    (what it removes, summed over all orders): a row for every part, order and step."""
    letters = "".join(conditions) + (copies or "")
    rows = judged(docs, conditions)
    if copies:
        rows = with_copies(stored(rows, "judged"), 1 << len(conditions))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*_OUT, "shapley"))
    return mask_cells(rows, labels, len(letters)).mapInArrow(_enumerate(letters), schema)


def op13_filter_audit(spark, sf_dir):
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM t GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, list_concat(
        CASE WHEN len(w) < 200 THEN ['A'] ELSE [] END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN ['B'] ELSE [] END,
        CASE WHEN 100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 2 * length(t.t) THEN ['C'] ELSE [] END, CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN ['D'] ELSE [] END,
        CASE WHEN t.doc_id > low THEN ['E'] ELSE [] END) AS fails FROM t JOIN first ON first.t = t.t LEFT JOIN l ON l.doc_id = t.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
steps AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, string_split(substr(o, 1, step - 1), '') AS before FROM (VALUES {_ORDERS}) v(o), range(1, 6) s(step)),
counted AS (SELECT part, filter_order, step::INT AS step, f,
    sum(CASE WHEN NOT list_has_any(fails, before) AND NOT list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_has_any(fails, before) AND list_contains(fails, f) THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = [f] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f) THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT list_has_any(fails, before) AND list_contains(fails, f) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
