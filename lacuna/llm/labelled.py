"""Labelled rows that classifiers are fitted on: a bounded sample, the same at every run.

Texts stay on the executors: a classifier gets counts or measures of the examples, never the examples themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import few

#: At most so many labelled rows are fitted on. All rows count alike: those with the smallest hash of doc_id are taken.
MAX_ROWS = 6000
#: Texts over this length are not fitted on (they are scored, wholly, like any other), so the sample is bounded in bytes too.
MAX_CHARS = 50_000


def held_out(modulus: int, fold: int):
    """True where crc32 of doc_id as text leaves ``fold``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, F.lit(False))


def examples(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """doc_id, text, y of labelled rows outside the held-out fold, one row a doc_id.

    Rows without a text, a label of 0 or 1, or a doc_id are no examples. Of a doc_id's several labels the smallest counts,
    of its several texts the one with the smallest hash. Columns of other names are ignored.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, fold))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = few(rows.groupBy("doc_id").agg(F.min("y").alias("y")), "doc_id", max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, max_chars))
    both = texts.join(F.broadcast(chosen), "doc_id")  # max_rows bounds the broadcast
    return both.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("y").alias("y"))
