"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A source's target is its share of all words by weight, at most ``cap`` times its own size; what a cap leaves over goes
to the other sources by weight. Each source has a weight schedule over training time t in [0, 1]: w(t) = w * (1 + s *
(2t - 1)), with slope s. Its integral is the share of the source's words that training has demanded by t, F(t) = (1 - s)
* t + s * t^2. A document whose words are demanded as the source's u-th part is trained on at t = F^-1(u). Each pass over a source
demands its words anew: the p-th pass over a document has u = ((p - 1) * source size + words ahead + size / 2) / target. Passes are
range-sorted by their positions.

Order inside a source: by MD5 of doc_id, so it doesn't depend on files or partitions. Words are taken in that order,
wholly for as many passes as the target holds, the last pass up to the word that reaches the target.

Cumulative demand is a two-level prefix sum: sums by (source, slice of the MD5), their running totals, then a running
sum inside each slice. No task holds a source, so one with a third of all rows is spread like any other.

Cases. Null text: size 0, taken 0. Null source: a source of its own, ordered last. No words at all: every target is 0.
Documents of size 0 take nothing and have no position. Repeated rows are documents of their own; which of two equal
rows is taken makes no difference to the result. An empty table gives an empty result. Other columns are ignored unless
``carry`` names them; carried columns may have any name that isn't one of the result's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import WORD, WS

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3
#: Hex digits of the MD5 that make a slice: 4096 slices a source.
SLICE_DIGITS = 3


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sums: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP) -> DataFrame:
    """(skey, sz) with one row a source -> (skey, source_size, target, slope).

    Sources in order of cap over weight: those whose cap is below their share are capped, one after another; the share
    of the first that isn't is the share of all the rest. The windows see one row a source.
    """
    n, m = len(weights), len(slopes)
    whole = Window.partitionBy()
    by_name = sums.withColumn("i", F.row_number().over(Window.orderBy(F.col("skey"))) - 1)
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("i") % k + 1).cast("int"))
    d = lambda c: F.col(c).cast("decimal(38,0)")
    rows = by_name.select("skey", "sz", F.col("i"), pick(weights, n).cast("long").alias("w"), pick(slopes, m).cast("double").alias("slope"))
    rows = rows.withColumn("top", F.col("sz") * cap).withColumn("total", F.sum("sz").over(whole))
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("i"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("gone", F.coalesce(F.sum("top").over(before), F.lit(0)))
    rows = rows.withColumn("ws", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("left", F.col("total") - F.col("gone"))
    fits = F.when(d("top") * d("ws") >= d("left") * d("w"), F.struct("k", "left", "ws"))
    rows = rows.withColumn("first", F.min(fits).over(whole))
    shared = (F.col("first.left") * F.col("w")).cast("double") / F.col("first.ws").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("top").cast("double")).otherwise(shared)
    return rows.select("skey", F.col("sz").alias("source_size"), target.alias("target"), "slope")


def _position(done) -> F.Column:
    """When a document of a source's ``slope`` and ``target`` is trained on, with ``done`` words of the source before its pass."""
    u = F.least(F.lit(1.0), (done + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    a, s = 1 - F.col("slope"), F.col("slope")
    t = F.when(s == 0, u).otherwise((F.sqrt(a * a + 4 * s * u) - a) / (2 * F.when(s == 0, F.lit(1.0)).otherwise(s)))
    return F.round(t, 9)


def _taken(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP, carry: tuple[str, ...] = (), slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """One row a document, in no order: doc_id, size, source_size, target, slope, ahead, taken, the carried columns as c_<name>."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    cols = [F.col("doc_id"), F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("skey"), word_count("text").alias("size"), digest.alias("h")]
    base = docs.select(*cols, *[F.col(c).alias(f"c_{c}") for c in carry]).withColumn("slice", F.substring("h", 1, slice_digits))
    slices = base.groupBy("skey", "slice").agg(F.sum("size").alias("ssz"))
    starts = slices.withColumn("start", F.sum("ssz").over(Window.partitionBy("skey").orderBy("slice")) - F.col("ssz"))
    targets = source_targets(slices.groupBy("skey").agg(F.sum("ssz").alias("sz")), weights, slopes, cap)
    offsets = starts.join(targets, "skey").drop("ssz")
    inside = Window.partitionBy("skey", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("ahead", F.sum("size").over(inside) - F.col("size")).join(offsets, ["skey", "slice"])
    rows = rows.withColumn("ahead", F.col("ahead") + F.col("start")).withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    some = F.col("source_size") > 0
    passes = F.when(some, F.expr("goal div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = F.when(some, F.expr("goal % greatest(source_size, 1)")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    rows = rows.withColumn("taken", (passes * F.col("size") + last).cast("long"))
    return rows


def curriculum_mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP, carry: tuple[str, ...] = (), slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, position (that of the first pass), positions (array, of every pass; both null if
    nothing is taken), then the carried columns; range-sorted by position, documents that aren't taken last."""
    rows = _taken(docs, weights, slopes, cap, carry, slice_digits)
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, _position(F.col("ahead"))))
    every = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int") - 1)  # cap of them at most
    rows = rows.withColumn("positions", F.when(F.col("taken") > 0, F.transform(every, lambda p: _position(p * F.col("source_size") + F.col("ahead")))))
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "position", "positions", (F.col("ahead") / F.greatest("source_size", F.lit(1))).alias("_late"), *[F.col(f"c_{c}").alias(c) for c in carry])
    return out.orderBy(F.coalesce("position", F.col("_late") + 1), "doc_id").drop("_late")


def training_passes(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: int = CAP, carry: tuple[str, ...] = (), slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """One row a pass over a document: doc_id, size, target, slope, pass, words, position, then the carried columns; range-sorted
    by position."""
    rows = _taken(docs, weights, slopes, cap, carry, slice_digits).where("taken > 0")
    each = rows.withColumn("pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    before = F.col("pass") - 1
    words = F.least(F.col("size"), F.col("taken") - before * F.col("size")).cast("int")
    out = each.select("doc_id", "size", "target", "slope", "pass", words.alias("words"), _position(before * F.col("source_size") + F.col("ahead")).alias("position"), *[F.col(f"c_{c}").alias(c) for c in carry])
    return out.orderBy("position", "doc_id", "pass")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as they are trained on: one row a pass, the last pass cut after the word that reaches the target,
    in order of position. Columns of ``docs`` named text, lang, source, n_chars are kept; n_chars is that of the row."""
    # ``doc_id`` comes first; the others are carried under their own names
    each = training_passes(docs, carry=("text", "lang", "source"), **options)
    pieces = F.regexp_extract_all("text", F.lit(rf"([{WS}]*[^{WS}]+)"), F.lit(1))
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("words")), ""))
    return each.withColumn("text", text).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def positions(mixed: DataFrame, slopes=SLOPES, slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """The rows of ``mixed_documents`` with their position in training, worked out from the rows alone, as files keep no order.

    Of a document's rows the longest come first, so a cut last pass is its last. A source's pass p is all rows that are their document's
    p-th; its words follow those of the passes before it. The prefix sum is the two-level one, by (source, pass, slice)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = mixed.select("doc_id", "text", skey.alias("skey"), word_count("text").alias("size"), digest.alias("h"))
    nth = Window.partitionBy("skey", "doc_id").orderBy(F.desc("size"))
    rows = rows.withColumn("pass", F.row_number().over(nth)).withColumn("slice", F.substring("h", 1, slice_digits))
    slices = rows.groupBy("skey", "pass", "slice").agg(F.sum("size").alias("ssz"))
    order = Window.partitionBy("skey").orderBy("pass", "slice")  # 4096 rows a pass of a source at most
    starts = slices.withColumn("start", F.sum("ssz").over(order) - F.col("ssz"))
    by_name = Window.orderBy("skey")  # one row a source
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), ((F.row_number().over(by_name) - 1) % len(slopes) + 1).cast("int"))
    targets = slices.groupBy("skey").agg(F.sum("ssz").alias("target")).withColumn("slope", slope)
    inside = Window.partitionBy("skey", "pass", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ahead", F.sum("size").over(inside) - F.col("size"))
    offsets = starts.join(targets, "skey").select("skey", "pass", "slice", "start", "target", "slope")
    placed = rows.join(offsets, ["skey", "pass", "slice"])
    return placed.select("doc_id", "text", _position(F.col("start") + F.col("ahead")).alias("position"))


def op5_curriculum_mix(spark, sf_dir):
    """positions: in billionths of the training, joined by commas."""
    rows = curriculum_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("positions", F.array_join(F.transform("positions", lambda t: F.round(t * 1e9).cast("long").cast("string")), ","))


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (SELECT skey, sum(size)::BIGINT AS sz FROM d GROUP BY skey),
named AS (SELECT *, row_number() OVER (ORDER BY encode(skey)) - 1 AS i FROM src),
weighed AS (SELECT skey, sz, i, [5, 2, 1][i % 3 + 1]::BIGINT AS w, [-0.5, 0.0, 0.5][i % 3 + 1]::DOUBLE AS slope, sz * 3 AS top, (sum(sz) OVER ())::BIGINT AS total FROM named),
ordered AS (SELECT *, row_number() OVER o AS k, coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
                   (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
            FROM weighed WINDOW o AS (ORDER BY top::DOUBLE / w::DOUBLE, i)),
cutoff AS (SELECT k AS k0, total - gone AS left0, ws AS ws0 FROM ordered WHERE top::HUGEINT * ws >= (total - gone)::HUGEINT * w ORDER BY k LIMIT 1),
targets AS (SELECT skey, sz AS source_size, slope, CASE WHEN k0 IS NULL OR k < k0 THEN top::DOUBLE ELSE (left0 * w)::DOUBLE / ws0::DOUBLE END AS target
            FROM ordered LEFT JOIN cutoff ON true),
placed AS (SELECT doc_id, size, source_size, target, slope,
                  (sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS ahead,
                  floor(target + 0.5)::BIGINT AS goal
           FROM d JOIN targets USING (skey)),
taken AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // greatest(source_size, 1) * size
                              + greatest(0, least(size, goal % greatest(source_size, 1) - ahead)) END::BIGINT AS taken, row_number() OVER () AS n FROM placed),
-- every pass over a document: its words are the source's from (pass - 1) * source_size + ahead on
passes AS (SELECT *, unnest(range(0, CASE WHEN taken > 0 THEN greatest(1, ceil(taken::DOUBLE / greatest(size, 1)))::BIGINT ELSE 1 END)) AS p FROM taken),
timed AS (SELECT *, least(1.0, (p * source_size + ahead + size::DOUBLE / 2) / greatest(target, 1.0))::DOUBLE AS u FROM passes),
set_out AS (SELECT *, CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 9) END AS position FROM timed)
SELECT doc_id, size, source_size, target, taken, min(position) AS position, string_agg(round(position * 1e9)::BIGINT::VARCHAR, ',' ORDER BY p) AS positions
FROM set_out GROUP BY n, doc_id, size, source_size, target, taken
"""
