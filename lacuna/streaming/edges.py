"""Edges kept up to date from a stream of works, each batch by partial counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.corpus import concept_pairs, cooccurrence_edges, mirrored


def append_counts(path: str):
    """For foreachBatch over (work, cid): the batch's edge counts under ``path``, one folder a batch, so that a batch that is run
    again replaces itself. A work's concepts have to come in one batch; ``merge_works`` is for those that don't."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cooccurrence_edges(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def totals(spark, path: str) -> DataFrame:
    """(src, dst, cooc) over all batches."""
    return spark.read.parquet(path).groupBy("src", "dst").agg(F.sum("cooc").alias("cooc"))


#: Shards of the works seen: a batch reads the shards of its works alone.
SHARDS = 64


def merge_works(path: str, shards: int = SHARDS):
    """For foreachBatch over (work, cid) where a work's concepts come in any number of batches, late or repeated.

    Under ``path`` there are works seen (work, cid, by batch and shard) and edge counts (by batch). Of a batch only what wasn't seen in an earlier
    one counts: the pairs of its new concepts with each other and with those the work had before. Each pair of a work is so counted in one
    batch, the one that brings its second concept. A batch that is run again sees the same earlier batches and replaces itself; batches
    have to be committed in the order of their numbers, as Structured Streaming does."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("work", "cid").where("work is not null and cid is not null").distinct().withColumn("shard", F.pmod(F.xxhash64("work"), F.lit(shards)).cast("int"))
        now = f"batch={batch_id}"
        before = seen(spark, path, batch_id, rows.schema)
        touched = [r.shard for r in rows.select("shard").distinct().collect()]  # so many numbers at most
        before = before.where(F.col("shard").isin(touched)).join(rows.select("work").distinct(), "work", "left_semi")
        fresh = rows.join(before, ["shard", "work", "cid"], "left_anti")
        fresh.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/seen/{now}")
        fresh = spark.read.schema(rows.schema).parquet(f"{path}/seen/{now}")
        inside = concept_pairs(fresh.select("work", "cid"))
        across = fresh.select("work", F.col("cid").alias("x")).join(before.select("work", F.col("cid").alias("y")), "work").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        counts = inside.unionByName(across).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cooc"))
        mirrored(counts).write.mode("overwrite").parquet(f"{path}/edges/{now}")

    return write


def seen(spark, path: str, before: int, schema) -> DataFrame:
    """The works' concepts (shard, work, cid) that batches before number ``before`` brought."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/seen")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wide = "batch int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    if not files.exists(at):
        return spark.createDataFrame([], wide).drop("batch")
    return spark.read.schema(wide).parquet(f"{path}/seen").where(F.col("batch") < before).drop("batch")


def merged(spark, path: str) -> DataFrame:
    """(src, dst, cooc) of what ``merge_works`` has written."""
    return totals(spark, f"{path}/edges")
