"""Look-ups at a remote service, remembered: what has been asked before is read, the rest is asked, and what was answered is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import scratch

#: Answers of one key: the key, and what came back; None where the service failed.
Ask = Callable[[Iterator[str]], Iterator[tuple[str, str | None]]]


def digest(key) -> F.Column:
    """The name under which an answer is kept: 32 hex digits of the key's SHA-256."""
    return F.left(F.sha2(F.col(key) if isinstance(key, str) else key, 256), F.lit(32))


class Memo:
    """Answers by key in a folder that driver and executors share, a Parquet table (name, key, answer), appended to."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "memo")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], "name string, key string, answer string").write.parquet(self.path)

    def known(self) -> DataFrame:
        return self.spark.read.schema("name string, key string, answer string").parquet(self.path)

    def ask(self, keys: DataFrame, service: Ask, column: str = "key") -> DataFrame:
        """keys (column, ...) with ``answer``: each different key is asked once, if it isn't known, by ``service`` within a task.

        What fails (None) is asked again next time, and has a null answer until then, as have null keys, which aren't asked. Whatever
        else a service returns, the empty string too, is an answer. A key that two runs ask at the same time is kept twice, and read once."""
        asked = keys.select(F.col(column).alias("key")).where("key is not null").distinct().withColumn("name", digest("key"))
        fresh = asked.join(self.known().select("name", "key"), ["name", "key"], "left_anti").select("key")

        def answer(batches):
            import pyarrow as pa

            for b in batches:
                rows = list(service(iter(b.column(0).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([a for _, a in rows], pa.string())], ["key", "answer"])

        got = fresh.mapInArrow(answer, "key string, answer string").where("key is not null and answer is not null")
        got.select(digest("key").alias("name"), "key", "answer").write.mode("append").parquet(self.path)
        answers = self.known().groupBy("key").agg(F.min("answer").alias("answer"))
        return keys.join(answers.withColumnRenamed("key", column), column, "left")
