"""Session defaults for runs outside a managed cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lacuna", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and last-wins map keys; used by tests, bench and the command line."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LACUNA_DRIVER_MEMORY", memory))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of a test data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on
    a cluster that would be a folder that executors don't share, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lacuna-shared-")
        spark.sparkContext.setCheckpointDir(found)
    elif jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"


def owned(spark: SparkSession, path: str) -> str:
    """The same path; what is written there is deleted when the driver ends, if nobody has before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows that one task sorts or groups.
ROWS_A_TASK = 500_000


def tasks(frame: DataFrame) -> int:
    """Partitions for sorting or grouping as many rows as the frame has, so that a task's share doesn't grow with the input; the frame is counted, which
    for a table reads no more than its footers."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-frame.count() // ROWS_A_TASK))


def stored(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows read back from Parquet in the shared folder, and their path: computed once, with no lineage to lose, and of a
    size that the optimiser knows."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    owned(frame.sparkSession, path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored`` wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
