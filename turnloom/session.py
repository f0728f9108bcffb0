"""Session factory and the shared scratch folder.

Nothing here is sized to one machine: partition counts, memory and the scratch folder come from
the cluster's own settings, and only unset values get a default.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: str | None = None
_staged: list[str] = []


def local_session(cores: str = "8", app: str = "turnloom") -> SparkSession:
    """A session for tests and the benchmark: UTC, adaptive execution, partitions sized to the cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder shared by all executors: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    global _own_scratch
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_scratch is None:
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="turnloom-")
    return _own_scratch


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back.

    This cuts the lineage at files that outlive any executor, and gives the planner the table's true
    size: later joins broadcast it only while it is below spark.sql.autoBroadcastJoinThreshold, and
    shuffle it beyond. The files go with release(), or else when the JVM ends.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; the folder goes with release(), or else when the JVM ends."""
    path = f"{scratch(spark)}/turnloom-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all staged tables; to be called when the results made from them are written."""
    jvm = spark.sparkContext._jvm
    while _staged:
        target = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int = 500_000, size: int = 64 << 20) -> DataFrame:
    """A stored table, marked for broadcast if it is counted to be short and its plan's statistics (a stored table's are its files') tell
    of at most ``size`` bytes; else as it is."""
    told = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(told)) <= size and df.count() <= rows else df


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the session's Arrow batches to ``rows`` rows, for rows that hold whole texts; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """A scan whose files give fewer partitions than the cluster has cores, dealt out anew; larger ones, and plans that shuffle, as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
