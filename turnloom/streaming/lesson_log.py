"""The lesson log as a stream: JSON lines appended to a folder, turned into (wording, answer) pairs.

The query is stateless unless duplicates are to fall, so it scales with its input's partitions; with
``dedup`` state is bounded by a watermark on the records' own time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import lessons


def append(records: DataFrame, folder: str) -> None:
    """Appends records as JSON lines."""
    records.write.mode("append").json(folder)


def pairs(spark: SparkSession, folder: str, dedup: str | None = None) -> DataFrame:
    """A streaming frame of wording, answer. dedup: a delay such as "1 hour" within which a repeated pair is dropped."""
    lines = spark.readStream.format("text").load(folder)
    log = lessons.records(lines)
    if dedup is None:
        return lessons.past_pairs(log)
    timed = log.where(~F.coalesce("rolled_back", F.lit(False))).select(F.to_timestamp("when").alias("at"), "question", "answer", "trained_wordings")
    said = F.when(F.size(F.coalesce("trained_wordings", F.array().cast("array<string>"))) > 0, F.col("trained_wordings")).otherwise(F.array("question"))
    return timed.withWatermark("at", dedup).select("at", F.explode(said).alias("wording"), "answer").dropDuplicatesWithinWatermark(["wording", "answer"]).select("wording", "answer")


def run_once(spark: SparkSession, source: str, target: str, state: str, dedup: str | None = None) -> DataFrame:
    """Processes what is there, exactly once across calls with the same state folder, and returns the target's table."""
    q = pairs(spark, source, dedup).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("wording string, answer string").parquet(target)


def summaries(spark: SparkSession, source: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A streaming count of lessons kept and undone by event-time window."""
    log = lessons.records(spark.readStream.format("text").load(source)).select(F.to_timestamp("when").alias("at"), F.coalesce("rolled_back", F.lit(False)).alias("undone"))
    return log.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("lessons"), F.sum(F.col("undone").cast("long")).alias("undone"))
