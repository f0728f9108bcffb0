"""Lesson sessions as a keyed stream: one row for each learner's run of lessons without a longer pause.

Two states follow each other, both in RocksDB: the digests of the records that the watermark (``late`` behind the newest record) has not passed, and each
learner's open session windows with their figures. A record met again (the same in all its fields) counts once; a lesson joins every session that lies within
``gap`` of it, which may make one of several, so records may come in any order. A session is told, and forgotten, when the watermark has passed its end by the gap.
Records older than the watermark are dropped, by Spark. So any split into batches gives the same rows as the batch form, as long as no record is later
than ``late``. A learner's records of one batch meet in one task, which sorts and folds them; neither they nor a session's digests are held at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import lessons

FIGURES = ("lessons", "kept", "undone", "learned", "generalized", "drifted", "forgot")
SESSION = "learner string, began timestamp, ended timestamp, " + ", ".join(f"{f} long" for f in FIGURES)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def figures(log: DataFrame, learner: Column) -> DataFrame:
    """learner, at, name (of the record), and a number for each of FIGURES."""
    undone = F.coalesce("rolled_back", F.lit(False))
    decision = lessons.guard(F.col("drift"), F.col("checks"), F.col("checks_baseline"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    values = (F.lit(1).cast("long"), yes(~undone), yes(undone), yes(~undone & F.col("learned")), yes(~undone & F.col("generalized")), yes(decision == "drifted"), yes(decision == "forgot"))
    at = F.to_timestamp("when")
    name = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in lessons.LOG.names])))
    return log.where(at.isNotNull()).select(learner.alias("learner"), at.alias("at"), name.alias("name"), *[v.alias(f) for v, f in zip(values, FIGURES)])


def stream(lines: DataFrame, learner: Column, gap: int, late: str) -> DataFrame:
    """Streaming (value) lines of a lesson log to sessions; gap in seconds, above 0."""
    if gap <= 0:
        raise ValueError(f"a gap of {gap} seconds: session windows need one above 0")
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    once = figures(lessons.records(lines), learner).withWatermark("at", late).dropDuplicates(["learner", "at", "name"])
    return once.groupBy("learner", F.session_window("at", f"{gap} seconds")).agg(*_told()).drop("session_window")


def _told() -> list[Column]:
    return [F.min("at").alias("began"), F.max("at").alias("ended"), *[F.sum(f).alias(f) for f in FIGURES]]


def batch(log: DataFrame, learner: Column, gap: int) -> DataFrame:
    """The same rows of a whole log (lessons.records): runs of each learner's lessons, repeated records once."""
    once = figures(log, learner).dropDuplicates(["learner", "at", "name"])
    by = Window.partitionBy("learner").orderBy("at", "name")
    begins = F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(by)) > gap * 1_000_000, F.lit(True))
    run = F.sum(begins.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("run", run).groupBy("learner", "run").agg(*_told()).drop("run")


def run_once(spark: SparkSession, source: str, target: str, state: str, learner: Column, gap: int, late: str, files: int = 1, close: bool = False) -> DataFrame:
    """Processes what is there in batches of ``files`` files, exactly once across calls with the same state folder, and returns the sessions told so far.

    close: a record of the year 2260 (the last that Python can tell to the nanosecond, but two) is put behind all others, so that every session is told; it is the log's end.
    """
    def go() -> None:
        read = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source)
        q = stream(read, learner, gap, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    if close:
        end = '{"when": "2260-01-01T00:00:00Z", "question": "", "answer": ""}'
        spark.createDataFrame([(end,)], "value string").coalesce(1).write.mode("append").text(source)
        go()
    return spark.read.schema(SESSION).parquet(target).where("began < '2260-01-01'")
