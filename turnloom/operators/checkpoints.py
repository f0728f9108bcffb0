"""Checkpoints as tables, encoded corpora kept by signature, and guards on what a model can read."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators.corpus import Codec
from turnloom.operators.network import Config, Network
from turnloom.session import staged

TENSORS = "ord int, name string, shape array<int>, values array<double>, meta string"


def save(spark: SparkSession, net: Network, symbols: list[str], path: str) -> None:
    """A row a tensor; configuration and symbols stand with the first."""
    meta = json.dumps({"config": net.config.__dict__, "symbols": symbols})
    rows = [(i, name, list(v.shape), v.ravel().tolist(), meta if i == 0 else None) for i, (name, v) in enumerate(net.p.items())]
    spark.createDataFrame(rows, TENSORS).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Network, list[str]]:
    """The network and its symbols. A model is a few megabytes."""
    rows = spark.read.schema(TENSORS).parquet(path).orderBy("ord").collect()
    if not rows or rows[0]["meta"] is None:
        raise ValueError(f"no checkpoint in {path}")
    meta = json.loads(rows[0]["meta"])
    return Network(Config(**meta["config"]), {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}), meta["symbols"]


def missing_symbols(texts: DataFrame, symbols: list[str], text: str = "text") -> DataFrame:
    """ch, n: characters that the symbols lack and the texts that have them. Bounded by Unicode."""
    return texts.select(F.explode(T.unknown(F.col(text), "".join(symbols))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def guard_vocabulary(texts: DataFrame, symbols: list[str], text: str = "text") -> None:
    """An error if training would go on with characters that the model has no symbol for."""
    lost = missing_symbols(texts, symbols, text).orderBy("ch").limit(20).collect()
    if lost:
        raise ValueError("the model has no symbol for: " + " ".join(repr(r["ch"]) for r in lost))


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def first_readable(spark: SparkSession, paths: list[str], symbols: list[str], head: int = 4096) -> str | None:
    """The first file that exists and whose first characters all have symbols."""
    for path in paths:
        if _status(spark, path) is not None:
            start = spark.read.text(path, wholetext=True).select(F.left("value", F.lit(head)).alias("text")).limit(1)
            if start.where(F.size(T.unknown(F.col("text"), "".join(symbols))) > 0).isEmpty():
                return path
    return None


def encoded_corpus(spark: SparkSession, path: str, symbols: list[str], cache: str) -> DataFrame:
    """at, ids of a text file's lines, newline included. Kept in ``cache`` under a signature of the file's time, length
    and the symbols, and read from there while the signature holds."""
    status = _status(spark, path)
    if status is None:
        raise FileNotFoundError(path)
    seal = hashlib.sha256(json.dumps([path, status.getModificationTime(), status.getLen(), symbols]).encode()).hexdigest()[:24]
    kept = f"{cache.rstrip('/')}/ids-{seal}"
    if _status(spark, f"{kept}/_SUCCESS") is None:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), Codec(symbols).encode(F.concat("value", F.lit("\n"))).alias("ids"))
        lines.write.mode("overwrite").parquet(kept)
    return spark.read.schema("at long, ids array<int>").parquet(kept)


def _manifest(spark: SparkSession, cache: str) -> tuple[int, DataFrame]:
    """The newest complete manifest's number, and its rows (file, seal); 0 and none at first."""
    fs, at = _folder(spark, cache)
    numbers = [int(x.getPath().getName().removeprefix("manifest-")) for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName().startswith("manifest-")]
    done = max((n for n in numbers if _status(spark, f"{cache}/manifest-{n}/_SUCCESS") is not None), default=0)
    rows = spark.read.schema("file string, seal string").parquet(f"{cache}/manifest-{done}") if done else spark.createDataFrame([], "file string, seal string")
    return done, rows


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def refresh_encoded(spark: SparkSession, path: str, symbols: list[str], cache: str, at_a_time: int = 1000) -> int:
    """Brings the cache of the encoded files below ``path`` up to date, and returns how many files were read for that.

    A file's seal is of its path, time, length and the symbols. Files whose seal the manifest has are not read; the others are encoded, each into a
    folder of its seal; folders of seals that no file has any more go. The manifest is written last, so what was cut short is done again, over what it left.
    """
    cache = cache.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("_metadata.file_path").alias("file"), "modificationTime", "length")  # without the content
    letters = hashlib.sha256(json.dumps(symbols).encode()).hexdigest()
    seal = F.left(F.sha2(F.concat_ws("|", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"), F.lit(letters)), 256), F.lit(32))
    files = staged(files.select("file", seal.alias("seal"), "path"), "files")
    number, known = _manifest(spark, cache)
    new = files.join(known, "seal", "left_anti").select("file", "seal", "path")
    n, part = 0, []

    def encode() -> None:
        seals = spark.createDataFrame([x[:2] for x in part], "file string, seal string")
        lines = spark.read.text([x[2] for x in part]).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
        told = lines.join(F.broadcast(seals), "file")  # ``at_a_time`` rows
        told.select("file", "block", "at", Codec(symbols).encode(F.concat("value", F.lit("\n"))).alias("ids"), "seal").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seal").parquet(f"{cache}/ids")
        part.clear()

    for r in new.toLocalIterator():
        part.append(tuple(r))
        n += 1
        if len(part) == at_a_time:
            encode()
    if part:
        encode()
    for r in known.join(files, "seal", "left_anti").toLocalIterator():
        remove(spark, f"{cache}/ids/seal={r['seal']}")
    files.select("file", "seal").write.mode("overwrite").parquet(f"{cache}/manifest-{number + 1}")
    if number:
        remove(spark, f"{cache}/manifest-{number}")
    return n


def encoded_files(spark: SparkSession, cache: str) -> DataFrame:
    """file, block, at, ids: the encoded lines of the files in the cache's manifest, newline included; (file, block, at) is their order."""
    cache = cache.rstrip("/")
    _, known = _manifest(spark, cache)
    fs, at = _folder(spark, f"{cache}/ids")
    if not fs.exists(at):
        return spark.createDataFrame([], "file string, block long, at long, ids array<int>")
    told = spark.read.schema("file string, block long, at long, ids array<int>, seal string").parquet(f"{cache}/ids")
    return told.join(known.select("seal"), "seal", "left_semi").select("file", "block", "at", "ids")


def best_so_far(evaluations: DataFrame, patience: int, step: str = "step", loss: str = "loss", run: str = "run") -> DataFrame:
    """run, step, loss, best, stale, stopped: the least loss so far, evaluations since it strictly improved, and whether training has
    stopped by then. A run is one training, so its evaluations are ordered in one task."""
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(step)
    so_far = evaluations.withColumn("before", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    improved = F.col("before").isNull() | (F.col(loss) < F.col("before"))
    runs = so_far.withColumn("best", F.least(loss, "before")).withColumn("since", F.sum(improved.cast("int")).over(w))
    stale = F.row_number().over(Window.partitionBy(run, "since").orderBy(step)) - 1
    marked = runs.withColumn("stale", stale)
    return marked.select(run, step, loss, "best", "stale", F.coalesce(F.max(F.col("stale") >= patience).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("stopped"))


def throughput(runs: DataFrame) -> DataFrame:
    """runs: (place, name, steps, batch, block, seconds). Adds rate, characters a second, and relative, the ratio to the first run's (least place)."""
    rated = runs.withColumn("rate", F.col("steps") * F.col("batch") * F.col("block") / F.col("seconds"))
    first = rated.agg(F.min_by("rate", "place").alias("__first"))
    return rated.join(F.broadcast(first), F.lit(True)).withColumn("relative", F.col("rate") / F.col("__first")).drop("__first")  # one row
