"""Text and JSON sources and sinks: blocks, pairs, histories, vectors, release notes, corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.markers import BOT, USER
from turnloom.operators.corpus import digest, digest_words, paired
from turnloom.session import staged

HISTORY = "role string, text string, timestamp string"
VECTORS = "about string, tolerance double, greedy_steps int, cases array<struct<prompt:string,ids:array<int>,logits:array<double>,greedy_ids:array<int>,greedy_text:string>>"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """block, lines: the blocks of a file, parted by blank lines; block is unique and ascending within a file."""
    raw = spark.read.option("lineSep", "\n\n").text(path).withColumn("block", F.monotonically_increasing_id())
    body = T.strip(F.col("value"))
    return raw.where(F.regexp_like("value", F.lit(r"(?U)\S"))).select("block", F.split(body, "\n").alias("lines"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, value: the lines of text files; (file, block, at) is their order, whatever the splits: a split tells its first byte, and reads in order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return staged(lines.withColumn("at", F.monotonically_increasing_id()), "lines")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """file, pair, user, bot: lines 2 pair and 2 pair + 1 of a file (blank ones not counted) where they are a user's and a bot's. A pair that
    doesn't match is skipped and counting goes on. A file may have any number of splits."""
    found = paired(ordered_lines(spark, path), ["file", "block", "at"], F.startswith("value", F.lit(USER)), F.startswith("value", F.lit(BOT)), "value", "file")
    return found.select("file", "pair", F.col("first").alias("user"), F.col("second").alias("bot"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """role, text, timestamp of a chat history; no rows where the file is missing."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], HISTORY).withColumn("timestamp", F.to_timestamp("timestamp"))
    return spark.read.schema(HISTORY).json(path, multiLine=True).withColumn("timestamp", F.to_timestamp("timestamp"))


def add_history(turns: DataFrame, path: str) -> None:
    """Appends turns (role, text) with the present time."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    turns.select("role", "text", now.alias("timestamp")).write.mode("append").json(path)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """case, prompt, ids, logits, greedy_ids, greedy_text, tolerance of a conformance file."""
    doc = spark.read.schema(VECTORS).json(path, multiLine=True)
    return doc.select("tolerance", F.posexplode("cases").alias("case", "c")).select("case", "c.*", "tolerance")


def notes(texts: DataFrame, tag: str) -> DataFrame:
    """texts: (value), whole files. section: the part under the heading of the tag's version; empty if there is none."""
    import re

    version = re.escape(tag.lstrip("v"))
    return texts.select(T.strip(F.regexp_extract("value", rf"(?ms)^(## {version}\b.*?)(?=^## |\z)", 1)).alias("section"))


def write_corpus(conversations: DataFrame, path: str) -> DataFrame:
    """Writes (split, text) rows as text files, a folder a split, and returns each split's statistics."""
    conversations.select("split", "text").write.mode("overwrite").partitionBy("split").text(path)
    letters = conversations.select("split", F.explode(F.array_distinct(T.characters(F.concat("text", F.lit("\n"))))).alias("c")).groupBy("split").agg(F.count_distinct("c").alias("distinct_chars"))
    sums = conversations.groupBy("split").agg(F.sum(F.length("text") + 1).alias("chars"), F.count("*").alias("conversations"))
    return sums.join(letters, "split")


def publication(conversations: DataFrame, order: list[str] | None = None) -> DataFrame:
    """What is published of each split: characters, bytes, conversations, turns, and a digest of its conversations in ``order`` (by their text, if none is given)."""
    order = order or ["text"]
    lines = F.filter(F.split("text", "\n"), lambda x: F.startswith(x, F.lit(USER)) | F.startswith(x, F.lit(BOT)))
    each = conversations.select("split", F.length("text").alias("n"), F.octet_length("text").alias("b"), F.size(lines).alias("t"))
    out = each.groupBy("split").agg(F.sum(F.col("n") + 1).alias("chars"), F.sum(F.col("b") + 1).alias("bytes"), F.count("*").alias("conversations"), F.sum("t").alias("turns"))
    digests = None
    for name in [r["split"] for r in out.select("split").collect()]:  # train and held out
        one = digest(digest_words(conversations.where(F.col("split").eqNullSafe(F.lit(name))), order, "text")).select(F.lit(name).alias("of"), "digest")
        digests = one if digests is None else digests.union(one)
    return out.join(digests, F.col("split").eqNullSafe(F.col("of"))).drop("of") if digests is not None else out.withColumn("digest", F.lit(None).cast("string"))


def write_lines(lines: DataFrame, path: str, line: str = "line") -> DataFrame:
    """Writes one line a row, as a corpus of greetings, and returns rows, distinct lines and their ratio."""
    lines.select(line).write.mode("overwrite").text(path)
    counts = lines.agg(F.count("*").alias("rows"), F.count_distinct(line).alias("distinct"))
    return counts.withColumn("ratio", F.round(F.col("distinct") / F.greatest(F.col("rows"), F.lit(1)), 6))


def publish(conversations: DataFrame, path: str, command: str, order: list[str] | None = None) -> str:
    """Writes (split, text, order...) rows and a README.md beside them with each split's figures and digest; returns the README's text."""
    stats = {r["split"]: r for r in write_corpus(conversations, f"{path}/text").collect()}
    made = {r["split"]: r for r in publication(conversations, order).collect()}
    names = sorted(made)
    row = lambda title, values: f"| {title} | " + " | ".join(f"{v:,}" for v in values) + " |"
    figures = [row(f, [made[n][f] for n in names]) for f in ("chars", "bytes", "conversations", "turns")] + [row("distinct characters", [stats[n]["distinct_chars"] for n in names])]
    text = "\n".join(["# Corpus", "", "| | " + " | ".join(names) + " |", "|" + "-|" * (len(names) + 1), *figures, "", *[f"{n}: {made[n]['digest']}" for n in names], "", f"Made by: {command}"])
    spark = conversations.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/README.md")
    return text
