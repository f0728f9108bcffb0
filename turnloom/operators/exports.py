"""Versions of exported models: names, order, the next one, and what a reference means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^(.+)_([0-9]+(?:\.[0-9]+)*)\.txt$"


def base_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, NAME, 1), F.lit(""))


def version_of(name: Column) -> Column:
    """The version as an array of ints, null if the name is no export's. Arrays order as versions do."""
    dotted = F.nullif(F.regexp_extract(name, NAME, 2), F.lit(""))
    return F.transform(F.split(dotted, r"\."), lambda p: p.cast("int"))


def dotted(version: Column) -> Column:
    return F.array_join(version.cast("array<string>"), ".")


def file_name(base: Column, version: Column) -> Column:
    return F.concat(base, F.lit("_"), dotted(version), F.lit(".txt"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, modified, base, version of the exports in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", F.col("modificationTime").alias("modified"))
    return parsed(files.withColumn("name", F.regexp_extract("path", "[^/]*$", 0)))


def parsed(files: DataFrame) -> DataFrame:
    return files.withColumns({"base": base_of(F.col("name")), "version": version_of(F.col("name"))}).where("base is not null")


def next_versions(exports: DataFrame) -> DataFrame:
    """base, name: where the next export of each base goes, one past the highest version."""
    top = exports.groupBy("base").agg(F.max("version").alias("v"), F.collect_set("name").alias("names"))
    n = F.size("v")
    up = F.concat(F.slice("v", 1, n - 1), F.array(F.element_at("v", -1) + 1))
    # Another spelling may hold the name already (1.03 for 1.3): then the first free number nested under it.
    nested = F.filter(F.transform(F.sequence(F.lit(1), F.size("names") + 1), lambda i: file_name(F.col("base"), F.concat(up, F.array(i)))), lambda x: ~F.array_contains("names", x))
    taken = F.array_contains("names", file_name(F.col("base"), up))
    return top.select("base", F.when(taken, F.get(nested, F.lit(0))).otherwise(file_name(F.col("base"), up)).alias("name"))


def first_name(base: str) -> str:
    return f"{base}_1.0.txt"


def resolved(exports: DataFrame, references: DataFrame) -> DataFrame:
    """references: (reference). reference, name: a file's name, a name without .txt, a base's highest version, or for
    the empty reference the newest file; null if nothing fits."""
    exact = exports.select(F.col("name").alias("reference"), F.col("name").alias("found"), F.lit(0).alias("rank"))
    short = exports.select(F.regexp_replace("name", r"\.txt$", ""), "name", F.lit(1))
    best = exports.groupBy("base").agg(F.max_by("name", F.struct("version", "name"))).withColumn("rank", F.lit(2))
    newest = exports.agg(F.max_by("name", F.struct("modified", "name")).alias("found")).select(F.lit(""), "found", F.lit(3))
    ways = exact.union(short).union(best).union(newest)
    found = references.join(ways, "reference", "left").groupBy("reference").agg(F.min_by("found", "rank").alias("name"))
    return found
