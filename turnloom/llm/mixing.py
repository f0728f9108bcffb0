"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

The budget (``share`` of all words) is poured over the sources by weight; a source stops at
``max_epochs`` times its size and its excess is shared again by weight until none is above. Sorted by
(cap / weight) the fixed point is direct: a source is capped exactly if its cap per weight is no more
than the level that remains for it and those after it. A source's target is then met by whole
repetitions of all its documents and one more copy of a seeded sample of them.

The sample: documents fall by md5(seed, doc_id) into 65,536 buckets, and buckets are taken in order
while the middle of the bucket lies below the words still wanted. Only sums leave the documents, 256 coarse
sums a source and then 256 fine ones of one coarse bucket, so a source that holds most rows costs no
more than another. The taken words miss the target by no more than half of one bucket.

The number of sources is that of a mixing configuration: the level is found over one row a source.

Defined cases: null and blank texts have size 0, are kept in the result and never taken; null sources
are one source, last in order; documents of the same id fall together; no document is taken more than
max_epochs times; repeated rows count each; sources of equal cap by weight are ordered by name, and of equal draw all are taken or none;
texts are counted whole, however long; an empty table gives an empty table; other columns pass through mix_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.words import GAP, group_key, word_count
from turnloom.session import staged

SEED, MAX_EPOCHS, WEIGHTS = 17, 3, (1, 2, 3)


def draw(seed: int, key: Column) -> Column:
    """A bucket from 0 to 65,535, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source_key, source, source_size), one row a source. Adds weight, target (double)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    all_ = Window.partitionBy()
    up = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(up), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(up), F.lit(0))).alias("left_weight"),
    ).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("left_words") / F.col("left_weight"))
    # The level of the first source that isn't capped is the level of all that aren't.
    water = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "left_words", "left_weight"))).over(all_)
    return level.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * water["left_words"] / water["left_weight"])).select("source_key", "source", "source_size", "weight", "target")


def plan_mix(docs: DataFrame, doc_id: Column, source: Column, text: Column, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(sizes, rules): sizes has doc_id, source_key, bucket, size for every document; rules has for every
    source its target, whole repetitions, and the last bucket that is taken once more (-1: none)."""
    sizes = staged(docs.select(doc_id.alias("doc_id"), source.cast("string").alias("source"), group_key(source).alias("source_key"), draw(seed, doc_id).alias("bucket"), word_count(text).alias("size")), "mix-sizes")
    hist = staged(sizes.groupBy("source_key", "source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    per_source = hist.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rules = staged(
        targets(per_source, weights, share, max_epochs)
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-rules",
    )
    wanted = rules.select("source_key", "wanted")
    below = lambda w: F.coalesce(F.sum("words").over(w), F.lit(0))
    # Coarse: the bucket of 256 in which the wanted words run out.
    w1 = Window.partitionBy("source_key").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = (
        hist.groupBy("source_key", F.shiftright("bucket", 8).alias("coarse")).agg(F.sum("words").alias("words"))
        .withColumn("before", below(w1)).join(wanted, "source_key")
        .where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
        .groupBy("source_key").agg(F.min(F.struct("coarse", "before", "wanted")).alias("at"))
        .select("source_key", "at.*")
    )
    w2 = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = (
        hist.withColumn("coarse", F.shiftright("bucket", 8)).join(coarse, ["source_key", "coarse"])
        .withColumn("inside", F.col("before") + below(w2))
        .groupBy("source_key").agg(
            F.max(F.when(2 * F.col("inside") + F.col("words") <= 2 * F.col("wanted"), F.col("bucket"))).alias("last"),
            F.min(F.col("coarse") * 256 - 1).alias("base"),
        )
        .select("source_key", F.coalesce("last", "base").alias("last_bucket"))
    )
    # No coarse bucket runs over: nothing is wanted, or (by rounding) everything.
    full = F.when(F.col("wanted") > 0, 65535).otherwise(-1).cast("long")
    rules = rules.join(fine, "source_key", "left").withColumn("last_bucket", F.coalesce("last_bucket", full))
    return sizes, staged(rules.select("source_key", "source_size", "weight", "target", "whole", "last_bucket"), "mix-plan")


def repetitions(bucket: Column, whole: Column, last_bucket: Column) -> Column:
    return (whole + F.when(bucket <= last_bucket, 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sizes, rules = plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text"), **how)
    return sizes.join(rules, "source_key", "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * repetitions(F.col("bucket"), F.col("whole"), F.col("last_bucket"))).alias("taken"),
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    seed = how.get("seed", SEED)
    _, rules = plan_mix(docs, F.col("doc_id"), F.col("source"), F.col("text"), **how)
    rules = rules.select(F.col("source_key").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("last_bucket").alias("__mix_last"))
    times = repetitions(draw(seed, F.col("doc_id")), F.col("__mix_whole"), F.col("__mix_last"))
    return (
        docs.withColumn("__mix_source", group_key(F.col("source"))).join(rules, "__mix_source", "left")
        .where(F.regexp_like(F.col("text"), F.lit(f"[^{GAP}]")))
        .withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select(*docs.columns)
    )
