"""Quality of replies against a training corpus: copies, novelty, spelling, variety, sums.

How far a reply is copied is found by sorted suffixes (prefixes.longest_prefixes), not by trying every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.markers import END
from turnloom.operators.prefixes import longest_prefixes
from turnloom.session import small, spread, staged, text_batches

COPY_LENGTH = 20
#: Words that a task tells of at once, besides those of one text.
MOST_WORDS = 500_000
#: Bytes as they are where they are letters of a-z, else spaces; no byte of a longer character is a letter.
_LETTERS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz" else 32 for b in range(256))


def spelled(replies: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, n_words, n_known: the words of each reply and those in the vocabulary (w). Where the replies have few different words, these are
    shipped, and the vocabulary's others are left out before it is shuffled."""
    said = replies.select(key, F.explode(F.regexp_extract_all(F.lower("reply"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    stored = staged(said.select("w").distinct(), "said")
    few = small(stored)
    words = words if few is stored else words.join(few, "w", "left_semi")
    known = said.join(words.select("w", F.lit(1).alias("known")), "w", "left")
    return known.groupBy(key).agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_known"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lower-cased text) to (w): the task's different words of a-z, perhaps more than once."""
    seen: set[bytes] = set()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string())], ["w"])
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text:
                seen.update(text.translate(_LETTERS).split())
                if len(seen) >= MOST_WORDS:
                    yield out()
    yield out()


def word_vocabulary(texts: DataFrame) -> DataFrame:
    """w: the distinct words of a-z in the lower-cased texts."""
    text_batches(texts.sparkSession)
    return spread(texts.select("text")).select(F.lower("text").alias("text")).mapInArrow(_words, "w string").distinct()


def variety(reply: Column) -> Column:
    """Distinct by all character trigrams; null under three characters."""
    grams = T.char_trigrams(reply)
    return F.when(F.length(reply) >= 3, F.size(F.array_distinct(grams)) / F.size(grams))


def parted(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Adds thought, reply and ended of a model's raw output: what it says up to its end marker, without its thought."""
    cut = F.regexp_extract(F.col(text), rf"(?s)^[^{END}]*", 0)
    return raw.withColumns({"ended": F.contains(F.col(text), F.lit(END)), "thought": T.thought_of(cut), "reply": T.said_of(T.strip(cut))})


def summary(replies: DataFrame, lines: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """One row of quality figures over all replies (key, reply, thought, ended)."""
    prefix = longest_prefixes(replies, lines, key)
    whole = replies.join(prefix, key).join(spelled(replies, words, key), key, "left").withColumn("variety", variety(F.col("reply")))
    copied = (F.col("length") >= COPY_LENGTH) & (F.col("prefix") == F.col("length"))
    spoke = F.col("length") > 0
    n = F.count("*")
    share = lambda c: F.round(F.sum(c.cast("double")) / n, 6)
    return whole.agg(
        n.alias("n"), share(F.col("ended")).alias("format_ok"), F.round(F.avg("length"), 6).alias("mean_len"), share(~spoke).alias("empty"),
        F.round(F.sum("n_known") / F.sum("n_words"), 6).alias("spelling"), F.round(F.avg("variety"), 6).alias("variety"), share(copied).alias("exact_copy"),
        F.round(F.sum((spoke & ~copied).cast("double")) / F.greatest(F.lit(1), F.sum(spoke.cast("long"))), 6).alias("new_sentences"),
        F.round(1 - F.sum("prefix") / F.greatest(F.lit(1), F.sum("length")), 6).alias("novelty"),
        F.round(F.avg(F.when(spoke, F.col("prefix"))), 6).alias("mean_copied_prefix"),
        F.round(F.avg(F.length("thought")), 6).alias("mean_thought"), share(F.col("thought") != "").alias("thinks"),
    )
