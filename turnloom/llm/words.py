"""Column helpers shared by the operators: the word class, word counts, and null-safe group keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D. Everything else belongs to a word.
GAP = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of [^GAP] in the text; 0 for null. One regex pass, no array of words."""
    first = F.regexp_replace(text, f"[{GAP}]*([^{GAP}])[^{GAP}]*[{GAP}]*", "$1")
    return F.coalesce(F.when(F.regexp_like(text, F.lit(f"[^{GAP}]")), F.length(first)).otherwise(0), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words of the text in order; an empty array for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{GAP}]+")
    # Only the first and the last part can be empty.
    start = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    end = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, start, F.greatest(F.size(parts) - start + 1 - end, F.lit(0)))


def group_key(c: Column) -> Column:
    """A string that is never null and tells null from every value, so that null is a group of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def only_if(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where the condition holds, for conditions on costly computed columns.

    A plain filter is pushed through the projections below it, where it repeats their expressions, inside
    lambdas once for each element. A generator is not.
    """
    return df.withColumn("__only_if", F.explode(F.when(condition, F.array(F.lit(True))))).drop("__only_if")
