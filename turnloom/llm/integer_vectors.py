"""Vectors as whole numbers: which rows take part, and their entries times 256, rounded down. Shared by whitening and by vector codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def whole(v: Column) -> Column:
    """Every entry c as floor(256 c), a long (the nearest long, where it lies beyond)."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * 256))


def commonest_length(vectors: DataFrame, column: str) -> int:
    """The length, above 0, of most vectors (of equally common ones, the greatest); 0 without any."""
    sizes = vectors.groupBy(F.size(column).alias("size")).count().where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else 0
