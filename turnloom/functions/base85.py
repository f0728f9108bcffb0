"""Base85 as column expressions: four bytes are five digits, the highest first; of a last group of r bytes r + 1 digits are kept.

Bytes are strings of hexadecimal digits here. A row's text is cut by one pass of a pattern, so time is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits in order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~"
PLACES = [85**k for k in (4, 3, 2, 1, 0)]


def encoded(hexed: Column) -> Column:
    """The digits of the bytes in ``hexed``; null for null."""
    words = F.transform(F.regexp_extract_all(hexed, F.lit(".{1,8}"), F.lit(0)), lambda x: F.struct(F.conv(F.rpad(x, 8, "0"), 16, 10).cast("bigint").alias("v"), (F.length(x) / 2 + 1).cast("int").alias("n")))
    digit = lambda v, place: F.substr(F.lit(DIGITS), (F.floor(v / place) % 85 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.left(F.concat(*[digit(w["v"], p) for p in PLACES]), w["n"])), "")


def _value(five: Column) -> Column:
    return sum(((F.instr(F.lit(DIGITS), F.substr(five, F.lit(i + 1), F.lit(1))) - 1).cast("bigint") * p for i, p in enumerate(PLACES)), F.lit(0).cast("bigint"))


def words(digits: Column) -> Column:
    """The numbers of four bytes that the digits stand for; the bytes that a short last group lacks are arbitrary."""
    return F.transform(F.regexp_extract_all(digits, F.lit(".{1,5}"), F.lit(0)), lambda g: _value(F.rpad(g, 5, "~")))


def decoded(digits: Column) -> Column:
    """Hexadecimal digits of the bytes; null for null, for other characters, and where a group exceeds four bytes."""
    parts = F.transform(F.regexp_extract_all(digits, F.lit(".{1,5}"), F.lit(0)), lambda g: F.struct(_value(F.rpad(g, 5, "~")).alias("v"), (2 * (F.length(g) - 1)).alias("n")))
    out = F.transform(parts, lambda x: F.when(x["v"] < 1 << 32, F.left(F.lpad(F.hex(x["v"]), 8, "0"), x["n"])))
    clean = F.regexp_like(digits, F.lit(r"\A[0-9A-Za-z!#$%&()*+\-;<=>?@^_`{|}~]*\z"))
    return F.when(clean & ~F.exists(out, lambda x: x.isNull()), F.array_join(out, ""))
