"""Seeded draws as Columns: counter-based, so they depend on (seed, key, counter) and on no partitioning.

A draw is the first 32 bits of an MD5; the ``sql_*`` twins state the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def draw(seed: int, key: Column, counter: int | Column) -> Column:
    """A long from 0 to 2 ** 32 - 1."""
    c = counter if isinstance(counter, Column) else F.lit(counter)
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), c.cast("string"))), 1, 8), 16, 10).cast("long")


def uniform(seed: int, key: Column, counter: int | Column) -> Column:
    """A double in [0, 1)."""
    return draw(seed, key, counter) / F.lit(float(SPAN))


def choice(seed: int, key: Column, counter: int | Column, pool: list[str]) -> Column:
    """One of a pool's strings."""
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (F.pmod(draw(seed, key, counter), F.lit(len(pool))) + 1).cast("int"))


def weighted(seed: int, key: Column, counter: int | Column, weights: list[int]) -> Column:
    """An index from 0, with probability in proportion to its weight."""
    at = F.pmod(draw(seed, key, counter), F.lit(sum(weights)))
    out = F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        out = F.when(at < sum(weights[: i + 1]), F.lit(i)).otherwise(out)
    return out.cast("int")


def between(seed: int, key: Column, counter: int | Column, low: int | Column, high: int | Column) -> Column:
    """A long from low to high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.pmod(draw(seed, key, counter), high - low + 1)).cast("long")


def sql_draw(seed: int, key: str, counter: int | str) -> str:
    return f"('0x' || md5('{seed}:' || ({key})::VARCHAR || ':' || ({counter})::VARCHAR)[1:8])::BIGINT"


def sql_uniform(seed: int, key: str, counter: int | str) -> str:
    return f"({sql_draw(seed, key, counter)} / {float(SPAN)}::DOUBLE)"


def sql_list(pool: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in pool) + "]"


def sql_choice(seed: int, key: str, counter: int | str, pool: list[str]) -> str:
    return f"{sql_list(pool)}[({sql_draw(seed, key, counter)} % {len(pool)}) + 1]"


def sql_weighted(seed: int, key: str, counter: int | str, weights: list[int]) -> str:
    at, total, cases = f"({sql_draw(seed, key, counter)} % {sum(weights)})", 0, ""
    for i, w in enumerate(weights):
        total += w
        cases += f" WHEN {at} < {total} THEN {i}"
    return f"(CASE{cases} END)::INTEGER"


def sql_between(seed: int, key: str, counter: int | str, low: int | str, high: int | str) -> str:
    return f"(({low}) + {sql_draw(seed, key, counter)} % (({high}) - ({low}) + 1))::BIGINT"
