"""Expressions stated once as SQL text and used by Spark (through F.expr) and by DuckDB.

Both engines share CASE, ||, concat_ws, %, upper, substr and casts; a dialect supplies what differs:
whole division, lists, and draws.
"""

from __future__ import annotations

SPAN = 2**32


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Dialect:
    """name: "spark" or "duckdb"."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def div(self, a: str, b: str | int) -> str:
        """Whole quotient of non-negative numbers."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def text(self, x: str) -> str:
        return f"cast({x} as string)"

    def draw(self, seed: int, key: str, counter: int | str) -> str:
        digest = f"md5('{seed}:' || cast({key} as string) || ':' || cast({counter} as string))"
        return f"cast(conv(substring({digest}, 1, 8), 16, 10) as bigint)" if self.spark else f"('0x' || ({digest})[1:8])::BIGINT"

    def uniform(self, seed: int, key: str, counter: int | str) -> str:
        return f"({self.draw(seed, key, counter)} / cast({SPAN} as double))"

    def pick(self, pool: list[str], index: str) -> str:
        """The pool's string at ``index`` modulo its size."""
        if self.spark:
            return f"element_at(array({', '.join(map(quoted, pool))}), cast(({index}) % {len(pool)} as int) + 1)"
        return f"([{', '.join(map(quoted, pool))}])[({index}) % {len(pool)} + 1]"

    def choice(self, seed: int, key: str, counter: int | str, pool: list[str]) -> str:
        return self.pick(pool, self.draw(seed, key, counter))

    def weighted(self, seed: int, key: str, counter: int | str, weights: list[int]) -> str:
        """An index from 0, drawn by weight."""
        at, total, cases = f"({self.draw(seed, key, counter)} % {sum(weights)})", 0, ""
        for i, w in enumerate(weights[:-1]):
            total += w
            cases += f" WHEN {at} < {total} THEN {i}"
        return f"(CASE{cases} ELSE {len(weights) - 1} END)"

    def between(self, seed: int, key: str, counter: int | str, low: int | str, high: int | str) -> str:
        return f"(({low}) + {self.draw(seed, key, counter)} % (({high}) - ({low}) + 1))"

    def one_of(self, texts: list[str], index: str) -> str:
        """One of those expressions that aren't null, at ``index`` modulo their number; null if all are."""
        if self.spark:
            there = f"array_compact(array({', '.join(texts)}))"
            return f"get({there}, cast(({index}) % greatest(size({there}), 1) as int))"
        there = f"list_filter([{', '.join(texts)}], lambda x: x IS NOT NULL)"
        return f"({there})[({index}) % greatest(len({there}), 1) + 1]"

    def lateral(self, upto: str, alias: str) -> str:
        """A FROM item after a table that repeats each of its rows for alias = 0 .. upto (an expression, not negative)."""
        return f"LATERAL VIEW explode(sequence(0, cast({upto} as int))) AS {alias}" if self.spark else f"CROSS JOIN LATERAL unnest(range(cast({upto} as int) + 1)) AS t_{alias}({alias})"

    def lines(self, order: str, line: str) -> str:
        """Aggregate: lines joined by newlines in the order of a number."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} as o, {line} as l))), x -> x.l), '\n')"
        return f"string_agg({line}, chr(10) ORDER BY {order})"

    def filled(self, template: str, values: dict[str, str]) -> str:
        """The template (an expression) with placeholders replaced by expressions."""
        for name, value in values.items():
            template = f"replace({template}, '{{{name}}}', {value})"
        return template


class Held(Dialect):
    """Draws are read from columns d0, d1, ... that ``held`` adds: each is computed once a row, and expressions stay short."""

    def __init__(self, dialect: Dialect):
        self.spark = dialect.spark

    def draw(self, seed: int, key: str, counter: int | str) -> str:
        return f"d{counter}"


def held(dialect: Dialect, seed: int, key: str, counters) -> list[str]:
    """Select list of the draws as columns."""
    return [f"{dialect.draw(seed, key, i)} AS d{i}" for i in counters]


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")
HELD = Held(SPARK)
