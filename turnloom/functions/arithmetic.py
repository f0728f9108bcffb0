"""Worked arithmetic: for two operands ``l`` and ``r`` (columns), one text a method, or NULL where it doesn't apply.

Every text holds the true answer. Operands have up to four digits; each method is one expression.
"""

from __future__ import annotations

from turnloom.functions.dialect import Dialect

PLACES = ("ones", "tens", "hundreds", "thousands")


class Workings:
    def __init__(self, dialect: Dialect, l: str = "l", r: str = "r"):  # noqa: E741
        self.d, self.l, self.r = dialect, l, r

    def _s(self, *parts: str) -> str:
        """Parts joined: text between bars is literal, anything else a number."""
        return " || ".join("'" + p[1:].replace("'", "''") + "'" if p.startswith("|") else self.d.text(p) for p in parts)

    def _digit(self, n: str, i: int) -> str:
        return f"({self.d.div(n, 10**i)} % 10)"

    def _place(self, n: str, i: int) -> str:
        return f"({self._digit(n, i)} * {10**i})"

    def _places(self, n: str) -> str:
        """How many places aren't zero."""
        return "(" + " + ".join(f"CASE WHEN {self._digit(n, i)} > 0 THEN 1 ELSE 0 END" for i in range(4)) + ")"

    def _listed(self, glue: str, items: list[tuple[str, str]]) -> str:
        return f"concat_ws('{glue}', " + ", ".join(f"CASE WHEN {when} THEN {then} END" for when, then in items) + ")"

    def add(self) -> dict[str, str]:
        d, l, r = self.d, self.l, self.r  # noqa: E741
        total, big = f"({l} + {r})", f"greatest({l}, {r})"
        by_place = [(f"{self._place(l, i)} + {self._place(r, i)} > 0", i) for i in (3, 2, 1, 0)]
        carry = [f"{d.div(f'{l} % {10**i} + {r} % {10**i}', 10**i)}" for i in range(5)]
        column = lambda i: f"({self._digit(l, i)} + {self._digit(r, i)} + {carry[i]})"
        carried = []
        for i in range(4):
            text = self._s(f"|the {PLACES[i]} give ", self._digit(l, i), "| + ", self._digit(r, i))
            text += f" || CASE WHEN {carry[i]} > 0 THEN {self._s('| and ', carry[i], '| carried over')} ELSE '' END || " + self._s("| = ", column(i))
            text += f" || CASE WHEN {column(i)} >= 10 THEN {self._s('|, put down ', f'({column(i)} % 10)', '| and carry ', d.div(column(i), 10))} ELSE '' END"
            carried.append((f"{big} >= {10**i if i else 0}", text))
        last = " ".join(f"WHEN {big} < {10 ** (i + 1)} AND {big} >= {10**i if i else 0} THEN {carry[i + 1]}" for i in range(4))
        any_carry = " OR ".join(f"{c} > 0" for c in carry[1:])
        up, tens, ones = f"(10 - {r} % 10)", f"({r} - {r} % 10)", f"({r} % 10)"
        return {
            "add_place_value": f"CASE WHEN {big} >= 10 THEN 'By place: ' || {self._listed('; ', [(w, self._s(f'|{PLACES[i]} ', self._place(l, i), '| + ', self._place(r, i), '| = ', f'({self._place(l, i)} + {self._place(r, i)})')) for w, i in by_place])} || '. In all, ' || {self._listed(' + ', [(w, self._s(f'({self._place(l, i)} + {self._place(r, i)})')) for w, i in by_place])} || {self._s('| = ', total, '|.')} END",
            "add_carry": f"CASE WHEN {big} >= 10 AND ({any_carry}) THEN 'In columns: ' || {self._listed('; ', carried)} || CASE WHEN (CASE {last} END) > 0 THEN '; the last carry leads the answer' ELSE '' END || {self._s('|. The digits read ', total, '|.')} END",
            "add_round": f"CASE WHEN {r} >= 10 AND {r} % 10 <> 0 THEN {self._s('|Take ', r, '| as ', f'({r} + {up})', '|, which is ', up, '| too many: ', l, '| + ', f'({r} + {up})', '| = ', f'({total} + {up})', '|. Less ', up, '| is ', total, '|.')} END",
            "add_hop": f"CASE WHEN {tens} > 0 AND {ones} > 0 THEN {self._s('|From ', l, '| hop ', tens, '| to ', f'({l} + {tens})', '|, then ', ones, '| to ', total, '|.')} END",
            "add_small": f"CASE WHEN {l} <= 9 AND {r} <= 9 THEN {self._s(l, '| with ', r, '| is ', total, '|.')} END",
        }

    def sub(self) -> dict[str, str]:
        d, l, r = self.d, self.l, self.r  # noqa: E741
        left, floor = f"({l} - {r})", f"({l} - {l} % 10)"
        ten = f"(10 - {r} % 10)"
        s1 = f"(CASE WHEN {r} % 10 <> 0 AND {r} + {ten} <= {l} THEN {ten} ELSE 0 END)"
        at1 = f"({r} + {s1})"
        s2 = f"(CASE WHEN {floor} > {at1} THEN {floor} - {at1} ELSE 0 END)"
        at2 = f"({at1} + {s2})"
        s3 = f"({l} - {at2})"
        steps = [(f"{s} > 0", self._s(a, "| to ", f"({a} + {s})", "| makes ", s)) for a, s in ((r, s1), (at1, s2), (at2, s3))]
        sums = [(f"{s} > 0", self._s(s)) for s in (s1, s2, s3)]
        count = "(" + " + ".join(f"CASE WHEN {s} > 0 THEN 1 ELSE 0 END" for s in (s1, s2, s3)) + ")"
        tens, ones = f"({r} - {r} % 10)", f"({r} % 10)"
        fits = f"{r} <= {l}"
        return {
            "sub_count_up": f"CASE WHEN {fits} AND {count} >= 2 THEN {self._s('|Climb from ', r, '|: ')} || {self._listed(', ', steps)} || '. Steps: ' || {self._listed(' + ', sums)} || {self._s('| = ', left, '|.')} END",
            "sub_in_parts": f"CASE WHEN {fits} AND {tens} > 0 AND {ones} > 0 THEN {self._s(l, '| less ', tens, '| is ', f'({l} - {tens})', '|, less ', ones, '| more is ', left, '|.')} END",
            "sub_borrow": f"CASE WHEN {fits} AND {l} >= 10 AND {r} >= 10 AND {l} % 10 < {r} % 10 THEN {self._s('|', f'({l} % 10)', '| is too few to take ', ones, '| from, so borrow: ', f'({l} % 10 + 10)', '| - ', ones, '| = ', f'({l} % 10 + 10 - {ones})', '|. With the tens one down, ', left, '| is left.')} END",
            "sub_round": f"CASE WHEN {fits} AND {r} >= 10 AND {ones} <> 0 THEN {self._s('|Take away ', f'({r} + {ten})', '| instead: ', f'({left} - {ten})', '|. That was ', ten, '| too much, so ', left, '|.')} END",
            "sub_negative": f"CASE WHEN {r} > {l} THEN {self._s('|It falls below zero: ', r, '| - ', l, '| = ', f'({r} - {l})', '|, so the answer is ', left, '|.')} END",
            "sub_small": f"CASE WHEN {l} <= 9 AND {r} <= 9 AND {fits} THEN {self._s(l, '| without ', r, '| is ', left, '|.')} END",
        }

    def mul(self) -> dict[str, str]:
        d, l, r = self.d, self.l, self.r  # noqa: E741
        total, wide, narrow = f"({l} * {r})", f"greatest({l}, {r})", f"least({l}, {r})"

        def split(n: str, by: str) -> tuple[str, str]:
            on = [(f"{self._digit(n, i)} > 0", i) for i in (3, 2, 1, 0)]
            return (
                self._listed(", ", [(w, self._s(self._place(n, i), "| * ", by, "| = ", f"({self._place(n, i)} * {by})")) for w, i in on]),
                self._listed(" + ", [(w, self._s(f"({self._place(n, i)} * {by})")) for w, i in on]),
            )

        parts, sums = split(r, l)
        wparts, wsums = split(wide, narrow)
        doubles = lambda k: self._listed(", ", [("true", self._s(f"({l} * {2**j})")) for j in range(1, k + 1)])
        gap = f"(10 - {r})"
        return {
            "mul_distribute": f"CASE WHEN {r} >= 10 AND {self._places(r)} >= 2 THEN {self._s('|Split ', r, '|: ')} || {parts} || '. Sum: ' || {sums} || {self._s('| = ', total, '|.')} END",
            "mul_by_place": f"CASE WHEN {wide} >= 10 AND {narrow} <= 12 AND {self._places(wide)} >= 2 THEN 'Place by place: ' || {wparts} || '. Sum: ' || {wsums} || {self._s('| = ', total, '|.')} END",
            "mul_double": f"CASE WHEN {r} IN (2, 4, 8, 16) THEN {self._s('|Double ', l, '|: ')} || CASE {r} WHEN 2 THEN {doubles(1)} WHEN 4 THEN {doubles(2)} WHEN 8 THEN {doubles(3)} ELSE {doubles(4)} END || '.' END",
            "mul_half_ten": f"CASE WHEN {r} = 5 THEN {self._s('|Ten times ', l, '| is ', f'({l} * 10)', '|; half of it is ', total, '|.')} END",
            "mul_near_ten": f"CASE WHEN {r} BETWEEN 7 AND 9 THEN {self._s('|Ten times ', l, '| is ', f'({l} * 10)', '|, less ', gap, '| times ', l, '| (', f'({l} * {gap})', '|) is ', total, '|.')} END",
            "mul_repeated": f"CASE WHEN {r} <= 4 AND {l} <= 20 AND {r} >= 1 THEN {self._s('|Count ', l, '|s: ')} || {self._listed(', ', [(f'{r} >= {j}', self._s(f'({l} * {j})')) for j in range(1, 5)])} || '.' END",
            "mul_small": f"CASE WHEN {l} <= 9 AND {r} <= 9 THEN {self._s(l, '| times ', r, '| is ', total, '|.')} END",
        }

    def div(self) -> dict[str, str]:
        d, l, r = self.d, self.l, self.r  # noqa: E741
        q, rest = d.div(l, r), f"({l} % {r})"
        on = [(f"{self._digit(q, i)} > 0", i) for i in (3, 2, 1, 0)]
        above = lambda i: f"({d.div(q, 10**i)} * {10**i})"  # noqa: E731  the quotient's places down to i
        chunks = self._listed("; ", [(w, self._s(self._place(q, i), "| lots are ", f"({r} * {self._place(q, i)})", "|, so ", f"({l} - {r} * {above(i)})", "| stays")) for w, i in on])
        sums = self._listed(" + ", [(w, self._s(self._place(q, i))) for w, i in on])
        return {
            "div_how_many": f"CASE WHEN {rest} = 0 THEN {self._s(r, '| * ', q, '| = ', l, '|, so ', r, '| goes ', q, '| times.')} END",
            "div_chunk": f"CASE WHEN {q} >= 10 AND {self._places(q)} >= 2 THEN 'In chunks: ' || {chunks} || '. In all ' || {sums} || {self._s('| = ', q)} || CASE WHEN {rest} > 0 THEN {self._s('|, and ', rest, '| over')} ELSE '' END || '.' END",
            "div_remainder": f"CASE WHEN {rest} <> 0 AND {q} = 0 THEN {self._s(r, '| is more than ', l, '|, so it goes 0 times with ', l, '| over.')} WHEN {rest} <> 0 THEN {self._s(r, '| * ', q, '| = ', f'({r} * {q})', '|; ', l, '| - ', f'({r} * {q})', '| = ', rest, '|. That is ', q, '| and ', rest, '| over.')} END",
            "div_halve": f"CASE WHEN {rest} = 0 AND {r} = 2 THEN {self._s('|Half of ', l, '| is ', q, '|.')} WHEN {rest} = 0 AND {r} = 4 THEN {self._s('|Half of ', l, '| is ', d.div(l, 2), '|, and half again is ', q, '|.')} END",
            "div_small": f"CASE WHEN {l} <= 81 AND {rest} = 0 THEN {self._s(l, '| shared by ', r, '| is ', q, '|.')} END",
        }

    def methods(self, op: str) -> dict[str, str]:
        return {"+": self.add, "-": self.sub, "*": self.mul, "/": self.div}[op]()


#: Percentages asked for are one part in so many; what they are taken of is a number of hundreds.
PARTS, HUNDREDS = (2, 4, 5, 10, 20, 25, 50), 12


def other_problem(d: Dialect, kind: str, seed: int, key: str) -> tuple[str, str, str]:
    """(question, working, answer) of a problem that isn't l op r, drawn by key."""
    t = d.text
    if kind == "percent":
        parts = f"cast({d.pick([str(p) for p in PARTS], d.draw(seed, key, 1))} as bigint)"
        pct, base = d.div("100", parts), f"({d.between(seed, key, 2, 1, HUNDREDS)} * 100)"
        part = d.div(base, parts)
        return f"{t(pct)} || '% of ' || {t(base)} || '?'", f"{t(pct)} || ' percent is one part in ' || {t(parts)} || '; ' || {t(base)} || ' in ' || {t(parts)} || ' parts: ' || {t(part)} || '.'", t(part)
    if kind == "square":
        n = d.between(seed, key, 1, 11, 40)
        tens, ones = f"({n} - {n} % 10)", f"({n} % 10)"
        split = f"{t(n)} || ' * ' || {t(tens)} || ' = ' || {t(f'({n} * {tens})')} || ', ' || {t(n)} || ' * ' || {t(ones)} || ' = ' || {t(f'({n} * {ones})')} || ', together ' || {t(f'({n} * {n})')} || '.'"
        round_ = f"{t(d.div(tens, 10))} || ' squared is ' || {t(f'({d.div(tens, 10)} * {d.div(tens, 10)})')} || ', with two noughts ' || {t(f'({n} * {n})')} || '.'"
        return f"{t(n)} || ' squared?'", f"CASE WHEN {ones} = 0 THEN {round_} ELSE {split} END", t(f"({n} * {n})")
    if kind == "three":
        a, b, c = (d.between(seed, key, i, 4, 60) for i in (1, 2, 3))
        return f"'Add ' || {t(a)} || ', ' || {t(b)} || ' and ' || {t(c)} || '.'", f"{t(a)} || ' + ' || {t(b)} || ' = ' || {t(f'({a} + {b})')} || ', + ' || {t(c)} || ' = ' || {t(f'({a} + {b} + {c})')} || '.'", t(f"({a} + {b} + {c})")
    if kind == "round":
        place = f"(CASE WHEN {d.draw(seed, key, 1)} % 2 = 0 THEN 10 ELSE 100 END)"
        n = d.between(seed, key, 2, d.div(place, 2), f"20 * {place}")
        rest, down = f"({n} % {place})", f"({n} - {n} % {place})"
        near = f"(CASE WHEN {rest} * 2 >= {place} THEN {down} + {place} ELSE {down} END)"
        near = f"(CASE WHEN {rest} = 0 THEN {n} ELSE {near} END)"
        working = f"CASE WHEN {rest} = 0 THEN {t(n)} || ' is whole already.' ELSE {t(n)} || ' lies between ' || {t(down)} || ' and ' || {t(f'({down} + {place})')} || ', ' || {t(rest)} || ' above, so ' || {t(near)} || '.' END"
        return f"'Round ' || {t(n)} || ' to the nearest ' || {t(place)} || '.'", working, t(near)
    spend = f"({d.draw(seed, key, 1)} % 100 < 55)"
    a = f"(CASE WHEN {spend} THEN {d.between(seed, key, 2, 20, 400)} ELSE {d.between(seed, key, 2, 20, 300)} END)"
    b = f"(CASE WHEN {spend} THEN {d.between(seed, key, 3, 5, f'{a} - 1')} ELSE {d.between(seed, key, 3, 5, 90)} END)"
    total = f"(CASE WHEN {spend} THEN {a} - {b} ELSE {a} + {b} END)"
    sign = f"CASE WHEN {spend} THEN ' - ' ELSE ' + ' END"
    tens = f"({b} - {b} % 10)"
    middle = f"(CASE WHEN {spend} THEN {a} - {tens} ELSE {a} + {tens} END)"
    question = f"CASE WHEN {spend} THEN 'Of ' || {t(a)} || ' pegs ' || {t(b)} || ' are lost. How many stay?' ELSE 'To ' || {t(a)} || ' pegs come ' || {t(b)} || ' more. How many now?' END"
    working = f"{t(a)} || {sign} || {t(tens)} || ' = ' || {t(middle)} || ', then ' || {t(f'({b} % 10)')} || ': ' || {t(total)} || '.'"
    return question, working, t(total)


OTHERS = ("percent", "square", "three", "round", "word")
