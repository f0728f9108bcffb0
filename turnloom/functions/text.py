"""Column functions on turns and texts. White space is Unicode's, as \\s with (?U)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.markers import BASE, BOT, END, START, THINK, USER

STOPS = END + USER + BOT + START


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def one_line(t: Column) -> Column:
    """A rendered turn is one line: newlines become spaces."""
    return F.translate(t, "\n", " ")


def marker(role: Column) -> Column:
    """Any role but user renders as the bot's."""
    return F.when(role == "user", USER).otherwise(BOT)


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(marker(role), one_line(text), F.lit(END))


def turn_body(line: Column) -> Column:
    """A line without its first and last character."""
    return F.substr(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0)))


def thought_of(t: Column) -> Column:
    return F.when(F.instr(t, THINK) == 0, "").otherwise(strip(F.substring_index(t, THINK, 1)))


def said_of(t: Column) -> Column:
    """Text after the first think marker, stripped; the text as it is without one."""
    return F.when(F.instr(t, THINK) == 0, t).otherwise(strip(F.substr(t, F.instr(t, THINK) + 1)))


def displayed(t: Column) -> tuple[Column, Column]:
    """(working, reply) as a reader sees them: the working is null without a think marker, an empty reply behind one is named."""
    there = F.instr(t, THINK) > 0
    return F.when(there, thought_of(t)), F.when(there, F.coalesce(F.nullif(said_of(t), F.lit("")), F.lit("(no reply)"))).otherwise(t)


def before_stop(t: Column) -> Column:
    """Up to the first stop marker or newline, by a translation, which costs less than a pattern."""
    return F.substring_index(F.translate(t, STOPS, "\n" * len(STOPS)), "\n", 1)


def truncated_reply(t: Column) -> Column:
    """Up to the first stop marker or newline, stripped; the think marker is no stop."""
    return strip(before_stop(t))


#: Units of a loop, and the white space that (?U)\s means.
UNITS = range(2, 15)
WHITE = np.isin(np.arange(0x3002), [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
AT_ONCE = 1 << 20
STUTTERED = 12
_STUTTER = r"(?sU)^(.*?\b(\w{1,12}))\s+\2\b"


def _first_loops(texts: list[str]) -> np.ndarray:
    """How many characters end with the first unit of n characters, at least two of them not white space, that stands three times in a row: the first
    place, then the least n. Without one 0, or -1 where a word may be stuttered. A unit three times is a run of 2 n places whose character comes again n places on; many texts at once."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    a = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
    a[ends - 1] = 0x110000 + np.arange(len(texts), dtype=np.uint32)  # no two are equal, so that no run leaves its text
    solid = np.concatenate([[0], np.cumsum(~WHITE[np.minimum(a, 0x3001)])])
    best = np.full(len(texts), 1 << 62)
    for n in UNITS:
        same = np.flatnonzero(a[:-n] == a[n:])
        runs = same[: len(same) - 2 * n + 1][same[2 * n - 1 :] - same[: len(same) - 2 * n + 1] == 2 * n - 1] if len(same) >= 2 * n else same[:0]
        runs = runs[solid[runs + n] - solid[runs] >= 2]
        np.minimum.at(best, np.searchsorted(ends, runs, "right"), runs * 16 + n)
    begins = ends - [len(t) + 1 for t in texts]
    return np.where(best < 1 << 62, best // 16 + best % 16 - begins, np.where(_may_stutter(a, ends), -1, 0))


def _may_stutter(a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts have up to STUTTERED characters on both sides of white space, with no ASCII letter or digit beside them: few of those without a stutter."""
    pad = np.full(STUTTERED + 1, 0xFFFFFFFF, np.uint32)
    a = np.concatenate([pad, a, pad])
    white = WHITE[np.minimum(a, 0x3001)]
    low, high = np.flatnonzero(white[1:] & ~white[:-1]) + 1, np.flatnonzero(white[:-1] & ~white[1:]) + 1
    letter = np.zeros(129, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    letter, found = letter[np.minimum(a, 128)], np.zeros(len(ends), bool)
    for n in range(1, STUTTERED + 1):
        x, y = low - n, high
        for i in dict.fromkeys((0, n - 1, *range(n))):
            same = a[x + i] == a[y + i]
            x, y = x[same], y[same]
        alone = ~(letter[x - 1] | letter[y + n])
        found[np.searchsorted(ends + len(pad), x[alone], "right")] = True
    return found


def _loop_ends(texts: pd.Series) -> pd.Series:
    said, out, low = [t or "" for t in texts], [], 0
    while low < len(said):
        high, size = low, 0
        while high < len(said) and size < AT_ONCE:
            size += len(said[high])
            high += 1
        out.extend(_first_loops(said[low:high]).tolist())
        low = high
    return pd.Series(out, dtype="int32")


def trim_loop(t: Column) -> Column:
    """Cuts a text after the first unit that repeats three times running, else after the first copy of a stuttered word."""
    end, said = F.pandas_udf(_loop_ends, "int")(t), F.regexp_extract(t, _STUTTER, 1)
    return F.when(end > 0, F.left(t, end)).when((end < 0) & (said != ""), said).otherwise(t)


def clean_response(t: Column) -> Column:
    return strip(trim_loop(before_stop(t)))


def normal(t: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 and space as one space, stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9 ]+", " "), " +", " "))


def looks_like_a_sum(question: Column, answer: Column) -> Column:
    return F.regexp_like(question, F.lit(r"[0-9]\s*[-+*/]\s*[0-9]")) & F.regexp_like(answer, F.lit("[0-9]"))


def final_number(t: Column) -> Column:
    """The last whole number of the text as a long; null without one or beyond a long."""
    found = F.regexp_extract_all(t, F.lit(r"-?[0-9]+"), F.lit(0))
    return F.get(found, F.size(found) - 1).try_cast("bigint")


def characters(t: Column) -> Column:
    """The text's characters; no element for the empty text."""
    return F.filter(F.split(t, ""), lambda c: c != "")


_BASE_ARRAY = sorted(BASE)


def known_only(t: Column, vocabulary: str = BASE) -> Column:
    """The text without characters that the vocabulary lacks: one negated class, no lambda."""
    return F.regexp_replace(t, "[^" + _class(vocabulary) + "]", "")


def unknown(t: Column, vocabulary: str = BASE) -> Column:
    """Distinct characters that the vocabulary lacks, in code-point order."""
    return F.array_sort(F.array_distinct(characters(F.regexp_replace(t, "[" + _class(vocabulary) + "]", ""))))


def _class(vocabulary: str) -> str:
    return "".join(rf"\x{{{ord(c):x}}}" for c in sorted(set(vocabulary)))


def char_trigrams(t: Column) -> Column:
    n = F.length(t)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


#: The present of "to be" by its subjects.
BE = {"am": ("I",), "are": ("(?i:we)", "(?i:you)", "(?i:they)")}
ASKING_WORDS = ("when", "where", "who", "what", "how")


def agreements() -> list[tuple[str, str]]:
    """Pattern and repair of "is" with another subject, for both orders of words: behind the subject, and behind a word that asks, where it may be drawn together."""
    asking = "|".join(ASKING_WORDS)
    straight = [(rf"\b({'|'.join(subjects)}) is\b", rf"\1 {form}") for form, subjects in BE.items()]
    turned = [(rf"\b((?i:{asking}))(?: is|'s|s) ({'|'.join(subjects)})\b", rf"\1 {form} \2") for form, subjects in BE.items()]
    return straight + turned


def agree(t: Column) -> Column:
    """Mends the verb after a subject was put into a template."""
    for pattern, to in agreements():
        t = F.regexp_replace(t, pattern, to.replace("\\", "$"))
    return t


def list_joined(items: Column) -> Column:
    """a, b and c"""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(items, n - 1)))


def decapitalized(t: Column) -> Column:
    """The first letter in lower case, unless the text opens with the pronoun I."""
    return F.when(F.startswith(t, F.lit("I ")) | F.startswith(t, F.lit("I'")), t).otherwise(F.concat(F.lower(F.left(t, F.lit(1))), F.substr(t, F.lit(2))))


def capitalized(t: Column) -> Column:
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))


def ratio_bar(x: Column, width: int = 20) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("?" + " " * (width - 1))).otherwise(F.rpad(F.repeat(F.lit("#"), F.bround(x * width).cast("int")), width, "."))
