r"""English forms: plurals, base forms, gerunds, articles and agreement.

Each form is a table of (pattern, replacement) tried in order, the first that fits; the last fits everything. One
table serves columns (``inflected``) and the constants of generated frames (``inflected_word``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nouns without a plural of their own; parameters of the functions below.
PAIRED = ("scissors", "tweezers", "trousers", "goggles", "shears")
UNCOUNTED = ("drizzle", "honey", "sugar", "music", "traffic", "luggage", "rain", "snow", "sand", "advice")
PLURAL_RULES = ((r"(s|x|z|ch|sh)$", r"\1es"), (r"([^aeiou])y$", r"\1ies"), (r"^(.*)$", r"\1s"))
#: "is" and "has" follow no rule.
BASE_RULES = ((r"^is$", "be"), (r"^has$", "have"), (r"ies$", "y"), (r"(s|x|z|ch|sh|o)es$", r"\1"), (r"s$", ""), (r"^(.*)$", r"\1"))
#: An only vowel stays, a silent e goes, and the last letter doubles behind consonants and one vowel.
ING_RULES = ((r"^([^aeiouy]*)e$", r"\1eing"), (r"([^eyo])e$", r"\1ing"), (r"^([^aeiouy]+[aeiou])([^aeiouwxy])$", r"\1\2\2ing"), (r"^(.*)$", r"\1ing"))


def inflected(word: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = word
    for pattern, to in reversed(rules):
        out = F.when(F.regexp_like(word, F.lit(pattern)), F.regexp_replace(word, pattern, to.replace("\\", "$"))).otherwise(out)
    return out


def inflected_word(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    pattern, to = next((p, to) for p, to in rules if re.search(p, word))
    return re.sub(pattern, to, word, count=1)


def plural(word: Column) -> Column:
    return F.when(word.isin(*PAIRED, *UNCOUNTED), word).otherwise(inflected(word, PLURAL_RULES))


def base_form(verb: Column) -> Column:
    """Third person back to the plain verb."""
    return inflected(verb, BASE_RULES)


def gerund(word: Column) -> Column:
    return inflected(word, ING_RULES)


def inflectable(predicate: Column) -> Column:
    """A single verb phrase in the third person: its head ends in s, is not "is", and no second verb is joined by "and"."""
    head = F.regexp_extract(predicate, r"^\s*(\S+)", 1)
    return F.endswith(head, F.lit("s")) & (head != "is") & ~F.regexp_like(predicate, F.lit(r"\band \w+s\b"))


def article(word: Column) -> Column:
    return F.when(F.regexp_like(word, F.lit("^[aeiouAEIOU]")), "an").otherwise("a")


def noun_phrase(word: Column) -> Column:
    return F.when(word.isin(*PAIRED, *UNCOUNTED), word).otherwise(F.concat(article(word), F.lit(" "), word))


def agreement(word: Column) -> dict[str, Column]:
    """What a template needs to speak of one thing, by placeholder; a placeholder with a capital gives the value with one."""
    many = word.isin(*PAIRED)
    by_number = {"pronoun": ("it", "they"), "owner": ("its", "their"), "be": ("is", "are"), "do": ("does", "do")}
    values = {"name": word, "subject": noun_phrase(word), "several": plural(word), "article": article(word)}
    values |= {k: F.when(many, b).otherwise(a) for k, (a, b) in by_number.items()}
    return values | {k.capitalize(): F.concat(F.upper(F.left(v, F.lit(1))), F.substr(v, F.lit(2))) for k, v in values.items()}


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its named placeholders replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
