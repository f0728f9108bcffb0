"""Lessons: rewordings of a question, masked examples, and the lesson log."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from turnloom.functions import text as T
from turnloom.functions.markers import BOT, END, START, USER
from turnloom.operators.dialogue import FACTS, PHRASES, THINGS

IGNORE = -100
#: A question: its word, its verb (or a contraction), its subject.
ASKING = r"^(what|who|where|when|why|how)('s|s| is| are| was| do| does| did)\s+(.+)$"
#: Ways to ask of a subject, in order; {w} is the question word, {v} the verb, {x} the subject.
STATES = ("{w} {v} {x}", "i would like to hear {w} {x} {v}", "{x}: {w} {v} that", "please say {w} {x} {v}")
ACTS = ("{w} {v} {x}", "i would like to hear {w} {x}", "please say {w} {x}", "{x}: {w}")
#: Ways to put any other request.
OTHERWISE = ("{x}", "please: {x}", "one more thing: {x}", "{x}, please", "let me ask: {x}")


def earlier_talk(things: list[str] | None = None) -> list[str]:
    """Exchanges that a lesson may stand behind: one for each thing of dialogue.FACTS."""
    return [f"{USER}What is meant by {p}?{END}\n{BOT}{s}{END}\n" for t, p in zip(THINGS, PHRASES) if things is None or t in things for s in (f"One that {FACTS[t]}." if not FACTS[t].startswith("is ") else f"It {FACTS[t]}.",)]


def _put(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def rewordings(question: Column, limit: int = 8) -> Column:
    """Up to ``limit`` ways of asking, the original first; then each way bare, with a question mark, and with a capital too.
    Equal ones fall case-sensitively, keeping the first; the verb agrees with its subject (text.agree)."""
    asked = T.strip(question)
    core = T.strip(F.regexp_replace(asked, r"\?+$", ""))
    part = lambda i: F.regexp_extract(core, "(?is)" + ASKING, i)
    verb = F.when(F.lower(part(2)).isin("'s", "s"), "is").otherwise(F.lower(F.ltrim(part(2))))
    values = {"w": F.lower(part(1)), "v": verb, "x": T.strip(part(3))}
    first_small = F.concat(F.lower(F.left(core, F.lit(1))), F.substr(core, F.lit(2)))
    ways = (
        F.when(core == "", F.array().cast("array<string>"))
        .when(part(1) == "", F.array(*[_put(t, {"x": core if t.startswith("{x}") else first_small}) for t in OTHERWISE]))
        .when(verb.isin("do", "does", "did"), F.array(*[_put(t, values) for t in ACTS])).otherwise(F.array(*[_put(t, values) for t in STATES]))
    )
    marked = F.transform(ways, lambda t: F.concat(t, F.lit("?")))
    agreed = F.transform(F.concat(F.array(asked), ways, marked, F.transform(marked, T.capitalized)), T.agree)
    return F.slice(F.array_distinct(F.filter(agreed, lambda t: t != "")), 1, limit)


def lesson_text(question: Column, answer: Column, opening: bool) -> Column:
    return F.concat(F.lit((START + "\n" if opening else "") + USER), question, F.lit(END + "\n" + BOT), answer, F.lit(END))


def encoded(text: Column, answer_at: Column) -> tuple[Column, Column]:
    """(x, y): ids and their successors; y is IGNORE before the answer. Ids here are code points; see corpus.Codec for a vocabulary's."""
    ids = F.transform(T.characters(text), lambda c: F.ascii(c))
    x = F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))
    return x, F.transform(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda v, i: F.when(i + 1 >= answer_at, v).otherwise(IGNORE))


def lesson_rows(pairs: DataFrame, key: str, block: int, context: Column) -> DataFrame:
    """key, form, text, answer_at for (question, answer) pairs in three forms: opening a conversation, bare, and behind
    earlier talk where that fits in block + 1 characters. Exchanges that don't fit alone are an error."""
    forms = []
    for form, opening, prefix in (("opening", True, F.lit("")), ("bare", False, F.lit("")), ("behind", False, context)):
        alone = lesson_text(F.col("question"), F.col("answer"), opening)
        fits = F.length(prefix) + F.length(alone) <= block + 1
        text = F.when(fits, F.concat(prefix, alone)).otherwise(alone)
        at = F.instr(alone, BOT) + F.when(fits, F.length(prefix)).otherwise(0)
        forms.append(F.struct(F.lit(form).alias("form"), text.alias("text"), at.alias("answer_at"), F.length(alone).alias("n")))
    rows = pairs.select(key, F.explode(F.array(*forms)).alias("r")).select(key, "r.*")
    checked = F.when(F.col("n") <= block + 1, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("the exchange is longer than the context: "), F.col("n").cast("string"))))
    return rows.select(key, "form", checked.alias("text"), "answer_at")


#: The fields of a log record that the engine reads; others may be present.
LOG = Y.StructType([
    Y.StructField("when", Y.StringType()), Y.StructField("question", Y.StringType()), Y.StructField("answer", Y.StringType()), Y.StructField("trained_wordings", Y.ArrayType(Y.StringType())),
    Y.StructField("learned", Y.BooleanType()), Y.StructField("generalized", Y.BooleanType()), Y.StructField("drift", Y.DoubleType()), Y.StructField("checks", Y.LongType()),
    Y.StructField("checks_baseline", Y.LongType()), Y.StructField("rolled_back", Y.BooleanType()), Y.StructField("kind", Y.StringType()),
])


def records(lines: DataFrame) -> DataFrame:
    """lines: (value). The parsed records; blank and malformed lines are dropped."""
    parsed = lines.where("trim(value) <> ''").select(F.from_json("value", LOG, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r.question is not null and r.answer is not null").select("r.*")


def past_pairs(log: DataFrame) -> DataFrame:
    """wording, answer of every lesson that wasn't undone; a record without wordings counts with its question."""
    kept = log.where(~F.coalesce("rolled_back", F.lit(False)))
    said = F.when(F.size(F.coalesce("trained_wordings", F.array().cast("array<string>"))) > 0, F.col("trained_wordings")).otherwise(F.array("question"))
    return kept.select(F.explode(said).alias("wording"), "answer")


def session_summary(log: DataFrame) -> DataFrame:
    undone = F.coalesce("rolled_back", F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return log.agg(F.count("*").alias("lessons"), count(~undone).alias("kept"), count(undone).alias("undone"), count(~undone & F.coalesce("learned", F.lit(False))).alias("learned"), count(~undone & F.coalesce("generalized", F.lit(False))).alias("generalized"))


def padded(rows: DataFrame, key: str) -> DataFrame:
    """key, x, y of (key, text, answer_at) rows of a lesson batch, right-padded to its longest: x with 0, y with IGNORE."""
    x, y = encoded(F.col("text"), F.col("answer_at"))
    ids = rows.select(key, "form", x.alias("x"), y.alias("y"))
    width = F.max(F.size("x")).over(Window.partitionBy(key))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("w") - F.size(c)))
    return ids.withColumn("w", width).select(key, "form", fill("x", 0).alias("x"), fill("y", IGNORE).alias("y"))


def guard(drift: Column, checks: Column, baseline: Column, max_drift: float = 0.15, allowed: int = 1) -> Column:
    """Whether a lesson stays: "drifted", "forgot" or "kept"."""
    return F.when(drift > max_drift, "drifted").when(baseline - checks > allowed, "forgot").otherwise("kept")


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``ratio``: 2 M / T of the longest-matching-block alignment (difflib), in Arrow batches."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, u or "", v or "").ratio() for u, v in zip(x, y)])

    return pairs.withColumn("ratio", ratio(a, b))


def polish_pairs(pairs: DataFrame, seed: int, most: int = 40) -> DataFrame:
    """Distinct (wording, answer) pairs, at most ``most`` by seeded draw."""
    from turnloom.functions.draws import draw

    once = pairs.select("wording", "answer").distinct()
    return once.orderBy(draw(seed, F.concat_ws("\0", "wording", "answer"), 0), "wording", "answer").limit(most)
