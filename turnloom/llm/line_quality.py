r"""Quality rules, line first (DataFrame functions only; no row leaves its partition).

Each \n-split line with a word is judged on its own and removed if it fails a rule:

* punctuation: three words or more without any sentence mark (. ! ? and their kin), or symbol
  characters ``[#*$%&|<>]`` of more than 5% of the line, or a doubled ! or ? for every fifth word;
* navigation: three separators or more (| > » › • ·), one for every fourth word or more;
* boilerplate: a phrase of scripts, cookie and policy notices, or braces of code.

A document that keeps less than ``1 - max_lost`` of its words is rejected. Before that stand the base
rules: under 50 words, or more than half of the words in repeated three-word windows.

Repeated windows are found inside the row: the 64-bit hashes of all windows are sorted with their
positions and neighbours compared, n log n in the words, and only for texts in which a hash repeats.

Defined cases: null and blank texts have no words and fail the base rules; repeated rows are judged
alike; empty tables give empty tables; the text is judged whole, however long; a document that
loses exactly the share allowed is kept; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.words import GAP, only_if, word_array

SYMBOLS = r"#*$%&|<>"
MARK = "[.!?…。！？:;]"
SEPARATORS = "[|>»›•·]"
PHRASES = r"(?i)javascript|lorem ipsum|\bcookies?\b|privacy policy|terms of (?:use|service)|all rights reserved|click here|sign up|log ?in|subscribe|read more|[{}]"
MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 0.5, 0.5
_KEEP = {"word": f"[^{GAP}]+", "symbol": f"[^{SYMBOLS}]+"}


def _squeezed(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(_KEEP["word"]))


def line_fails(line: Column) -> Column:
    """Whether a line with at least one word fails a rule."""
    n = line_word_count(line)
    symbols = _squeezed(line, _KEEP["symbol"])
    shouts = F.regexp_count(line, F.lit("[!?]{2,}"))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = ((n >= 3) & ~F.regexp_like(line, F.lit(MARK))) | (symbols * 20 > F.length(line)) | ((shouts > 0) & (shouts * 5 >= n))
    navigation = (bars >= 3) & (bars * 4 >= n)
    return punctuation | navigation | F.regexp_like(line, F.lit(PHRASES))


def repeated_window_words(words: Column, k: int = 3) -> Column:
    """Expression over an attribute ``words``: how many words lie in k-word windows found twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))
    return F.when(n >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, ordered: Column, k: int = 3) -> Column:
    """Distinct positions covered by the windows whose hash has an equal neighbour in ``ordered``."""
    m = F.size(ordered)
    twin = lambda x, i: (
        ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(ordered, i + 1)["h"] == x["h"]))
    )
    at = F.transform(F.filter(ordered, twin), lambda x: x["p"])
    spread = F.flatten(F.transform(at, lambda p: F.array(*[p + j for j in range(k)])))
    return F.size(F.array_distinct(spread))


def quality_columns(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, into: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``into``: the counts, base_failed, kept, and lines and words removed."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__words", word_array(F.col(text))).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{GAP}]"))))
    step = step.withColumn("__hashes", repeated_window_words(F.col("__words")))
    repeats = F.size(F.array_distinct(F.col("__hashes"))) < F.size("__hashes")
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    pairs = F.transform(F.col("__hashes"), lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p")))
    step = step.withColumn("__ordered", F.when(repeats, F.sort_array(pairs)).otherwise(empty))
    step = step.withColumn("__bad", F.filter(F.col("__lines"), line_fails))
    n = F.size("__words").cast("long")
    lost = F.aggregate(F.col("__bad"), F.lit(0).cast("long"), lambda s, x: s + line_word_count(x).cast("long"))
    counts = step.withColumn("__counts", F.struct(
        n.alias("n_words"),
        (_squeezed(t, f"[{GAP}]+")).cast("long").alias("word_chars"),
        _squeezed(t, _KEEP["symbol"]).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct(F.col("__lines")))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__ordered") == 0, 0).otherwise(_covered(F.col("__hashes"), F.col("__ordered"))).cast("long").alias("n_repeat_words"),
        F.size("__bad").cast("long").alias("n_bad_lines"),
        lost.alias("n_lost_words"),
    ))
    c = lambda name: F.col(f"__counts.{name}")
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > int(100 * MAX_REPEATED) * c("n_words"))
    kept = ~failed & (c("n_lost_words") <= F.lit(float(max_lost)) * c("n_words"))
    return counts.withColumn(into, F.struct("__counts.*", failed.alias("base_failed"), kept.alias("kept"))).drop("__words", "__lines", "__hashes", "__ordered", "__bad", "__counts")


def clean_documents(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The documents that are kept, without their failing lines; the columns of ``docs``."""
    good = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.regexp_like(x, F.lit(f"[^{GAP}]")) | ~line_fails(x))
    return only_if(quality_columns(docs, text, max_lost, "__quality"), F.col("__quality.kept")).withColumn(text, F.array_join(good, "\n")).select(*docs.columns)
