"""Line dedup by site-relative frequency (DataFrame functions only).

A line is boilerplate on its site when it stands on more than ``max_ratio`` of the site's pages and on
at least ``min_pages`` of them. Per site and line the pages are counted (each page once), divided by the
site's page total, and the lines above the ratio are dropped from every page of the site.

Scale: a page sends one 64-bit hash per distinct line, which map-side aggregation folds before the
shuffle, so a line that stands on every page costs one row per task. A site keeps at most (mean lines a
page) / max_ratio boilerplate lines, whatever its size; the text itself is never shuffled while the rules
are below the broadcast threshold, and beyond it the join is one that adaptive execution splits by skew.

Defined cases: null text stays null and counts as a page without lines; null sites form one site; blank
lines are never counted or dropped; lines are compared without surrounding spaces; a page that repeats a
line counts once; repeated rows count as pages of their own; an empty table gives an empty table; a page
whose lines all go keeps an empty text; pages and lines are read whole, however long; a line at exactly the ratio stays. Other columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.words import group_key
from turnloom.session import staged

MAX_RATIO, MIN_PAGES = 0.1, 3
_SITE, _BAD = "__site_of_line", "__boilerplate_of_site"


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, site: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row a site that has boilerplate: its key and the hashes of its lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    seen = (
        pages.select(group_key(site).alias(_SITE), F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
        .groupBy(_SITE, "line").agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )
    total = pages.groupBy(group_key(site).alias(_SITE)).agg(F.count("*").alias("n_total"))
    return (
        seen.join(total, _SITE)
        .where(F.col("n_pages") > F.lit(float(max_ratio)) * F.col("n_total"))
        .groupBy(_SITE).agg(F.collect_list("line").alias(_BAD))
    )


def drop_site_boilerplate(pages: DataFrame, site: Column, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with its boilerplate lines taken out of column ``text``.

    counts: names of two long columns to add: lines with a character before, and lines dropped.
    """
    rules = staged(boilerplate_lines(pages, site, F.col(text), max_ratio, min_pages), "site-lines")
    joined = pages.withColumn(_SITE, group_key(site)).join(rules, _SITE, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(_BAD), _key(x)))
    clean = F.when(F.col(_BAD).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = joined
    if counts:
        n = F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0))
        n = F.when(F.col(text).isNull(), 0).otherwise(n).cast("long")
        gone = F.when(F.col(text).isNull() | F.col(_BAD).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
        out = out.withColumns({counts[0]: n, counts[1]: gone})
    return out.withColumn(text, clean).drop(_SITE, _BAD)


#: Regular expressions of page_lines(), in the order of use; RE2 and Java read them alike.
SKIPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|section|header|footer|title|head|body|html|table|tr|td|th|aside|main|pre|blockquote)\b[^>]*>"
TAG = r"<[^>]*>"


def page_lines(html: Column) -> Column:
    """The visible text of a page, a line for each block element."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SKIPPED, ""), BLOCK, "\n"), TAG, "")
    return F.regexp_replace(text, "\n{2,}", "\n")
