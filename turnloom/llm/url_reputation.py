"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes are labelled pages (bad or not). A host's bad rate is shrunk to that of its registered domain,
the domain's to that of its suffix, the suffix's to the overall rate. At each level the strength of the
prior is estimated from the data: with rho the intraclass correlation of the beta-binomial by the method
of moments around the parent's mean, k = (1 - rho) / rho pseudo-pages. A host is blocked when the lower
posterior bound, mean - z * sd of its Beta, exceeds ``max_bad``. The doubt is the host's own: the
prior's rate is taken as it is, so where all labels of a domain, or of the whole table, are bad, its hosts without labels are blocked.

Every host of the pages is judged: one without labels has the prior itself for its Beta, which is that of its domain, else
of its suffix, else of all labels, with the prior's k pseudo-pages, so that its bound is wide.

Scale: pages are folded to one row a host with map-side aggregation, so a hot host costs one
row a task; the prior strengths are scalars; the host table is joined back, broadcast only below the planner's threshold.

Defined cases: null urls and urls without :// have an empty host and path, fit no rule and are judged as the host "";
repeated labels of a page count each; a page is never repeated in the result; labels that are null, or of no page, don't count;
of rules of equal length the one least by code point wins; without any labels all have a null posterior and are allowed; an empty
table gives an empty table; urls are read whole, however long; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import staged

#: The rules of the query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Public suffixes of two labels; any other host's suffix is its last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
MAX_BAD, Z, LEAST_RHO, MOST_RHO = 0.5, 1.645, 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are configuration, tried longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at in sorted(sorted(rules, key=lambda r: r[1], reverse=True), key=lambda r: len(r[1])):
        name, _, rest = at.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, at).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    parts = F.split(host, r"\.")
    labels = F.when(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").isin(*two_label), 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def suffix(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _strength(units: DataFrame, parent: str) -> float:
    """k of the beta prior around the parent's mean; units: n, bad, and the parent's mean. One row reaches the driver."""
    p = F.col(parent)
    row = units.agg(
        F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) * (F.col("bad") / F.col("n") - p)).alias("s"),
        F.sum(p * (1 - p)).alias("v"), F.sum(p * (1 - p) * (F.col("n") - 1)).alias("w"),
    ).first()
    rho = round((row["s"] - row["v"]) / row["w"], 9) if row["w"] else MOST_RHO
    rho = min(max(rho, LEAST_RHO), MOST_RHO)
    return (1 - rho) / rho


def host_posteriors(pages: DataFrame, z: float = Z, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages: (host, bad 0/1 or null), a row an outcome. One row a host: n_labelled, posterior, bound; no rows without any outcome."""
    domain = registered_domain(F.col("host"), two_label)
    folded = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    every = staged(folded.withColumn("domain", domain).withColumn("suffix", suffix(F.col("domain"))), "hosts")
    hosts = every.where("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = whole[1] / whole[0] if whole[0] else 0.0
    shrunk = lambda k, prior: (F.col("bad") + k * prior) / (F.col("n") + k)
    k_s = _strength(suffixes.withColumn("p", F.lit(overall)), "p")
    suffixes = suffixes.select("suffix", shrunk(k_s, F.lit(overall)).alias("p_suffix"))
    domains = staged(domains.join(suffixes, "suffix"), "domains")
    k_d = _strength(domains, "p_suffix")
    domains = domains.select("domain", shrunk(k_d, F.col("p_suffix")).alias("p_domain"))
    k_h = _strength(hosts.join(domains, "domain"), "p_domain")
    prior = F.coalesce("p_domain", "p_suffix", F.lit(overall))
    judged = every.where(F.lit(bool(whole[0]))).join(domains, "domain", "left").join(suffixes, "suffix", "left").select("host", "n", "bad", prior.alias("prior"))
    a, b = F.col("bad") + k_h * F.col("prior"), F.col("n") - F.col("bad") + k_h * (1 - F.col("prior"))
    mean = a / (a + b)
    return judged.select("host", F.col("n").alias("n_labelled"), mean.alias("posterior"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, z: float = Z, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """pages: (page_id, url); outcomes: (page_id, bad). Returns page_id, host, path, rule, verdict, n_labelled, posterior, bound."""
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    told = judged.select("page_id", "host").join(outcomes.where("bad is not null").select("page_id", "bad"), "page_id", "left").select("host", "bad")
    hosts = staged(host_posteriors(told, z, two_label), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).cast("long").alias("n_labelled"), F.round("posterior", 6).alias("posterior"), F.round("bound", 6).alias("bound"),
    )
