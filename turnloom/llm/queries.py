"""The subpackage's queries and their DuckDB twins: QUERIES and ORACLE_SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import ann_lists, bpe_automaton, embedding_whitening, license_scan, line_dedup, line_quality, mixing, ngram_join, sentencepiece_codec, toxicity, url_reputation, vector_codes, warc_merkle
from turnloom.session import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the lines that are boilerplate on its host taken out."""
    pages = _table(spark, sf_dir, "pages").select("page_id", url_reputation.url_host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    return line_dedup.drop_site_boilerplate(pages, F.col("host"), "text", counts=("n_lines", "n_dropped")).select("page_id", "host", "n_lines", "n_dropped", "text")


@_query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. A page's outcome is the label of the document of the same number: bad if its quality is 0 or it is toxic."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_reputation.judge_pages(_table(spark, sf_dir, "pages"), outcomes)


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of ``pages`` as WARC records, page_id being the offset, in which faults are planted:
    pages of number 13 modulo 97 lost their first character, those of 7 modulo 101 are missing."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = pages.where(F.coalesce(F.pmod("page_id", F.lit(101)) != 7, F.lit(True)))
    replica = replica.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 13, F.expr("substring(html, 2)")).otherwise(F.col("html")))
    found = warc_merkle.audit(pages, replica, "page_id", warc_merkle.warc_record(F.col("url"), F.col("html")))
    return found.select(F.col("node").alias("page_id"), "status", "digest_a", "digest_b")


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return line_quality.quality_columns(docs).select("doc_id", "quality.*")


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.9."""
    return ngram_join.near_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


@_query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(_table(spark, sf_dir, "documents"), sentencepiece_codec.public_model())


@_query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    return ann_lists.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whitening_report(_table(spark, sf_dir, "embeddings"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_report(_table(spark, sf_dir, "embeddings"))


@_query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(_table(spark, sf_dir, "documents"), bpe_automaton.public_vocabulary())


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

ORACLE_SQL["op1_line_dedup"] = f"""
WITH p AS (
  SELECT page_id, {_HOST} AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, {_lit(line_dedup.SKIPPED)}, '', 'g'), {_lit(line_dedup.BLOCK)}, chr(10), 'g'), {_lit(line_dedup.TAG)}, '', 'g'), '\\n{{2,}}', chr(10), 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM p),
n AS (SELECT host, count(*) AS total FROM p GROUP BY host),
f AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT page_id) AS n_pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
b AS (SELECT f.host, f.line FROM f JOIN n USING (host) WHERE n_pages >= {line_dedup.MIN_PAGES} AND n_pages > {line_dedup.MAX_RATIO}::DOUBLE * total),
k AS (SELECT l.*, b.line IS NOT NULL AS bad FROM l LEFT JOIN b ON b.host = l.host AND b.line = trim(l.line, ' '))
SELECT page_id, host,
  count(*) FILTER (trim(line, ' ') <> '')::BIGINT AS n_lines, count(*) FILTER (bad)::BIGINT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text
FROM k GROUP BY page_id, host"""


def _op2_sql() -> str:
    rule = verdict = ""
    for what, at in sorted(url_reputation.RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = at.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        rule, verdict = rule + f" WHEN {fits} THEN '{at}'", verdict + f" WHEN {fits} THEN '{what}'"
    two = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)
    k = lambda name, units, parent: f"""{name} AS (SELECT (1 - rho) / rho AS k FROM (SELECT least(greatest(coalesce(CASE WHEN sum({parent} * (1 - {parent}) * (n - 1)) <> 0 THEN round((sum(n * (bad / n - {parent}) * (bad / n - {parent})) - sum({parent} * (1 - {parent}))) / sum({parent} * (1 - {parent}) * (n - 1)), 9) END, {url_reputation.MOST_RHO}), {url_reputation.LEAST_RHO}), {url_reputation.MOST_RHO})::DOUBLE AS rho FROM {units}))"""
    return f"""
WITH j AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
e AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*[.]', '') ELSE domain END AS suffix FROM (
  SELECT *, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - (CASE WHEN array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') IN ({two}) THEN 2 ELSE 1 END), 1), len(string_split(host, '.'))), '.') AS domain
  FROM (SELECT host, count(doc_id)::DOUBLE AS n, coalesce(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN doc_id IS NOT NULL THEN 0 END), 0)::DOUBLE AS bad FROM j LEFT JOIN labels ON doc_id = page_id GROUP BY host))),
h AS (SELECT * FROM e WHERE n > 0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
w AS (SELECT sum(bad) / sum(n) AS p FROM h),
s1 AS (SELECT s.*, p FROM s, w), {k("ks", "s1", "p")},
s2 AS (SELECT suffix, (bad + k * p) / (n + k) AS p_suffix FROM s1, ks),
d1 AS (SELECT d.*, p_suffix FROM d JOIN s2 USING (suffix)), {k("kd", "d1", "p_suffix")},
d2 AS (SELECT domain, (bad + k * p_suffix) / (n + k) AS p_domain FROM d1, kd),
h1 AS (SELECT h.*, p_domain FROM h JOIN d2 USING (domain)), {k("kh", "h1", "p_domain")},
h2 AS (SELECT e.host, n, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM (SELECT e.*, coalesce(p_domain, p_suffix, p) AS prior FROM e LEFT JOIN d2 ON d2.domain = e.domain LEFT JOIN s2 ON s2.suffix = e.suffix, w WHERE p IS NOT NULL) e, kh),
r AS (SELECT host, n::BIGINT AS n_labelled, a / (a + b) AS posterior, a / (a + b) - {url_reputation.Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h2)
SELECT page_id, host, path, CASE{rule} END AS rule,
  coalesce(CASE{verdict} END, CASE WHEN bound > {url_reputation.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_labelled, 0)::BIGINT AS n_labelled, round(posterior, 6) AS posterior, round(bound, 6) AS bound
FROM j LEFT JOIN r USING (host)"""


ORACLE_SQL["op2_url_filters"] = _op2_sql()

_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE_SQL["op3_warc"] = f"""
WITH b AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN substring(html, 2) ELSE html END AS html FROM pages WHERE page_id % 101 <> 7),
x AS (SELECT page_id, sha256({_RECORD}) AS digest_a FROM pages),
y AS (SELECT page_id, sha256({_RECORD}) AS digest_b FROM b)
SELECT page_id, CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'changed' END AS status, digest_a, digest_b
FROM x LEFT JOIN y USING (page_id) WHERE digest_a IS DISTINCT FROM digest_b"""

_LINE_N = f"len(regexp_extract_all(x, '{_WORD}'))"
_FAILS = (
    f"(({_LINE_N} >= 3 AND NOT regexp_matches(x, {_lit(line_quality.MARK)})) OR length(regexp_replace(x, '[^{line_quality.SYMBOLS}]+', '', 'g')) * 20 > length(x)"
    f" OR (len(regexp_extract_all(x, '[!?]{{2,}}')) > 0 AND len(regexp_extract_all(x, '[!?]{{2,}}')) * 5 >= {_LINE_N})"
    f" OR (len(regexp_extract_all(x, {_lit(line_quality.SEPARATORS)})) >= 3 AND len(regexp_extract_all(x, {_lit(line_quality.SEPARATORS)})) * 4 >= {_LINE_N})"
    f" OR regexp_matches(x, {_lit(line_quality.PHRASES)}))"
)
ORACLE_SQL["op4_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n >= 2 GROUP BY doc_id),
q AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_GAP}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{line_quality.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, list_filter(ls, lambda x: {_FAILS}) AS bad
  FROM d LEFT JOIN c USING (doc_id)),
z AS (SELECT *, len(bad)::BIGINT AS n_bad_lines, coalesce(list_sum(list_transform(bad, lambda x: {_LINE_N})), 0)::BIGINT AS n_lost_words,
    n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, n_lost_words, base_failed,
  NOT base_failed AND n_lost_words <= {line_quality.MAX_LOST}::DOUBLE * n_words AS kept FROM z"""

#: One plain statement of the mix; also a part of the pipeline's.
MIX_CTES = f"""
mz AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[1:4])::BIGINT AS bucket FROM mix_input),
ms AS (SELECT source, sum(size)::BIGINT AS source_size FROM mz GROUP BY source),
mw AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}) + 1] AS weight, source_size * {mixing.MAX_EPOCHS} AS cap FROM ms),
ml AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS left_weight
  FROM mw WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mc AS (SELECT *, cap / weight <= left_words / left_weight AS capped FROM ml),
ma AS (SELECT left_words::DOUBLE AS mw_words, left_weight::DOUBLE AS mw_weight FROM mc WHERE NOT capped ORDER BY cap / weight, source NULLS LAST LIMIT 1),
mt AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE * mw_words / mw_weight END AS target FROM mc LEFT JOIN ma ON true),
mr AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM mt),
mb AS (SELECT source, bucket, sum(size)::BIGINT AS words FROM mz GROUP BY ALL),
mi AS (SELECT mb.source, bucket FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mb) mb
  JOIN mr ON mr.source IS NOT DISTINCT FROM mb.source WHERE 2 * before + words <= 2 * (target - whole * source_size)),
mx AS (SELECT mz.doc_id, mz.source, size, source_size, target, mz.bucket, whole + CASE WHEN mi.bucket IS NOT NULL THEN 1 ELSE 0 END AS times
  FROM mz JOIN mr ON mr.source IS NOT DISTINCT FROM mz.source LEFT JOIN mi ON mi.source IS NOT DISTINCT FROM mz.source AND mi.bucket = mz.bucket)"""
ORACLE_SQL["op5_mixing"] = f"""
WITH mix_input AS (SELECT doc_id, source, text FROM documents), {MIX_CTES}
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken FROM mx"""


def _op9_sql() -> str:
    k = license_scan.SHINGLE
    templates = ", ".join(f"({_lit(name)}, {_lit(body)})" for name, body in license_scan.TEMPLATES)
    cut = lambda key, rel: f"""SELECT DISTINCT {key}, CASE WHEN len(ws) < {k} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {k - 1}], ' ') END AS g FROM (SELECT {key}, ws, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) AS i FROM {rel} WHERE len(ws) > 0)"""
    return f"""
WITH t(template, body) AS (VALUES {templates}),
tw AS (SELECT template, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS ws FROM t),
tg AS ({cut("template", "tw")}),
n AS (SELECT template, count(*)::BIGINT AS n_template FROM tg GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
dg AS ({cut("doc_id", "dw")}),
c AS (SELECT doc_id, template, count(*)::BIGINT AS n_shared FROM dg JOIN tg USING (g) GROUP BY ALL)
SELECT doc_id, template, n_shared, n_template, round(n_shared / n_template, 6) AS containment FROM c JOIN n USING (template) WHERE n_shared >= {license_scan.CONTAINED}::DOUBLE * n_template"""


ORACLE_SQL["op9_license_scans"] = _op9_sql()


def _op12_sql() -> str:
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    square = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT"
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({square} * {entries} + entry) AS best FROM p JOIN b{k} b USING (part) GROUP BY r, part)")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, list((total - (total % n + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (
    SELECT part, entry, i, sum(x[i])::BIGINT AS total, count(*) AS n FROM (SELECT p.part, best % {entries} AS entry, x, unnest(range(1, len(x) + 1)) AS i FROM p JOIN a{k} USING (r, part)) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    return f"""
WITH {", ".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN v USING (r)"""


ORACLE_SQL["op12_vector_codes"] = _op12_sql()
