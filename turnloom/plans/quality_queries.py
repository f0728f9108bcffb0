"""Queries that judge replies against a corpus. Replies are the first lines of the benchmark's texts; the corpus is the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.dialect import DUCKDB as D
from turnloom.functions.dialect import SPARK as S
from turnloom.functions.markers import END, THINK
from turnloom.operators import corpus, quality
from turnloom.plans import generator_queries
from turnloom.plans.corpus_queries import LINES, REPLIES, replies
from turnloom.plans.registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle


def _lines(spark, d):
    return corpus.lines(table(spark, d, "documents")).select("line")


#: Longest copied prefixes by trying every length: the plain statement of the gram join.
_PREFIX = f"""{LINES}, {REPLIES}, u AS (SELECT DISTINCT line FROM l WHERE line <> ''),
k AS (SELECT item_id, reply, unnest(range(1, length(reply) + 1)) AS k FROM r), p AS (SELECT item_id, max(k) AS prefix FROM k WHERE EXISTS (SELECT 1 FROM u WHERE contains(line, left(reply, k::BIGINT))) GROUP BY item_id),
x AS (SELECT item_id, reply, length(reply)::INTEGER AS length, coalesce(prefix, 0)::INTEGER AS prefix FROM r LEFT JOIN p USING (item_id))"""
_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"
_SPELLED = f"s AS (SELECT item_id, count(*)::BIGINT AS n_words, count(w.w)::BIGINT AS n_known FROM (SELECT item_id, unnest(regexp_extract_all(lower(reply), '[a-z]+')) AS said FROM r) q LEFT JOIN w ON w.w = said GROUP BY item_id)"
_GRAMS = "list_transform(range(1, length(reply) - 1), lambda i: reply[i:i + 2])"


@_r.query(f"WITH {_PREFIX} SELECT item_id, length, prefix FROM x")
def longest_prefix(spark, d):
    return quality.longest_prefixes(replies(spark, d), _lines(spark, d), "item_id")


@_r.query(f"WITH {_PREFIX} SELECT item_id, length >= 20 AND prefix = length AS copied, length > 0 AND NOT (length >= 20 AND prefix = length) AS new_sentence FROM x")
def exact_copy(spark, d):
    p = quality.longest_prefixes(replies(spark, d), _lines(spark, d), "item_id")
    copied = (F.col("length") >= quality.COPY_LENGTH) & (F.col("prefix") == F.col("length"))
    return p.select("item_id", copied.alias("copied"), ((F.col("length") > 0) & ~copied).alias("new_sentence"))


@_r.query(f"WITH {_PREFIX} SELECT round(1 - sum(prefix)::DOUBLE / greatest(1, sum(length)), 6) AS novelty, round(avg(CASE WHEN length > 0 THEN prefix END), 6) AS mean_copied_prefix FROM x")
def novelty(spark, d):
    p = quality.longest_prefixes(replies(spark, d), _lines(spark, d), "item_id")
    return p.agg(F.round(1 - F.sum("prefix") / F.greatest(F.lit(1), F.sum("length")), 6).alias("novelty"), F.round(F.avg(F.when(F.col("length") > 0, F.col("prefix"))), 6).alias("mean_copied_prefix"))


@_r.query(f"WITH {REPLIES}, {_WORDS}, {_SPELLED} SELECT item_id, n_words, n_known FROM s")
def spelling_rate(spark, d):
    return quality.spelled(replies(spark, d), quality.word_vocabulary(table(spark, d, "documents")), "item_id")


@_r.query("WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS said FROM conversations WHERE role <> 'system') SELECT count(*)::BIGINT AS n_words, count(w.w)::BIGINT AS n_known FROM c LEFT JOIN w ON w.w = said")
def conversation_spelling(spark, d):
    """All words of the conversations against the documents' words."""
    said = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", F.col("text").alias("reply"))
    s = quality.spelled(said, quality.word_vocabulary(table(spark, d, "documents")), "conv_id")
    return s.agg(F.sum("n_words").alias("n_words"), F.sum("n_known").alias("n_known"))


@_r.query(f"WITH {REPLIES} SELECT item_id, CASE WHEN length(reply) >= 3 THEN round(len(list_distinct({_GRAMS}))::DOUBLE / len({_GRAMS}), 6) END AS variety FROM r")
def trigram_variety(spark, d):
    return replies(spark, d).select("item_id", F.round(quality.variety(F.col("reply")), 6).alias("variety"))


#: Raw outputs of a model: the reply, a thought before it in every third item, an end marker but in every fifth.
_RAW = lambda: (F.concat(F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("about item "), F.col("item_id").cast("string"), F.lit(THINK))).otherwise(""), F.col("reply"), F.when(F.col("item_id") % 5 == 0, "").otherwise(END)))


@_r.query(f"""WITH {_PREFIX}, {_WORDS}, {_SPELLED}, y AS (SELECT x.*, n_words, n_known, CASE WHEN x.length >= 3 THEN len(list_distinct({_GRAMS}))::DOUBLE / len({_GRAMS}) END AS variety, x.length >= 20 AND prefix = x.length AS copied, CASE WHEN item_id % 3 = 0 THEN 'about item ' || item_id ELSE '' END AS thought FROM x LEFT JOIN s USING (item_id))
SELECT count(*)::BIGINT AS n, round(avg(CASE WHEN item_id % 5 = 0 THEN 0.0::DOUBLE ELSE 1 END), 6) AS format_ok, round(avg(length), 6) AS mean_len, round(avg(CASE WHEN length = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS empty, round(sum(n_known)::DOUBLE / sum(n_words), 6) AS spelling, round(avg(variety), 6) AS variety,
  round(count(*) FILTER (copied)::DOUBLE / count(*), 6) AS exact_copy, round(count(*) FILTER (length > 0 AND NOT copied)::DOUBLE / greatest(1, count(*) FILTER (length > 0)), 6) AS new_sentences,
  round(1 - sum(prefix)::DOUBLE / greatest(1, sum(length)), 6) AS novelty, round(avg(CASE WHEN length > 0 THEN prefix END), 6) AS mean_copied_prefix,
  round(avg(length(thought)), 6) AS mean_thought, round(avg(CASE WHEN thought <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS thinks FROM y""")
def quality_summary(spark, d):
    """All quality figures of the fixture's replies as raw outputs."""
    raw = replies(spark, d).select("item_id", _RAW().alias("raw"))
    return quality.summary(quality.parted(raw).drop("raw"), _lines(spark, d), quality.word_vocabulary(table(spark, d, "documents")), "item_id")


def _sums(x) -> tuple[str, str]:
    """The operands of sum i of a size and an operation (0 to 2)."""
    key = "size * 1000 + op * 100 + i"
    low, high = "cast(power(10, size - 1) as bigint)", "cast(power(10, size) - 1 as bigint)"
    a, b = x.between(41, key, 1, low, high), x.between(41, key, 2, low, high)
    l = f"(CASE WHEN op = 1 THEN greatest({a}, {b}) ELSE {a} END)"  # noqa: E741
    r = f"(CASE op WHEN 1 THEN least({a}, {b}) WHEN 2 THEN {x.between(41, key, 3, 2, 12)} ELSE {b} END)"
    return f"cast({l} as bigint) AS l", f"cast({r} as bigint) AS r"


_TRUTH = "(CASE op WHEN 0 THEN l + r WHEN 1 THEN l - r ELSE l * r END)"
#: A sum for every item of the benchmark.
_ITEMS = lambda x: ["item_id", "cast(item_id % 3 + 1 as int) AS size", f"cast({x.div('item_id', 3)} % 3 as int) AS op", "item_id AS i"]


@_r.query(f"WITH g AS (SELECT {', '.join(_ITEMS(D))} FROM benchmark), x AS (SELECT item_id, size, op, {', '.join(_sums(D))} FROM g) SELECT item_id, size, op, l, r, {_TRUTH}::BIGINT AS truth FROM x")
def benchmark_sums(spark, d):
    """A sum of one to three digits with its result for every item of the benchmark."""
    items = table(spark, d, "benchmark").selectExpr(*_ITEMS(S))
    return items.selectExpr("item_id", "size", "op", *_sums(S)).withColumn("truth", F.expr(_TRUTH))


#: A reply ends where a model's budget of characters ends.
BUDGET = 90
_RESULT = lambda x: f"(CASE op WHEN 0 THEN l + r WHEN 1 THEN l - r WHEN 2 THEN l * r ELSE {x.div('l', 'r')} END)"


@_r.query(f"""WITH w AS ({generator_queries.ORACLE_SQL['arith_operands']}), x AS ({generator_queries.ORACLE_SQL['arith_exchange']}), y AS (SELECT op, l, r, left(answer, {BUDGET}) AS reply FROM w JOIN x USING (doc_id)),
m AS (SELECT op, length(cast(l AS VARCHAR)) AS size, coalesce(try_cast(list_last(regexp_extract_all(reply, '-?[0-9]+')) AS BIGINT) = {_RESULT(D)}, false) AS hit FROM y)
SELECT size::INTEGER AS size, op::INTEGER AS op, round(avg(hit::INTEGER), 6) AS score FROM m GROUP BY GROUPING SETS ((size, op), ())""")
def arith_scoreboard(spark, d):
    """Accuracy by size and operation and overall (both null) of the worked answers to every document's sum, as far as the budget of characters goes: scored on the last number."""
    answers = generator_queries.arith_exchange(spark, d).select("doc_id", F.left("answer", F.lit(BUDGET)).alias("reply"))
    told = generator_queries.arith_operands(spark, d).select("doc_id", "op", "l", "r").join(answers, "doc_id")
    hit = F.coalesce(T.final_number(F.col("reply")) == F.expr(_RESULT(S)), F.lit(False)).cast("int")
    return told.select(F.length(F.col("l").cast("string")).alias("size"), F.col("op").cast("int").alias("op"), hit.alias("hit")).groupingSets([["size", "op"], []], "size", "op").agg(F.round(F.avg("hit"), 6).alias("score"))


@_r.query("SELECT doc_id, CASE WHEN n > 0 THEN rpad(repeat('#', round_even(n_sym * 20.0 / n, 0)::INTEGER), 20, '.') ELSE '?' || repeat(' ', 19) END AS bar FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\sA-Za-z]')) AS n_sym, length(text) AS n FROM documents)")
def ratio_bars(spark, d):
    """The share of characters that are neither ASCII letters nor white space, as a bar."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\sA-Za-z]")).alias("n_sym"), F.length("text").alias("n"))
    return docs.select("doc_id", T.ratio_bar(F.when(F.col("n") > 0, F.col("n_sym") / F.col("n"))).alias("bar"))


@_r.query("SELECT a.item_id, max(abs(a.v - b.v)) AS gap FROM (SELECT vec_id AS item_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) a JOIN (SELECT vec_id - 1 AS item_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) b USING (item_id, i) GROUP BY a.item_id")
def worst_gap(spark, d):
    """The largest difference of any component between a vector and the next."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("item_id") - 1).alias("item_id"), F.col("v").alias("w"))
    return e.join(n, "item_id").select("item_id", F.array_max(F.zip_with("v", "w", lambda x, y: F.abs(x - y))).alias("gap"))
