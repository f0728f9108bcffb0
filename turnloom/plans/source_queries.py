"""Queries through the file sources and sinks: what is written in the shared folder and read back, or told of it; and word forms for templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import inflect
from turnloom.functions import text as T
from turnloom.functions.dialect import DUCKDB as D
from turnloom.functions.dialect import quoted
from turnloom.functions.markers import BOT, USER
from turnloom.operators import corpus, lessons
from turnloom.operators.quality import word_vocabulary
from turnloom.plans import generator_queries, lesson_queries
from turnloom.plans.corpus_queries import _CHARS, CONVERSATIONS, _digest_sql
from turnloom.plans.registry import Registry, table
from turnloom.session import scratch_folder, spread
from turnloom.sources import texts
from turnloom.streaming import lesson_log

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle


def _rendered(spark, d):
    return corpus.rendered(corpus.turns(table(spark, d, "conversations")))


@_r.query(f"WITH {CONVERSATIONS} SELECT sha256(text) AS sha256, len(string_split(text, chr(10)))::INTEGER AS n_lines FROM c")
def block_files(spark, d):
    """All conversations as files of blocks, parted by blank lines, read back."""
    folder = scratch_folder(spark, "blocks")
    _rendered(spark, d).select("text").write.option("lineSep", "\n\n").text(folder)
    return texts.blocks(spark, folder).select(F.sha2(F.array_join("lines", "\n"), 256).alias("sha256"), F.size("lines").alias("n_lines"))


@_r.query("SELECT role, text, count(*)::BIGINT AS n FROM conversations GROUP BY ALL")
def history_log(spark, d):
    """All turns appended to a history, in two goes, and read back."""
    folder, turns = scratch_folder(spark, "history"), table(spark, d, "conversations").select("role", "text", "turn")
    for odd in (0, 1):
        texts.add_history(turns.where(F.col("turn") % 2 == odd), folder)
    return spark.read.schema(texts.HISTORY).json(folder).where(F.to_timestamp("timestamp").isNotNull()).groupBy("role", "text").agg(F.count("*").alias("n"))


_SPLIT = "CASE WHEN conv_id % 5 = 0 THEN 'heldout' ELSE 'train' END AS split"


@_r.query(f"WITH {CONVERSATIONS}, s AS (SELECT {_SPLIT}, text FROM c) SELECT s.split, sum(length(text) + 1)::BIGINT AS chars, count(*)::BIGINT AS conversations, any_value(n)::BIGINT AS distinct_chars FROM s JOIN (SELECT split, count(DISTINCT ch) AS n FROM (SELECT split, unnest({_CHARS('text || chr(10)')}) AS ch FROM s) GROUP BY split) k USING (split) GROUP BY s.split")
def corpus_files(spark, d):
    """Train and held-out conversations written as text files, and their statistics."""
    return texts.write_corpus(_rendered(spark, d).selectExpr(_SPLIT, "text"), scratch_folder(spark, "corpus"))


_PUBLISHED = lambda split, which: f"SELECT '{split}' AS split, sum(length(text) + 1)::BIGINT AS chars, sum(strlen(text) + 1)::BIGINT AS bytes, count(*)::BIGINT AS conversations, sum(len(list_filter(string_split(text, chr(10)), lambda x: x[1] IN ('{USER}', '{BOT}'))))::BIGINT AS turns, any_value(digest) AS digest FROM {which}, ({_digest_sql('conv_id').replace('FROM c)', f'FROM {which})')}) HAVING count(*) > 0"


@_r.query(f"WITH {CONVERSATIONS}, held AS (SELECT * FROM c WHERE conv_id % 5 = 0), train AS (SELECT * FROM c WHERE conv_id % 5 <> 0) {_PUBLISHED('heldout', 'held')} UNION ALL {_PUBLISHED('train', 'train')}")
def corpus_publication(spark, d):
    """What is published of both splits, with the digest of their conversations in order."""
    return texts.publication(_rendered(spark, d).selectExpr("conv_id", _SPLIT, "text"), ["conv_id"])


@_r.query(f"WITH g AS ({generator_queries.ORACLE_SQL['greetings']}) SELECT count(*)::BIGINT AS rows, count(DISTINCT line)::BIGINT AS \"distinct\", round(count(DISTINCT line)::DOUBLE / greatest(count(*), 1), 6) AS ratio FROM g")
def greeting_files(spark, d):
    """A greeting for every document written as text files, and how many differ."""
    return texts.write_lines(generator_queries.greetings(spark, d), scratch_folder(spark, "greetings"))


@_r.query(lesson_queries.ORACLE_SQL["lesson_log_pairs"])
def lesson_append(spark, d):
    """The lesson log appended record by record to a folder, and its pairs read back."""
    folder = scratch_folder(spark, "lessons")
    log = lessons.records(lesson_queries._log_lines(spark, d))
    for undone in (True, False):
        lesson_log.append(log.where(F.col("rolled_back") == undone), folder)
    return lessons.past_pairs(lessons.records(spark.read.text(folder))).groupBy("wording", "answer").agg(F.count("*").alias("n"))


@_r.query("WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) < 2 THEN array_to_string(ws, '') ELSE array_to_string(ws[1:len(ws) - 1], ', ') || ' and ' || ws[len(ws)] END AS listed FROM w WHERE ws IS NOT NULL")
def listed_words(spark, d):
    """Every document's different words as a list in a sentence."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null")).select("doc_id", T.list_joined(words).alias("listed"))


_TEMPLATE = "{Subject}? {Pronoun} {be} known by {owner} name, {name}; {several} are many, and {article} {name} {do} what {pronoun} can."
_SAME = f"w IN ({', '.join(map(quoted, inflect.PAIRED + inflect.UNCOUNTED))})"
_MANY = f"w IN ({', '.join(map(quoted, inflect.PAIRED))})"
_AN = "CASE WHEN contains('aeiou', left(w, 1)) THEN 'an' ELSE 'a' END"


def _filled_sql() -> str:
    two = lambda one, many: f"(CASE WHEN {_MANY} THEN '{many}' ELSE '{one}' END)"
    values = {"subject": f"(CASE WHEN {_SAME} THEN w ELSE {_AN} || ' ' || w END)", "pronoun": two("it", "they"), "be": two("is", "are"), "owner": two("its", "their"), "name": "w", "article": f"({_AN})", "do": two("does", "do"), "several": "plural"}
    upper = lambda v: f"(upper(left({v}, 1)) || substr({v}, 2))"
    return D.filled(quoted(_TEMPLATE), values | {k.capitalize(): upper(v) for k, v in values.items()})


@_r.query(f"""WITH p AS ({generator_queries.ORACLE_SQL['plural_forms']}) SELECT w, CASE WHEN {_SAME} THEN w ELSE {_AN} || ' ' || w END AS phrase, {_filled_sql()} AS filled,
regexp_matches(w, 's$') AND w <> 'is' AS inflectable, upper(left(w, 1)) || substr(w, 2) AS capital, 'I ' || w AS kept, left(w, 1) || substr(w, 2) || '.' AS small FROM p""")
def word_phrases(spark, d):
    """For every word of the documents: its phrase, a template that agrees with it, whether it could be a verb in the third person, and its first letter's cases."""
    w = F.col("w")
    return word_vocabulary(table(spark, d, "documents")).select(
        "w", inflect.noun_phrase(w).alias("phrase"), inflect.filled(F.lit(_TEMPLATE), inflect.agreement(w)).alias("filled"), inflect.inflectable(w).alias("inflectable"),
        T.capitalized(w).alias("capital"), T.decapitalized(F.concat(F.lit("I "), w)).alias("kept"), T.decapitalized(F.concat(T.capitalized(w), F.lit("."))).alias("small"),
    )
