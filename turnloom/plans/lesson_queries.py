"""Queries on lessons, their log, and the registry of exports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.dialect import DUCKDB as D
from turnloom.functions.dialect import SPARK as S
from turnloom.functions.dialect import quoted
from turnloom.functions.markers import BOT, END, START, USER
from turnloom.operators import exports, lessons
from turnloom.plans.registry import Registry, table
from turnloom.session import scratch_folder
from turnloom.streaming import lesson_log, sessions

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle
ASKED = ["What is a rudder?", "whats the tide", "Who's you?", "where are we", "When was the flood?", "how do boats float?", "Why is the sky blue?", "Sing of rivers.", " WHAT IS IT?? ", "?", "who is I", "Is it late, do you think?"]


def _agree(t: str) -> str:
    for pattern, to in T.agreements():
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return t


def _rewordings_sql() -> str:
    strip = lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    put = lambda templates: "[" + ", ".join(" || ".join(p if i % 2 else quoted(p) for i, p in enumerate(re.split(r"\{(\w)\}", t)) if p) for t in templates) + "]"
    part = lambda i: f"regexp_extract(core, {quoted('(?is)' + lessons.ASKING)}, {i})"
    other = "[" + ", ".join(put([t])[1:-1].replace("x", "core", 1) if t.startswith("{x}") else f"{quoted(t.replace('{x}', ''))} || lower(core[1]) || core[2:]" for t in lessons.OTHERWISE) + "]"
    return f"""WITH q AS (SELECT doc_id, {_QUESTION(D)} AS question FROM documents), a AS (SELECT *, {strip('question')} AS asked FROM q), c AS (SELECT *, {strip("regexp_replace(asked, '[?]+$', '')")} AS core FROM a),
p AS (SELECT *, lower({part(1)}) AS w, CASE WHEN lower({part(2)}) IN ('''s', 's') THEN 'is' ELSE lower(ltrim({part(2)})) END AS v, {strip(part(3))} AS x FROM c),
b AS (SELECT doc_id, asked, CASE WHEN core = '' THEN [] WHEN w = '' THEN {other} WHEN v IN ('do', 'does', 'did') THEN {put(lessons.ACTS)} ELSE {put(lessons.STATES)} END AS ways FROM p),
e AS (SELECT doc_id, list_concat([asked], ways, list_transform(ways, lambda t: t || '?'), list_transform(ways, lambda t: upper(t[1]) || t[2:] || '?')) AS every FROM b),
u AS (SELECT doc_id, {_agree('t')} AS wording, i FROM (SELECT doc_id, unnest(every) AS t, unnest(range(len(every))) AS i FROM e)),
f AS (SELECT doc_id, wording, min(i) AS i FROM u WHERE wording <> '' GROUP BY ALL), o AS (SELECT doc_id, wording, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ordinal FROM f)
SELECT * FROM o WHERE ordinal < 8"""


#: A question for every document: a fixed odd one, or its first word behind an opening.
_OPENINGS = ["What is ", "whats ", "Who's ", "where are ", "When was ", "how do ", "Why is ", "Why does ", "Sing of ", ""]
_FIRST_WORD = lambda x: "regexp_extract(text, '[A-Za-z]+', 0)" if x.spark else "regexp_extract(text, '[A-Za-z]+')"
_QUESTION = lambda x: f"CASE WHEN doc_id % 5 = 0 THEN {x.pick(ASKED, 'doc_id // 5' if not x.spark else 'doc_id div 5')} ELSE {x.pick(_OPENINGS, 'doc_id')} || {_FIRST_WORD(x)} || '?' END"


@_r.query(_rewordings_sql())
def rewordings(spark, d):
    """The wordings of a question made from every document."""
    q = table(spark, d, "documents").selectExpr("doc_id", f"{_QUESTION(S)} AS question")
    return q.select("doc_id", F.posexplode(lessons.rewordings(F.col("question"))).alias("ordinal", "wording"))


_Q = lambda x: x.pick([a for a in ASKED if len(a) > 2], "doc_id")
_A = "'Answer ' || cast(doc_id as string) || ' is short.'"
_EARLIER = lessons.earlier_talk()
#: One or two earlier exchanges.
_CONTEXT = lambda x: f"({x.choice(101, 'doc_id', 0, _EARLIER)} || CASE WHEN {x.draw(101, 'doc_id', 1)} % 2 = 0 THEN '' ELSE {x.choice(101, 'doc_id', 2, _EARLIER)} END)"
BLOCK = 160


def _lessons_sql() -> str:
    alone = lambda opening: f"'{(START + chr(10)) if opening else ''}{USER}' || question || '{END}' || chr(10) || '{BOT}' || answer || '{END}'"
    row = lambda form, prefix, t: f"SELECT doc_id, '{form}' AS form, CASE WHEN length({prefix}) + length({t}) <= {BLOCK + 1} THEN {prefix} || {t} ELSE {t} END AS text, (strpos({t}, '{BOT}') + CASE WHEN length({prefix}) + length({t}) <= {BLOCK + 1} THEN length({prefix}) ELSE 0 END)::INTEGER AS answer_at FROM p"
    return f"p AS (SELECT doc_id, {_Q(D)} AS question, {_A} AS answer, {_CONTEXT(D)} AS context FROM documents), r AS ({row('opening', quoted(''), alone(True))} UNION ALL {row('bare', quoted(''), alone(False))} UNION ALL {row('behind', 'context', alone(False))})"


def _pairs(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{_Q(S)} AS question", f"{_A} AS answer")


@_r.query(f"WITH {_lessons_sql()} SELECT doc_id, form, text, answer_at FROM r")
def lesson_rows(spark, d):
    return lessons.lesson_rows(_pairs(spark, d), "doc_id", BLOCK, F.expr(_CONTEXT(S)))


@_r.query(f"WITH {_lessons_sql()}, c AS (SELECT *, list_transform(list_filter(string_split(text, ''), lambda k: k <> ''), lambda k: unicode(k)) AS ids, max(length(text)) OVER (PARTITION BY doc_id) AS w FROM r) SELECT doc_id, form, array_to_string(list_concat(ids[1:len(ids) - 1], list_transform(range(w - len(ids)), lambda i: 0)), ' ') AS x, array_to_string(list_concat(list_transform(range(1, len(ids)), lambda i: CASE WHEN i >= answer_at THEN ids[i + 1] ELSE -100 END), list_transform(range(w - len(ids)), lambda i: -100)), ' ') AS y FROM c")
def lesson_batch(spark, d):
    """The three forms of a pair as rows of equal width."""
    rows = lessons.lesson_rows(_pairs(spark, d), "doc_id", BLOCK, F.expr(_CONTEXT(S)))
    p = lessons.padded(rows, "doc_id")
    return p.select("doc_id", "form", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in "xy"])


@_r.query(f"WITH {_lessons_sql()}, c AS (SELECT *, list_transform(list_filter(string_split(text, ''), lambda k: k <> ''), lambda k: unicode(k)) AS ids FROM r) SELECT doc_id, form, (len(ids) - 1)::INTEGER AS n, array_to_string(ids[1:len(ids) - 1], ' ') AS x, array_to_string(list_transform(range(1, len(ids)), lambda i: CASE WHEN i >= answer_at THEN ids[i + 1] ELSE -100 END), ' ') AS y FROM c")
def lesson_mask(spark, d):
    rows = lessons.lesson_rows(_pairs(spark, d), "doc_id", BLOCK, F.expr(_CONTEXT(S)))
    x, y = lessons.encoded(F.col("text"), F.col("answer_at"))
    return rows.select("doc_id", "form", F.size(x).alias("n"), F.array_join(x.cast("array<string>"), " ").alias("x"), F.array_join(y.cast("array<string>"), " ").alias("y"))


def _log_lines(spark, d, when=None):
    """A lesson log made of events: blank lines, cut lines, and lessons undone on errors."""
    e = table(spark, d, "events")
    record = F.to_json(F.struct(
        (F.lit("2024-01-01T00:00:00+00:00") if when is None else when).alias("when"), F.concat(F.lit("What is item "), "user_id", F.lit("?")).alias("question"), F.concat(F.lit("It is "), "user_id", F.lit(".")).alias("answer"),
        F.array(F.concat(F.lit("What is item "), "user_id", F.lit("?")), F.concat(F.lit("item "), "user_id")).alias("trained_wordings"), (F.col("value") > 20).alias("learned"), (F.col("value") > 60).alias("generalized"),
        (F.col("value") / 400).alias("drift"), (F.col("event_id") % 7).alias("checks"), F.lit(6).alias("checks_baseline"), (F.col("event_type") == "error").alias("rolled_back"), F.col("event_type").alias("kind"),
    ))
    return e.select("event_id", F.when(F.col("event_id") % 77 == 0, "  ").when(F.col("event_id") % 50 == 0, F.left(record, F.lit(30))).otherwise(record).alias("value"))


_LOGGED = "e AS (SELECT * FROM events WHERE event_id % 77 <> 0 AND event_id % 50 <> 0)"


@_r.query(f"WITH {_LOGGED} SELECT wording, 'It is ' || user_id || '.' AS answer, count(*)::BIGINT AS n FROM (SELECT user_id, unnest(['What is item ' || user_id || '?', 'item ' || user_id]) AS wording FROM e WHERE event_type <> 'error') GROUP BY ALL")
def lesson_log_pairs(spark, d):
    pairs = lessons.past_pairs(lessons.records(_log_lines(spark, d)))
    return pairs.groupBy("wording", "answer").agg(F.count("*").alias("n"))


@_r.query(f"WITH {_LOGGED} SELECT count(*)::BIGINT AS lessons, count(*) FILTER (event_type <> 'error')::BIGINT AS kept, count(*) FILTER (event_type = 'error')::BIGINT AS undone, count(*) FILTER (event_type <> 'error' AND value > 20)::BIGINT AS learned, count(*) FILTER (event_type <> 'error' AND value > 60)::BIGINT AS generalized FROM e")
def session_summary(spark, d):
    return lessons.session_summary(lessons.records(_log_lines(spark, d)))


@_r.query("SELECT event_id, CASE WHEN value / 400 > 0.15::DOUBLE THEN 'drifted' WHEN 6 - event_id % 7 > 1 THEN 'forgot' ELSE 'kept' END AS decision FROM events")
def guard_decision(spark, d):
    return table(spark, d, "events").select("event_id", lessons.guard(F.col("value") / 400, F.col("event_id") % 7, F.lit(6)).alias("decision"))


@_r.query()
def similarity(spark, d):
    """Alignment ratio of every benchmark text's first line with the next item's."""
    b = table(spark, d, "benchmark").select("item_id", T.truncated_reply(F.col("text")).alias("a"))
    return lessons.similarity(b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id"), "a", "b").select("item_id", "ratio")


#: File names as made from parts: several bases, versions of one to three numbers, and names that are no exports.
_FILES = """SELECT 'p' || cast(p_size % 5 as string) || '_' || cast(p_size % 3 as string) || '.' || cast(p_partkey % 13 as string) || CASE WHEN p_partkey % 11 = 0 THEN '.2' ELSE '' END || CASE WHEN p_partkey % 17 = 0 THEN '.bak' ELSE '.txt' END AS name, p_partkey AS modified FROM part"""


def _files(spark, d):
    table(spark, d, "part").createOrReplaceTempView("turnloom_parts")
    return spark.sql(_FILES.replace("FROM part", "FROM turnloom_parts")).groupBy("name").agg(F.max("modified").alias("modified"))


_PARSED = f"f AS (SELECT name, max(modified) AS modified FROM ({_FILES}) GROUP BY name), e AS (SELECT name, modified, regexp_extract(name, {quoted(exports.NAME)}, 1) AS base, list_transform(string_split(regexp_extract(name, {quoted(exports.NAME)}, 2), '.'), lambda x: try_cast(x AS INTEGER)) AS version FROM f WHERE regexp_matches(name, {quoted(exports.NAME)}))"


@_r.query(f"WITH {_PARSED} SELECT name, base, array_to_string(version, '.') AS version, (row_number() OVER (ORDER BY base, version, name))::INTEGER AS place FROM e")
def version_parse(spark, d):
    from pyspark.sql import Window

    e = exports.parsed(_files(spark, d))
    return e.select("name", "base", exports.dotted(F.col("version")).alias("version"), F.row_number().over(Window.orderBy("base", "version", "name")).alias("place"))


@_r.query(f"WITH {_PARSED}, m AS (SELECT base, max(version) AS v FROM e GROUP BY base) SELECT base, base || '_' || array_to_string(list_concat(v[1:len(v) - 1], [v[len(v)] + 1]), '.') || '.txt' AS name FROM m")
def version_next(spark, d):
    return exports.next_versions(exports.parsed(_files(spark, d)))


_REFS = ["p1", "p2", "p0_1.3", "p3_2.1.txt", "nothing", ""]


@_r.query(f"WITH {_PARSED}, q AS (SELECT unnest([{', '.join(map(quoted, _REFS))}]) AS reference) SELECT reference, CASE WHEN reference = '' THEN (SELECT arg_max(name, row(modified, name)) FROM e) ELSE coalesce((SELECT max(name) FROM e WHERE name = reference), (SELECT max(name) FROM e WHERE name = reference || '.txt'), (SELECT arg_max(name, row(version, name)) FROM e WHERE base = reference)) END AS name FROM q")
def version_resolve(spark, d):
    return exports.resolved(exports.parsed(_files(spark, d)), spark.createDataFrame([(x,) for x in _REFS], "reference string"))


@_r.query(ORACLE_SQL["lesson_log_pairs"])
def log_stream(spark, d):
    """The lesson log read as a stream of files: equal to lesson_log_pairs over the same lines."""
    folder = scratch_folder(spark, "log")
    _log_lines(spark, d).select("value").write.text(f"{folder}/in")
    return lesson_log.run_once(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").groupBy("wording", "answer").agg(F.count("*").alias("n"))


#: Seconds that may lie between two lessons of a session.
_GAP = 12 * 3600


@_r.query(f"""WITH {_LOGGED}, o AS (SELECT DISTINCT 'It is ' || user_id || '.' AS learner, date_trunc('second', ts) AS ts, event_type, value, event_id % 7 AS checks FROM e),
g AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= {_GAP} THEN 0 ELSE 1 END AS begins FROM o WINDOW w AS (PARTITION BY learner ORDER BY ts)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY learner ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT learner, epoch_ms(min(ts))::BIGINT AS began, epoch_ms(max(ts))::BIGINT AS ended, count(*)::BIGINT AS lessons, count(*) FILTER (event_type <> 'error')::BIGINT AS kept, count(*) FILTER (event_type = 'error')::BIGINT AS undone,
  count(*) FILTER (event_type <> 'error' AND value > 20)::BIGINT AS learned, count(*) FILTER (event_type <> 'error' AND value > 60)::BIGINT AS generalized,
  count(*) FILTER (value / 400 > 0.15::DOUBLE)::BIGINT AS drifted, count(*) FILTER (value / 400 <= 0.15::DOUBLE AND 6 - checks > 1)::BIGINT AS forgot FROM r GROUP BY learner, run""")
def session_stream(spark, d):
    """Sessions of the lesson log as a stream of files in no order of time, half of them a batch, a learner being who is asked about."""
    folder = scratch_folder(spark, "sessions")
    lines = _log_lines(spark, d, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).select("value")
    lines.repartition(4, F.crc32("value")).write.text(f"{folder}/in")
    files = len(spark.read.text(f"{folder}/in").inputFiles())
    found = sessions.run_once(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", F.col("answer"), _GAP, "3650 days", files=max(1, (files + 1) // 2), close=True)
    return found.select("learner", F.unix_millis("began").alias("began"), F.unix_millis("ended").alias("ended"), *sessions.FIGURES)
