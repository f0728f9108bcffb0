"""Queries on conversations and documents as corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.dialect import DUCKDB as D
from turnloom.functions.dialect import SPARK as S
from turnloom.functions.dialect import quoted
from turnloom.functions.markers import BASE, BOT, END, START, THINK, USER
from turnloom.operators import checkpoints, corpus
from turnloom.plans.registry import Registry, table
from turnloom.session import scratch_folder, spread

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle
SEED = 1234

#: Rendered turns, as a CTE.
TURNS = f"""t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN '{USER}' ELSE '{BOT}' END || replace(text, chr(10), ' ') || '{END}' AS line FROM conversations WHERE role <> 'system')"""
CONVERSATIONS = TURNS + f""", c AS (SELECT conv_id, '{START}' || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id)"""
_CHARS = lambda t: f"list_filter(string_split({t}, ''), lambda x: x <> '')"
LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::BIGINT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
BASE_SQL = "[" + ", ".join(f"chr({ord(c)})" for c in sorted(set(BASE))) + "]"
#: The vocabulary of documents and the base set.
VOCAB = f"v AS (SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::INTEGER AS id FROM (SELECT DISTINCT unnest({_CHARS('text')}) AS ch FROM documents UNION SELECT unnest({BASE_SQL})))"


def _turns(spark, d):
    return corpus.turns(table(spark, d, "conversations"))


@_r.query(f"""WITH {TURNS}, n AS (SELECT count(DISTINCT ch) AS n FROM (SELECT unnest({_CHARS('line')}) AS ch FROM t))
SELECT (sum(length(line) + 1) + 2 * count(DISTINCT conv_id))::BIGINT AS chars, (sum(strlen(line) + 1) + 4 * count(DISTINCT conv_id))::BIGINT AS bytes,
  count(DISTINCT conv_id)::BIGINT AS conversations, count(*)::BIGINT AS turns, count(*) FILTER (line[1] = '{BOT}')::BIGINT AS bot_turns,
  count(*) FILTER (line[1] = '{BOT}' AND contains(line, '{THINK}'))::BIGINT AS thinking_turns, (max(n) + 2)::BIGINT AS distinct_chars FROM t, n""")
def corpus_describe(spark, d):
    return corpus.describe(_turns(spark, d))


@_r.query(f"WITH {TURNS} SELECT conv_id, turn, line FROM t")
def render_turns(spark, d):
    return _turns(spark, d).select("conv_id", "turn", "line")


@_r.query(f"WITH {CONVERSATIONS} SELECT conv_id, text, sha256(text) AS sha256 FROM c")
def render_conversations(spark, d):
    return corpus.rendered(_turns(spark, d)).select("conv_id", "text", F.sha2("text", 256).alias("sha256"))


@_r.query(f"WITH {CONVERSATIONS} SELECT conv_id, unnest(range(len(regexp_extract_all(text, '{USER}(.*?){END}', 1))))::INTEGER AS pos, unnest(regexp_extract_all(text, '{USER}(.*?){END}', 1)) AS body FROM c")
def user_lines(spark, d):
    found = F.regexp_extract_all("text", F.lit(f"{USER}(.*?){END}"), F.lit(1))
    return corpus.rendered(_turns(spark, d)).select("conv_id", F.posexplode(found).alias("pos", "body"))


@_r.query(f"WITH {TURNS} SELECT conv_id, min(turn)::BIGINT AS turn, arg_min(line[2:length(line) - 1], turn) AS body FROM t WHERE line[1] = '{BOT}' GROUP BY conv_id")
def bot_first_line(spark, d):
    bots = _turns(spark, d).where(F.startswith("line", F.lit(BOT)))
    return bots.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by(T.turn_body(F.col("line")), "turn").alias("body"))


@_r.query(f"WITH {VOCAB} SELECT ch, id FROM v")
def char_vocab(spark, d):
    return corpus.vocabulary(table(spark, d, "documents"))


@_r.query(f"WITH {VOCAB}, {TURNS}, x AS (SELECT conv_id, turn, unnest({_CHARS('line')}) AS ch, unnest(range(length(line))) AS i FROM t) SELECT conv_id, turn, array_to_string(list(id ORDER BY i), ' ') AS ids, count(*)::INTEGER AS n FROM x JOIN v USING (ch) GROUP BY ALL")
def encode_ids(spark, d):
    codec = corpus.Codec.of(corpus.vocabulary(table(spark, d, "documents")))
    ids = _turns(spark, d).select("conv_id", "turn", codec.encode(F.col("line")).alias("ids"))
    return ids.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.size("ids").alias("n"))


@_r.query("SELECT doc_id, true AS same, length(text)::INTEGER AS n FROM documents")
def decode_roundtrip(spark, d):
    docs = table(spark, d, "documents")
    codec = corpus.Codec.of(corpus.vocabulary(docs))
    ids = docs.select("doc_id", "text", codec.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", (codec.decode(F.col("ids")) == F.col("text")).alias("same"), F.size("ids").alias("n"))


@_r.query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter({_CHARS('text')}, lambda x: NOT list_contains({BASE_SQL}, x)))), '') AS unknown FROM documents")
def unknown_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.unknown(F.col("text")), "").alias("unknown"))


@_r.query(f"SELECT doc_id, array_to_string(list_filter({_CHARS('text')}, lambda x: list_contains({BASE_SQL}, x)), '') AS text FROM documents")
def drop_unknown(spark, d):
    return table(spark, d, "documents").select("doc_id", T.known_only(F.col("text")).alias("text"))


@_r.query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM benchmark")
def normalize_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.normal(F.col("text")).alias("text"))


REPLIES = f"r AS (SELECT item_id, regexp_replace(regexp_extract(text, '^[^{T.STOPS}\\n]*'), '^\\s+|\\s+$', '', 'g') AS reply FROM benchmark)"


def replies(spark, d):
    """The fixture's replies: the first line of each benchmark text."""
    return table(spark, d, "benchmark").select("item_id", T.truncated_reply(F.col("text")).alias("reply"))


@_r.query(f"WITH {REPLIES} SELECT item_id, reply FROM r")
def truncate_reply(spark, d):
    return replies(spark, d)


@_r.query(f"""WITH m AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE text[1:item_id] || '{THINK}' || text[item_id + 1:] END AS t FROM benchmark), p AS (SELECT *, strpos(t, '{THINK}') AS pos FROM m)
SELECT item_id, CASE WHEN pos = 0 THEN '' ELSE regexp_replace(t[1:pos - 1], '^\\s+|\\s+$', '', 'g') END AS thought, CASE WHEN pos = 0 THEN t ELSE regexp_replace(t[pos + 1:], '^\\s+|\\s+$', '', 'g') END AS said FROM p""")
def split_thought(spark, d):
    """A think marker is put behind as many characters as the item's number, but in every third item."""
    marked = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.left("text", F.col("item_id")), F.lit(THINK), F.substr("text", F.col("item_id") + 1)))
    t = table(spark, d, "benchmark").select("item_id", marked.alias("t"))
    return t.select("item_id", T.thought_of(F.col("t")).alias("thought"), T.said_of(F.col("t")).alias("said"))


def _loop_sql() -> str:
    """Loops by runs of s[i] = s[i + n]: a unit of n characters three times in a row is such a run of 2 n; stutters by neighbouring tokens."""
    white, letter = r"[\s\x0B\x85\p{Z}]", r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
    other = f"[^{white[1:-1]}{letter[1:-1]}]"
    units = range(2, 15)
    differs = ", ".join(f"CASE WHEN c = lead(c, {n}) OVER w THEN 0 ELSE 1 END AS d{n}" for n in units)
    runs = ", ".join(f"sum(d{n}) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {2 * n - 1} FOLLOWING) AS r{n}, sum(solid) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS s{n}" for n in units)
    least = "CASE " + " ".join(f"WHEN r{n} = 0 AND s{n} >= 2 THEN i * 16 + {n}" for n in units) + " END"
    return f"""{LINES}, y AS (SELECT doc_id, line_no, line, regexp_extract(line, '^[^{T.STOPS}\n]*') AS head FROM l),
u AS (SELECT t, row_number() OVER () AS k FROM (SELECT line AS t FROM y UNION SELECT head FROM y)),
ch AS (SELECT k, c, row_number() OVER () AS o FROM (SELECT k, unnest({_CHARS('t')}) AS c FROM u)), ci AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM ch),
e AS (SELECT k, i, CASE WHEN regexp_matches(c, '{white}') THEN 0 ELSE 1 END AS solid, {differs} FROM ci WINDOW w AS (PARTITION BY k ORDER BY i)),
f AS (SELECT k, min({least}) AS at FROM (SELECT k, i, {runs} FROM e) GROUP BY k),
s AS (SELECT k, ts, list_filter(range(1, len(ts) - 1), lambda j: ts[j] = ts[j + 2] AND length(ts[j]) <= 12 AND regexp_matches(ts[j], '^{letter}+$') AND regexp_matches(ts[j + 1], '^{white}+$'))[1] AS j
  FROM (SELECT k, regexp_extract_all(t, '{letter}+|{white}+|{other}') AS ts FROM u)),
z AS (SELECT t, CASE WHEN f.at IS NOT NULL THEN left(t, f.at // 16 + f.at % 16 - 1) WHEN j IS NOT NULL THEN array_to_string(ts[1:j], '') ELSE t END AS cut FROM u LEFT JOIN f USING (k) LEFT JOIN s USING (k))"""


@_r.query(f"WITH {_loop_sql()} SELECT doc_id, line_no, regexp_replace(h.cut, '^[\\s\\x0B\\x85\\p{{Z}}]+|[\\s\\x0B\\x85\\p{{Z}}]+$', '', 'g') AS reply, z.cut <> line AS cut FROM y JOIN z ON z.t = line JOIN z h ON h.t = head")
def trim_loop(spark, d):
    """Every line of every document as a reply, cut where it loops or stutters."""
    lines = corpus.lines(spread(table(spark, d, "documents").select("doc_id", "text")))
    return lines.select("doc_id", "line_no", T.clean_response(F.col("line")).alias("reply"), (T.trim_loop(F.col("line")) != F.col("line")).alias("cut"))


@_r.query(f"""WITH {TURNS}, k AS (SELECT *, row_number() OVER w AS back, first(line) OVER w AS cur, first(role) OVER w AS asker FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
s AS (SELECT *, length(cur) + 2 + coalesce(sum(CASE WHEN back > 1 THEN length(line) + 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC), 0) AS cost FROM k WHERE asker = 'user'),
f AS (SELECT conv_id, max(cur) AS cur, count(*) AS n, count(*) FILTER (back BETWEEN 2 AND 5 AND cost <= 600) AS n_kept, string_agg(line, chr(10) ORDER BY turn) FILTER (back BETWEEN 2 AND 5 AND cost <= 600) AS kept FROM s GROUP BY conv_id)
SELECT conv_id, right(concat_ws(chr(10), CASE WHEN n_kept = n - 1 THEN '{START}' END, kept, cur || chr(10) || '{BOT}'), 600) AS prompt FROM f""")
def prompt_window(spark, d):
    return corpus.prompt_windows(_turns(spark, d), 600)


@_r.query(f"WITH {TURNS}, p AS (SELECT conv_id, turn, line, lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM t) SELECT conv_id, turn, line, next FROM p WHERE next IS NOT NULL AND line[1] = '{USER}' AND next[1] = '{BOT}'")
def lead_pairs(spark, d):
    pairs = corpus.lead_pairs(_turns(spark, d), "conv_id", "turn")
    return pairs.where(F.startswith("line", F.lit(USER)) & F.startswith("next", F.lit(BOT))).select("conv_id", "turn", "line", "next")


@_r.query(f"""WITH {LINES}, p AS (SELECT line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM l), n AS (SELECT line, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY ALL),
b AS (SELECT line, sum(n)::BIGINT AS total, max(n) AS top FROM n GROUP BY line), a AS (SELECT b.line, max(next) AS next, total, round(top / total, 6) AS top_share FROM b JOIN n ON n.line = b.line AND n.n = top WHERE total >= 8 AND top / total > 0.5 GROUP BY ALL)
SELECT * FROM a ORDER BY total DESC, top_share DESC, line DESC LIMIT 8""")
def dominant_replies(spark, d):
    return corpus.dominant(corpus.lead_pairs(corpus.lines(table(spark, d, "documents")), "doc_id", "line_no"))


@_r.query("""WITH u AS (SELECT DISTINCT text FROM documents), n AS (SELECT sum(length(text))::BIGINT AS unique_chars FROM u)
SELECT unique_chars, (30000000 * 3 // 20 // greatest(1, unique_chars))::BIGINT AS passes, (30000000 * 3 // 20 // greatest(1, unique_chars)) > 60 AS too_many FROM n""")
def repetition_passes(spark, d):
    """How often the unique texts repeat in a corpus of 30 million characters of which 85% are composed."""
    n = table(spark, d, "documents").select("text").distinct().agg(F.sum(F.length("text")).alias("unique_chars"))
    return n.withColumn("passes", F.expr("30000000 * 3 div 20 div greatest(1, unique_chars)")).withColumn("too_many", F.col("passes") > 60)


@_r.query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents")
def word_vocab(spark, d):
    from turnloom.operators import quality

    return quality.word_vocabulary(table(spark, d, "documents"))


@_r.query(f"WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {D.draw(SEED, 'doc_id', 0)}, doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place <= greatest(1, floor(n * 0.1)) AS held_out FROM p")
def heldout_split(spark, d):
    return corpus.heldout_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, SEED)


@_r.query(f"SELECT doc_id, row_number() OVER (ORDER BY {D.draw(SEED + 1, 'doc_id', 0)}, doc_id)::BIGINT AS place FROM documents")
def shuffle_order(spark, d):
    return corpus.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", SEED + 1).withColumn("place", F.col("place").cast("long"))


@_r.query("WITH s AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER () AS total FROM documents) SELECT doc_id, before::BIGINT AS starts_at, CASE WHEN before >= floor(total * 0.9) THEN 'validation' WHEN before + n > floor(total * 0.9) THEN 'both' ELSE 'train' END AS part FROM s")
def tail_split(spark, d):
    """Documents end to end; the last tenth of the characters is for validation."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    cut = int(docs.agg(F.sum("n")).first()[0] * 0.9)
    placed = corpus.prefix_sums(docs, [F.col("doc_id")], F.col("n"), "starts_at").withColumn("starts_at", F.col("starts_at").cast("long"))
    part = F.when(F.col("starts_at") >= cut, "validation").when(F.col("starts_at") + F.col("n") > cut, "both").otherwise("train")
    return placed.select("doc_id", "starts_at", part.alias("part"))


@_r.query(f"WITH {CONVERSATIONS}, s AS (SELECT conv_id, coalesce(sum(length(text) + 1) OVER (ORDER BY {D.draw(SEED, 'conv_id', 0)}, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled_before FROM c) SELECT * FROM s WHERE filled_before < 60000")
def budget_fill(spark, d):
    chunks = corpus.rendered(_turns(spark, d)).select("conv_id", F.length("text").alias("size"))
    return corpus.budget_fill(chunks, "conv_id", F.col("size") + 1, 60_000, SEED).select("conv_id", F.col("filled_before").cast("long").alias("filled_before"))


_IDS = f"x AS (SELECT conv_id, list_transform({_CHARS('text')}, lambda k: unicode(k)) AS ids FROM c)"
_JOINED = lambda a: f"array_to_string({a}, ' ')"


def _codes(spark, d):
    return corpus.rendered(_turns(spark, d)).select("conv_id", F.transform(T.characters(F.col("text")), lambda c: F.ascii(c)).alias("ids"))


def _spelled(df, *names):
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), " ") for n in names})


@_r.query(f"WITH {CONVERSATIONS}, {_IDS}, w AS (SELECT conv_id, ids, unnest(range(0, greatest(len(ids) - 64 - 1, 0), 64))::INTEGER AS start FROM x) SELECT conv_id, start, {_JOINED('ids[start + 1:start + 64]')} AS x, {_JOINED('ids[start + 2:start + 65]')} AS y FROM w")
def stride_windows(spark, d):
    """Windows of 64 code points and their successors."""
    return _spelled(corpus.stride_windows(_codes(spark, d), "conv_id", 64), "x", "y")


@_r.query(f"WITH {CONVERSATIONS}, {_IDS}, w AS (SELECT conv_id, ids, unnest(range(3))::INTEGER AS draw_no FROM x WHERE len(ids) > 65), s AS (SELECT *, ({D.draw(7, 'conv_id', 'draw_no')} % (len(ids) - 65))::INTEGER AS start FROM w) SELECT conv_id, draw_no, start, {_JOINED('ids[start + 1:start + 64]')} AS x, {_JOINED('ids[start + 2:start + 65]')} AS y FROM s")
def hashed_windows(spark, d):
    return _spelled(corpus.hashed_windows(_codes(spark, d), "conv_id", 64, 3, 7), "x", "y")


_KINDS = [34, 16, 10, 14, 16]


@_r.query(f"SELECT doc_id, {D.weighted(5, 'doc_id', 0, _KINDS)}::INTEGER AS kind FROM documents")
def weighted_choice(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(f"cast({S.weighted(5, 'doc_id', 0, _KINDS)} as int)").alias("kind"))


@_r.query(f"SELECT doc_id FROM documents ORDER BY {D.draw(9, 'doc_id', 0)}, doc_id LIMIT 40")
def sample_k(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.expr(S.draw(9, "doc_id", 0)), "doc_id").limit(40)


@_r.query("WITH k AS (SELECT DISTINCT ON (lang, w) lang, w, doc_id, i FROM (SELECT lang, doc_id, unnest(range(len(regexp_extract_all(text, '\\w+'))))::INTEGER AS i, unnest(regexp_extract_all(text, '\\w+')) AS w FROM documents) ORDER BY lang, w, doc_id, i), o AS (SELECT lang, w, doc_id, i, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i)::INTEGER AS ordinal FROM k) SELECT * FROM o WHERE ordinal <= 8")
def dedup_keep_first(spark, d):
    """The first eight different words of each language, in order of appearance."""
    words = table(spark, d, "documents").select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z_]+"), F.lit(0))).alias("i", "w"))
    return corpus.keep_first(words.select("lang", "w", F.struct("doc_id", "i").alias("n")), "lang", "n", "w", 8).select("lang", "w", "n.doc_id", "n.i", "ordinal")


@_r.query("WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (trim(line, ' ') = '')::BIGINT AS n_blank, count(*) FILTER (regexp_matches(line, '[0-9]\\s*[-+*/]\\s*[0-9]'))::BIGINT AS n_sums FROM x GROUP BY doc_id")
def line_lint(spark, d):
    """Lines, blank lines and lines that look like a sum, by document."""
    lines = corpus.lines(table(spark, d, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum((F.trim("line") == "").cast("long")).alias("n_blank"), F.sum(F.regexp_like("line", F.lit(r"[0-9]\s*[-+*/]\s*[0-9]")).cast("long")).alias("n_sums"))


@_r.query("SELECT doc_id, regexp_matches(text, '[0-9]\\s*[-+*/]\\s*[0-9]') AND regexp_matches(text, '[0-9]') AS is_sum FROM documents")
def looks_like_sum(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_like_a_sum(F.col("text"), F.col("text")).alias("is_sum"))


@_r.query("SELECT doc_id, try_cast(list_last(regexp_extract_all(text, '-?[0-9]+')) AS BIGINT) AS number FROM documents")
def final_number(spark, d):
    return table(spark, d, "documents").select("doc_id", T.final_number(F.col("text")).alias("number"))


_HOSTS = ["//cdn.", "https://fonts.", "http://ajax.", "@import"]


@_r.query("SELECT page_id, " + " OR ".join(f"contains(html, {quoted(h)})" for h in _HOSTS) + " AS off_host, NOT regexp_matches(url, '[\"\\\\]') AS js_safe FROM pages")
def page_lint(spark, d):
    """Pages that load from another host, and urls that are safe inside a script's string."""
    off = F.lit(False)
    for h in _HOSTS:
        off = off | F.contains("html", F.lit(h))
    return table(spark, d, "pages").select("page_id", off.alias("off_host"), (~F.regexp_like("url", F.lit(r'["\\]'))).alias("js_safe"))


@_r.query(f"WITH {TURNS}, n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) SELECT count(*)::BIGINT AS conversations, round(avg(n), 6) AS mean_turns, min(n)::BIGINT AS least_turns, max(n)::BIGINT AS most_turns FROM n")
def conversation_lengths(spark, d):
    n = _turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("conversations"), F.round(F.avg("n"), 6).alias("mean_turns"), F.min("n").alias("least_turns"), F.max("n").alias("most_turns"))


_MARKED = f"m AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' {THINK} ' ELSE left(text, 9) || '{THINK}' || right(text, length(text) - 9) END AS t FROM benchmark)"


@_r.query(f"WITH {_MARKED}, p AS (SELECT *, strpos(t, '{THINK}') AS pos FROM m), s AS (SELECT *, trim(t[1:pos - 1], chr(32) || chr(9) || chr(10) || chr(13)) AS a, trim(t[pos + 1:], chr(32) || chr(9) || chr(10) || chr(13)) AS b FROM p) SELECT item_id, CASE WHEN pos > 0 THEN a END AS working, CASE WHEN pos = 0 THEN t WHEN b = '' THEN '(no reply)' ELSE b END AS reply FROM s")
def display_reply(spark, d):
    """What a reader sees of raw replies: the working apart, an empty reply named."""
    raw = F.expr(f"CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' {THINK} ' ELSE left(text, 9) || '{THINK}' || right(text, length(text) - 9) END")
    working, reply = T.displayed(F.col("t"))
    return table(spark, d, "benchmark").select("item_id", raw.alias("t")).select("item_id", working.alias("working"), reply.alias("reply"))


_FAULTY = f"CASE WHEN turn % 7 = 3 THEN replace(line, ' the ', ' {END}the ') WHEN turn % 5 = 4 THEN substring(line, 2) ELSE line END"


@_r.query(f"WITH {TURNS}, f AS (SELECT conv_id, {_FAULTY} AS line FROM t) SELECT conv_id, count(*)::BIGINT AS n_lines, count(*) FILTER (contains(left(line, length(line) - 1), '{END}'))::BIGINT AS n_stray, count(*) FILTER (left(line, 1) NOT IN ('{USER}', '{BOT}'))::BIGINT AS n_unmarked FROM f WHERE trim(line, ' ') <> '' GROUP BY conv_id")
def turn_lint(spark, d):
    """Rendered turns, some with an end marker inside or without their own marker."""
    return corpus.turn_lint(_turns(spark, d).select("conv_id", F.expr(_FAULTY).alias("line")), "conv_id")


@_r.query(f"WITH {TURNS}, b AS (SELECT conv_id AS key, string_agg(line, chr(10) ORDER BY turn) AS text FROM t GROUP BY conv_id), n AS (SELECT conv_id, turn, line, lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM t), p AS (SELECT conv_id * 1000 + turn AS key, line || chr(10) || next AS text FROM n WHERE left(line, 1) = '{USER}' AND left(next, 1) = '{BOT}'), u AS (SELECT 0 AS part, key, text FROM b UNION ALL SELECT 1, key, text FROM p) SELECT (row_number() OVER (ORDER BY part, key) - 1)::BIGINT AS ordinal, part::INTEGER AS part, key, text FROM u")
def blocks_and_pairs(spark, d):
    """Conversations as blocks, then their exchanges as pairs, in one order."""
    t = _turns(spark, d)
    blocks = t.groupBy(F.col("conv_id").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]).alias("lines"))
    two = corpus.lead_pairs(t, "conv_id", "turn").where(F.startswith("line", F.lit(USER)) & F.startswith("next", F.lit(BOT)))
    both = corpus.united(blocks, two.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("line").alias("user"), F.col("next").alias("bot")))
    placed = corpus.prefix_sums(both, [F.col("part"), F.col("key")], F.lit(1), "ordinal")
    return placed.select(F.col("ordinal").cast("long").alias("ordinal"), "part", "key", F.array_join("lines", "\n").alias("text"))


_SET = "list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')) FILTER ({})))"


@_r.query(f"WITH s AS (SELECT conv_id, {_SET.format(chr(39).join(['role = ', 'user', '']))} AS used, {_SET.format(chr(39).join(['role = ', 'assistant', '']))} AS ours, {_SET.format('turn = 0')} AS local FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_sort(list_filter(list_intersect(coalesce(used, []), coalesce(ours, [])), lambda w: NOT list_contains(coalesce(local, []), w))), ' ') AS names FROM s")
def name_sets(spark, d):
    """Words that both sides use and that the first turn lacks: (used & ours) - local."""
    word = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    of = lambda c: F.array_distinct(F.flatten(F.collect_list(F.when(c, word))))
    sets = table(spark, d, "conversations").groupBy("conv_id").agg(of(F.col("role") == "user").alias("used"), of(F.col("role") == "assistant").alias("ours"), of(F.col("turn") == 0).alias("local"))
    return sets.select("conv_id", F.array_join(F.array_sort(F.array_except(F.array_intersect("used", "ours"), "local")), " ").alias("names"))


@_r.query(f"SELECT ch, count(*)::BIGINT AS n FROM (SELECT DISTINCT doc_id, unnest(list_filter({_CHARS('text')}, lambda x: NOT list_contains({BASE_SQL}, x))) AS ch FROM documents) GROUP BY ch")
def vocab_guard(spark, d):
    """Characters that the base set lacks, and in how many documents: what training must refuse."""
    from turnloom.operators import checkpoints

    return checkpoints.missing_symbols(table(spark, d, "documents"), sorted(set(BASE)))


_ASKS, _TELLS = "[.?!]$", "^[A-Z]"


@_r.query(f"""WITH {LINES}, n AS (SELECT line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM l WHERE regexp_matches(line, '[^\\s\\p{{Z}}]')),
p AS (SELECT i, line, lead(line) OVER (ORDER BY i) AS next FROM n) SELECT (i // 2)::BIGINT AS pair, line AS first, next AS second FROM p WHERE i % 2 = 0 AND regexp_matches(line, '{_ASKS}') AND regexp_matches(next, '{_TELLS}')""")
def line_pairs(spark, d):
    """All lines of all documents as one sequence, two by two: pairs of a line that ends a sentence and one that opens with a capital."""
    lines = corpus.lines(spread(table(spark, d, "documents").select("doc_id", "text")))
    return corpus.paired(lines, ["doc_id", "line_no"], F.regexp_like("line", F.lit(_ASKS)), F.regexp_like("line", F.lit(_TELLS)))


@_r.query(f"""WITH x AS (SELECT doc_id, list_transform({_CHARS('text')}, lambda c: unicode(c)) AS ids FROM documents WHERE text <> ''),
a AS (SELECT unnest(ids) AS id, unnest(range(len(ids))) + off AS i FROM (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM x)),
n AS (SELECT count(*) AS n FROM a), s AS (SELECT draw_no, ({D.draw(11, "'window'", 'draw_no')} % (n - 33))::BIGINT AS start FROM (SELECT unnest(range(n // 50)) AS draw_no, n FROM n)),
c AS (SELECT i // 4096 AS cell, list(id ORDER BY i) AS ids FROM a GROUP BY cell), w AS (SELECT s.draw_no, s.start, list_concat(c.ids, coalesce(d.ids, []))[start % 4096 + 1:start % 4096 + 33] AS ids FROM s JOIN c ON c.cell = start // 4096 LEFT JOIN c d ON d.cell = c.cell + 1)
SELECT draw_no, start, {_JOINED('ids[1:32]')} AS x, {_JOINED('ids[2:33]')} AS y FROM w""")
def drawn_windows(spark, d):
    """Windows of 32 code points and their successors at drawn starts of the whole corpus laid end to end, one for every 50 characters."""
    texts = spread(table(spark, d, "documents").select("doc_id", "text"))
    placed, n = corpus.end_to_end(texts, "doc_id", "text")
    windows = corpus._windows_of(placed, n, 32, corpus.drawn_starts(spark, n // 50, 11, n - 33)).withColumnRenamed("at", "draw_no")
    return _spelled(windows.withColumns({c: F.transform(T.characters(F.col(c)), lambda k: F.ascii(k)) for c in ("x", "y")}), "x", "y")


def _digest_sql(order: str) -> str:
    m = corpus.DIGEST_MODULUS
    squares = lambda b: "[" + ", ".join(str(pow(b, 2**k, m)) for k in range(48)) + "]"
    power = lambda b: f"list_reduce(list_prepend(1::BIGINT, list_transform(range(48), lambda k: CASE WHEN ((n - 1 - i) >> k) & 1 = 1 THEN {squares(b)}[k + 1]::BIGINT ELSE 1::BIGINT END)), lambda x, y: x * y % {m})"
    words = ", ".join(f"(sum(('0x' || h[{8 * j + 1}:{8 * j + 8}])::BIGINT % {m} * {power(b)} % {m}) % {m})::BIGINT::VARCHAR" for j, b in enumerate(corpus.DIGEST_BASES))
    return f"SELECT max(n)::BIGINT AS n, sha256(concat_ws(':', max(n)::VARCHAR, {words})) AS digest FROM (SELECT sha256(text) AS h, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM c)"


@_r.query(f"WITH {CONVERSATIONS} SELECT 'forward' AS direction, * FROM ({_digest_sql('conv_id')}) UNION ALL SELECT 'backward', * FROM ({_digest_sql('-conv_id')})")
def corpus_digest(spark, d):
    """The digest of all conversations in their order, and in the opposite one."""
    text = corpus.rendered(_turns(spark, d)).withColumn("back", -F.col("conv_id"))
    told = lambda name, order: corpus.digest(corpus.digest_words(text, [order], "text")).select(F.lit(name).alias("direction"), "n", "digest")
    return told("forward", "conv_id").union(told("backward", "back"))


def _one_line(documents):
    """doc_id, lang, value: the texts that aren't empty, a line each. A filter on ``value`` would translate every text once more."""
    return spread(documents.where("text <> ''").select("doc_id", "lang", F.translate("text", "\n", " ").alias("value")))


@_r.query(f"""WITH {VOCAB}, l AS (SELECT doc_id, replace(text, chr(10), ' ') || chr(10) AS line, unnest({_CHARS("replace(text, chr(10), ' ') || chr(10)")}) AS ch, unnest(range(length(text) + 1)) AS i FROM documents WHERE text <> '')
SELECT doc_id, sha256(line) AS line_sha256, sha256(array_to_string(list(id ORDER BY i), ' ')) AS ids_sha256, count(*)::INTEGER AS n FROM l JOIN v USING (ch) GROUP BY doc_id, line""")
def cached_encoding(spark, d):
    """The documents' texts, a line each, in a folder of files by language, encoded through the cache: first with files of one language cut short and
    one too many, then again when they are mended. Only those are read then, and what the cache holds is the whole."""
    docs = _one_line(table(spark, d, "documents"))
    symbols = [r["ch"] for r in corpus.vocabulary(table(spark, d, "documents")).orderBy("id").collect()]
    folder = scratch_folder(spark, "encoded")
    least = table(spark, d, "documents").where("text <> ''").agg(F.min("lang")).first()[0]
    old = docs.withColumn("value", F.when(F.col("lang") == least, F.left("value", F.lit(20))).otherwise(F.col("value")))
    write = lambda df: df.select("lang", "value").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").text(f"{folder}/text")
    write(old.unionByName(docs.limit(1).withColumn("lang", F.lit("zz"))))
    checkpoints.refresh_encoded(spark, f"{folder}/text", symbols, f"{folder}/cache")
    write(docs.where(F.col("lang") == least))
    checkpoints.remove(spark, f"{folder}/text/lang=zz")
    checkpoints.refresh_encoded(spark, f"{folder}/text", symbols, f"{folder}/cache")
    ids = checkpoints.encoded_files(spark, f"{folder}/cache").select("ids")
    told = ids.select(F.sha2(corpus.Codec(symbols).decode(F.col("ids")), 256).alias("line_sha256"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.size("ids").alias("n"))
    named = docs.select("doc_id", F.sha2(F.concat("value", F.lit("\n")), 256).alias("h"))
    # Equal texts have equal encodings: each document takes one of its text's.
    return named.join(told.distinct(), F.col("h") == F.col("line_sha256")).select("doc_id", "line_sha256", "ids_sha256", "n")
