"""Queries that generate: worked arithmetic, other problems, sentences, greetings, exchanges, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import inflect
from turnloom.functions.arithmetic import OTHERS, Workings, other_problem
from turnloom.functions.dialect import DUCKDB as D
from turnloom.functions.dialect import HELD as H
from turnloom.functions.dialect import SPARK as S
from turnloom.functions.dialect import held, quoted
from turnloom.operators import assemble, corpus, dialogue, dictionary
from turnloom.plans.registry import Registry, table
from turnloom.session import staged

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle

#: Operands from line items: sizes of one to three digits.
_OPERANDS = {
    "+": ("l_orderkey % 1000", "l_partkey % 1000"), "-": ("l_orderkey % 500", "l_partkey % 400"),
    "*": ("l_orderkey % 200 + 1", "l_partkey % 25 + 1"), "/": ("l_orderkey % 400 + 1", "l_partkey % 12 + 1"),
}


def _worked(op: str, name: str) -> None:
    l, r = _OPERANDS[op]  # noqa: E741
    sql = f"WITH p AS (SELECT DISTINCT ({l})::BIGINT AS l, ({r})::BIGINT AS r FROM lineitem) " + " UNION ALL ".join(
        f"SELECT l, r, '{m}' AS method, {text} AS working FROM p WHERE ({text}) IS NOT NULL" for m, text in Workings(D).methods(op).items()
    )

    def query(spark, d):
        pairs = table(spark, d, "lineitem").select(F.expr(l).cast("long").alias("l"), F.expr(r).cast("long").alias("r")).distinct()
        shown = F.array(*[F.struct(F.lit(m).alias("method"), F.expr(text).alias("working")) for m, text in Workings(S).methods(op).items()])
        return pairs.select("l", "r", F.explode(shown).alias("m")).select("l", "r", "m.method", "m.working").where("working is not null")

    query.__name__, query.__doc__ = name, f"All methods that apply to l {op} r, for the operands found in line items."
    _r.query(sql)(query)


for _op, _name in (("+", "arith_add"), ("-", "arith_sub"), ("*", "arith_mul"), ("/", "arith_div")):
    _worked(_op, _name)


def _others(d) -> str:
    parts = {k: other_problem(d, k, 61, "doc_id") for k in OTHERS}
    pick = lambda i: "CASE doc_id % 5 " + " ".join(f"WHEN {n} THEN {parts[k][i]}" for n, k in enumerate(OTHERS)) + " END"
    return [f"{pick(0)} AS question", f"{pick(1)} AS working", f"{pick(2)} AS answer"]


@_r.query(f"SELECT doc_id, {', '.join(_others(D))} FROM documents")
def arith_other(spark, d):
    """Percentages, squares, three-term sums, rounding and word problems."""
    drawn = table(spark, d, "documents").selectExpr("doc_id", *held(S, 61, "doc_id", range(1, 4)))
    return drawn.selectExpr("doc_id", *_others(H))


@_r.query(f"SELECT doc_id, {', '.join(assemble.operands(D, 71, 'doc_id'))} FROM documents")
def arith_operands(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", *held(S, 71, "doc_id", range(8))).selectExpr("doc_id", *assemble.operands(H, 71, "doc_id"))


_exchange = lambda x: [f"{assemble.worded(x, 73, 'doc_id')} AS question", f"{assemble.working(x, 73, 'doc_id')} AS answer"]


@_r.query(f"WITH o AS (SELECT doc_id, {', '.join(assemble.operands(D, 71, 'doc_id'))} FROM documents) SELECT doc_id, {', '.join(_exchange(D))} FROM o")
def arith_exchange(spark, d):
    """A drawn problem, its wording, and the first method that applies from a drawn place on."""
    drawn = arith_operands(spark, d).selectExpr("*", *held(S, 73, "doc_id", range(10, 13)))
    return drawn.selectExpr("doc_id", *_exchange(H))


_THINKING_SUM = lambda x: [*assemble.sum_columns(x, 77, "doc_id")]


@_r.query(f"WITH o AS (SELECT doc_id, {', '.join(assemble.operands(D, 71, 'doc_id'))} FROM documents) SELECT *, working AS plain FROM (SELECT doc_id, {', '.join(_THINKING_SUM(D))} FROM o)")
def thinking_sums(spark, d):
    """A sum turn: question, working, short answer, and the plain form, which is the working."""
    drawn = arith_operands(spark, d).selectExpr("*", *held(S, 77, "doc_id", [1, 2, 3, *range(10, 16)]))
    return drawn.selectExpr("doc_id", *_THINKING_SUM(H)).withColumn("plain", F.col("working"))


@_r.query(f"SELECT doc_id, {dialogue.fact_sentence(D, 81, 'doc_id')[0]} AS thing, {dialogue.fact_sentence(D, 81, 'doc_id')[1]} AS sentence FROM documents")
def fact_sentences(spark, d):
    thing, sentence = dialogue.fact_sentence(S, 81, "doc_id")
    return table(spark, d, "documents").selectExpr("doc_id", f"{thing} AS thing", f"{sentence} AS sentence")


@_r.query(f"SELECT doc_id, {dialogue.greeting(D, 83, 'doc_id')} AS line FROM documents")
def greetings(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{dialogue.greeting(S, 83, 'doc_id')} AS line")


@_r.query(f"WITH g AS (SELECT doc_id, {dialogue.greeting(D, 83, 'doc_id')} AS line FROM documents), s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT count(*)::BIGINT AS lines, count(DISTINCT line)::BIGINT AS different, round(count(DISTINCT line)::DOUBLE / count(*), 6) AS ratio FROM s WHERE before < 20000")
def greeting_corpus(spark, d):
    """Greetings up to 20,000 characters, how many there are and how many differ."""
    lines = greetings(spark, d)
    placed = corpus.prefix_sums(lines, [F.col("doc_id")], F.length("line") + 1, "before").where("before < 20000")
    return placed.agg(F.count("*").alias("lines"), F.count_distinct("line").alias("different"), F.round(F.count_distinct("line") / F.count("*"), 6).alias("ratio"))


@_r.query(f"SELECT doc_id, {dialogue.social_exchange(D, 87, 'doc_id')[0]} AS prompt, {dialogue.social_exchange(D, 87, 'doc_id')[1]} AS reply FROM documents")
def social_exchange(spark, d):
    prompt, reply = dialogue.social_exchange(S, 87, "doc_id")
    return table(spark, d, "documents").selectExpr("doc_id", f"{prompt} AS prompt", f"{reply} AS reply")


_ASKED = [f"{opening} {rest}" for opening in ("What is", "What are", "Why does", "How do", "Where is", "Tell me of") for rest in ("a rudder?", "the tall mast?", "boats made of??", "the tide at night?", "it")]


@_r.query(f"SELECT doc_id, {D.choice(91, 'doc_id', 9, _ASKED)} AS question, {dialogue.paraphrased(D, 91, 'doc_id', D.choice(91, 'doc_id', 9, _ASKED))} AS paraphrase FROM documents")
def question_paraphrase(spark, d):
    asked = table(spark, d, "documents").selectExpr("doc_id", f"{S.choice(91, 'doc_id', 9, _ASKED)} AS question")
    return asked.selectExpr("doc_id", "question", f"{dialogue.paraphrased(S, 91, 'doc_id', 'question')} AS paraphrase")


#: A user's whole turn on one line, of one key.
_USER_LINE = "conv_id * 1000 + turn AS k, conv_id, turn, replace(text, chr(10), ' ') AS body"


@_r.query(f"WITH b AS (SELECT {_USER_LINE} FROM conversations WHERE role = 'user') SELECT conv_id, turn, {dialogue.roughened(D, 93, 'k', 'body')} AS body FROM b")
def user_roughen(spark, d):
    """Every user's turn, whole, as people type."""
    b = table(spark, d, "conversations").where("role = 'user'").selectExpr(*_USER_LINE.split(", ", 3))
    return b.selectExpr("conv_id", "turn", f"{dialogue.roughened(S, 93, 'k', 'body')} AS body")


@_r.query(f"SELECT doc_id, {dialogue.lyrical(D, 89, 'doc_id')[0]} AS kind, {dialogue.lyrical(D, 89, 'doc_id')[1]} AS sentence FROM documents")
def lyrical_sentences(spark, d):
    kind, sentence = dialogue.lyrical(S, 89, "doc_id")
    return table(spark, d, "documents").selectExpr("doc_id", f"{kind} AS kind", f"{sentence} AS sentence")


_BEYOND = lambda x: dialogue.turn(x, 95, "doc_id", "cannot")[0]


@_r.query(f"WITH p(prompt, phrase) AS (VALUES {', '.join(f'({quoted(q)}, {quoted(a)})' for q, a in dialogue.BEYOND.items())}), q AS (SELECT doc_id, {_BEYOND(D)} AS prompt FROM documents) SELECT doc_id, prompt, phrase FROM q JOIN p USING (prompt)")
def phrase_lookup(spark, d):
    """What a question beyond reach is about, from the table of such questions."""
    known = spark.createDataFrame(list(dialogue.BEYOND.items()), "prompt string, phrase string")
    asked = table(spark, d, "documents").selectExpr("doc_id", f"{_BEYOND(S)} AS prompt")
    return asked.join(F.broadcast(known), "prompt").select("doc_id", "prompt", "phrase")  # a row for each question of the table


_KINDS = [*dialogue.KINDS, "social", "more"]


def _makers(x) -> str:
    part = lambda i: "CASE doc_id % 7 " + " ".join(f"WHEN {n} THEN {dialogue.turn(x, 95, 'doc_id', k)[i]}" for n, k in enumerate(_KINDS)) + " END"
    kind = "CASE doc_id % 7 " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(_KINDS)) + " END"
    return f"SELECT doc_id, {kind} AS kind, {part(0)} AS prompt, {part(1)} AS reply, {part(2)} AS thought FROM (SELECT doc_id, 1 AS i FROM {{docs}}) x"


@_r.query(_makers(D).replace("{docs}", "documents"))
def turn_makers(spark, d):
    """An exchange of each kind: known, unknown, clarify, chit, cannot, social, and one that follows a known one."""
    return assemble.over(table(spark, d, "documents").select("doc_id"), lambda name: _makers(S).replace("{docs}", name))


_UNCHANGED = ", ".join(map(quoted, inflect.PAIRED + inflect.UNCOUNTED))


@_r.query(f"SELECT DISTINCT w, CASE WHEN w IN ({_UNCHANGED}) THEN w WHEN right(w, 1) IN ('s', 'x', 'z') OR right(w, 2) IN ('ch', 'sh') THEN w || 'es' WHEN length(w) > 1 AND right(w, 1) = 'y' AND NOT contains('aeiou', left(right(w, 2), 1)) THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS plural, CASE WHEN contains('aeiou', left(w, 1)) THEN 'an' ELSE 'a' END AS article FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def plural_forms(spark, d):
    from turnloom.operators.quality import word_vocabulary

    w = F.col("w")
    return word_vocabulary(table(spark, d, "documents")).select("w", inflect.plural(w).alias("plural"), inflect.article(w).alias("article"))


_BASE = "CASE w WHEN 'is' THEN 'be' WHEN 'has' THEN 'have' ELSE CASE WHEN ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN ends_with(w, 'es') AND (right(w, 3) IN ('ses', 'xes', 'zes', 'oes') OR right(w, 4) IN ('ches', 'shes')) THEN left(w, length(w) - 2) WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END END"
_VOWELS = "length(b) - length(translate(b, 'aeiouy', ''))"
_GERUND = f"CASE WHEN ends_with(b, 'e') AND {_VOWELS} = 1 THEN b || 'ing' WHEN ends_with(b, 'e') AND length(b) > 1 AND NOT contains('eyo', left(right(b, 2), 1)) THEN left(b, length(b) - 1) || 'ing' WHEN {_VOWELS} = 1 AND length(b) >= 3 AND NOT contains('aeiouywx', right(b, 1)) AND contains('aeiou', left(right(b, 2), 1)) THEN b || right(b, 1) || 'ing' ELSE b || 'ing' END"


@_r.query(f"WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), b AS (SELECT w, {_BASE} AS b FROM v) SELECT w, b AS base, {_GERUND} AS gerund FROM b")
def gerund_forms(spark, d):
    from turnloom.operators.quality import word_vocabulary

    return word_vocabulary(table(spark, d, "documents")).select("w", inflect.base_form(F.col("w")).alias("base")).withColumn("gerund", inflect.gerund(F.col("base")))


_THINGS = sorted(dialogue.FACTS)
_QUESTION = f"'What is a ' || {D.pick(_THINGS, 'doc_id')} || ' to ' || {D.pick(_THINGS, 'doc_id * 7 + 3')} || '?'"


@_r.query(f"WITH q AS (SELECT doc_id, {_QUESTION} AS question FROM documents), f AS (SELECT unnest([{', '.join(map(quoted, _THINGS))}]) AS name, unnest(range({len(_THINGS)})) AS ord), m AS (SELECT doc_id, question, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, ord) AS r FROM q JOIN f ON contains(lower(question), name)) SELECT doc_id, question, name FROM m WHERE r = 1")
def longest_match(spark, d):
    """The longest known name in each question; of equally long ones the first."""
    question = _QUESTION.replace(D.pick(_THINGS, "doc_id"), S.pick(_THINGS, "doc_id")).replace(D.pick(_THINGS, "doc_id * 7 + 3"), S.pick(_THINGS, "doc_id * 7 + 3"))
    names = sorted(_THINGS, key=lambda n: (-len(n), _THINGS.index(n)))
    q = table(spark, d, "documents").selectExpr("doc_id", f"{question} AS question")
    found = F.coalesce(*[F.when(F.contains(F.lower("question"), F.lit(n)), n) for n in names])
    return q.select("doc_id", "question", found.alias("name")).where("name is not null")


@_r.query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark), k AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM w WHERE length(name) >= 3),
m AS (SELECT doc_id, name, ord FROM documents JOIN k ON contains(lower(text), name))
SELECT doc_id, arg_min(ord, (-length(name), ord))::BIGINT AS ord, arg_min(name, (-length(name), ord)) AS name, count(*)::BIGINT AS n_names FROM m GROUP BY doc_id""")
def names_in_documents(spark, d):
    """All words of the benchmark, of three letters at least, as names in whole documents: the longest that occurs, the first of equally long ones, and how many do."""
    from turnloom.operators.quality import word_vocabulary

    words = word_vocabulary(table(spark, d, "benchmark")).where(F.length("w") >= 3)
    names = corpus.prefix_sums(words, [F.col("w")], F.lit(1), "before").select((F.col("before") + 1).cast("long").alias("ord"), F.col("w").alias("name"))
    texts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return dictionary.named_in(texts, staged(names, "names"), "doc_id")


_GENERATED = assemble.conversation_ctes(D, "conversations", 97, 30)


@_r.query(f"WITH {_GENERATED} SELECT * FROM turns")
def generated_conversations(spark, d):
    """A generated conversation for every conversation of the fixture, three units in ten being sums."""
    return assemble.conversations(spark, table(spark, d, "conversations").select("conv_id"), 97, 30)


@_r.query(f"WITH {_GENERATED}, {assemble.forms_cte(D)} SELECT conv_id, thinking, plain, length(thinking)::INTEGER AS size FROM forms")
def thinking_forms(spark, d):
    """Generated conversations with their thinking and in plain form, both from the same draws; the first gives the size."""
    keys = table(spark, d, "conversations").select("conv_id")
    return assemble.over(keys, lambda name: f"WITH {assemble.conversation_ctes(S, name, 97, 30)}, {assemble.forms_cte(S)} SELECT conv_id, thinking, plain, length(thinking) AS size FROM forms")


_BLOCKS = "(SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place, role, replace(text, chr(10), ' ') AS body FROM conversations WHERE role <> 'system')"


_MIX = {"composed": 60, "think": 35, "math": 30, "thinking_on": True}


@_r.query(assemble.mixture_sql(D, _BLOCKS, 99, **_MIX))
def corpus_mixture(spark, d):
    """The conversations as written blocks, mixed with generated ones: framed anew, thinking, sums, talk."""
    turns = corpus.turns(table(spark, d, "conversations"))
    return assemble.mixture(corpus.blocks_of(turns), 99, **_MIX)


_SHARES = {"composed": 60, "think": 35, "math": 30, "thinking_on": False}
#: Hundredths of the written blocks' characters; a pass is about as long as they are.
_TARGETS = (30, 110, 230)
_PASSED = f"(SELECT conv_id || '/' || p AS conv_id, place, role, body FROM {_BLOCKS} b, (SELECT unnest(range(8)) AS p))"


@_r.query(f"""WITH t AS (SELECT sum(length(body) + 2) * unnest([{', '.join(map(str, _TARGETS))}]) // 100 AS target FROM {_BLOCKS} b),
m AS (SELECT *, split_part(conv_id, '/', 2)::BIGINT AS pass FROM ({assemble.mixture_sql(D, _PASSED, 105, **_SHARES)}) m),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY pass, {D.draw(105, 'conv_id', 0)}, conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT target::BIGINT AS target, pass, conv_id, branch, size, text FROM s JOIN t ON before < target""")
def corpus_fill(spark, d):
    """Corpora of three sizes from the same blocks: below one pass over them, and beyond one and two; thinking is measured, though its plain form is written."""
    blocks = corpus.blocks_of(corpus.turns(table(spark, d, "conversations")))
    n = blocks.agg(F.sum(F.length("body") + 2)).first()[0] or 0
    return assemble.fills(blocks, [n * t // 100 for t in _TARGETS], 105, **_SHARES)


@_r.query(f"WITH {dialogue.dialogue_ctes(D, 'conversations', 107)} SELECT * FROM lines")
def dialogue_turns(spark, d):
    """For every conversation of the table, a dialogue whose questions are about the thing last named."""
    keys = table(spark, d, "conversations").select("conv_id")
    return assemble.over(keys, lambda name: f"WITH {dialogue.dialogue_ctes(S, name, 107)} SELECT * FROM lines")
