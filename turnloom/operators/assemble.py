"""Whole generated conversations and corpora, stated once for Spark and DuckDB as common table expressions.

A conversation is laid out as units: a sum, or an exchange of one kind, a known one with up to three that follow it.
Units are drawn apart from each other by (conversation, unit), so no row waits for another; they are numbered in
order and cut at the conversation's length. Every turn has a thought, a reply, and the plain form that stands alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.arithmetic import OTHERS, Workings, other_problem
from turnloom.functions.dialect import SPARK, Dialect, Held, held
from turnloom.functions.draws import draw
from turnloom.functions.markers import BOT, END, START, THINK, USER
from turnloom.operators import dialogue
from turnloom.operators.corpus import prefix_sums
from turnloom.session import staged

FOLLOW_UPS = [38, 34, 20, 8]
WORDING = ["And {p}, what does that make?", "Please do {p}.", "A sum for you: {p}.", "I am stuck at {p}.", "Could you take on {p}?"]
TOTALS = ["So, {n}.", "It makes {n}.", "The end of it is {n}."]
SIGNS = "+-*/"
AGAIN, AGAIN_LEAD = ["Show it another way.", "Is there a second way?", "And by another road?"], ["Differently: ", "Or so: "]


def operands(d: Dialect, seed: int, key: str) -> list[str]:
    """op, l, r by weight: operations 35/30/25/10, sizes 20/40/40; draws 0 to 7."""
    draw, span = lambda i: d.draw(seed, key, i), lambda i, low, high: d.between(seed, key, i, low, high)
    op, size = d.weighted(seed, key, 0, [35, 30, 25, 10]), d.weighted(seed, key, 1, [20, 40, 40])
    low, high = f"(CASE {size} WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END)", f"(CASE {size} WHEN 0 THEN 9 WHEN 1 THEN 99 ELSE 999 END)"
    a, b, by = span(2, low, high), span(3, low, high), span(6, 2, 12)
    ordered = f"{draw(4)} % 100 < 85"
    factor = f"(CASE WHEN {draw(4)} % 100 < 70 THEN {span(5, 2, 12)} ELSE {span(5, 2, 25)} END)"
    exact = f"(CASE WHEN {draw(4)} % 100 < 70 THEN {by} * {span(7, 2, 30)} ELSE {a} END)"
    l = f"CASE {op} WHEN 1 THEN (CASE WHEN {ordered} THEN greatest({a}, {b}) ELSE {a} END) WHEN 3 THEN {exact} ELSE {a} END"  # noqa: E741
    r = f"CASE {op} WHEN 1 THEN (CASE WHEN {ordered} THEN least({a}, {b}) ELSE {b} END) WHEN 2 THEN {factor} WHEN 3 THEN {by} ELSE {b} END"
    return [f"cast({op} as int) AS op", f"cast({l} as bigint) AS l", f"cast({r} as bigint) AS r"]


def worded(d: Dialect, seed: int, key: str) -> str:
    """The question that asks for l op r (columns)."""
    sign = "(CASE op " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SIGNS)) + " END)"
    shown = f"(CASE WHEN {d.draw(seed, key, 10)} % 2 = 0 THEN {d.text('l')} || ' ' || {sign} || ' ' || {d.text('r')} ELSE {d.text('l')} || {sign} || {d.text('r')} END)"
    return f"replace({d.choice(seed, key, 12, WORDING)}, '{{p}}', {shown})"


def listed(d: Dialect) -> str:
    """In Spark, the workings of l op r that apply, as a column ``ways``: a plan that asks for them several times states them once."""
    return "CASE op " + " ".join(f"WHEN {i} THEN array_compact(array({', '.join(Workings(d).methods(op).values())}))" for i, op in enumerate(SIGNS)) + " END AS ways"


def working(d: Dialect, seed: int, key: str, further: int = 0, ways: str | None = None) -> str:
    """One of the workings of l op r that apply, or its plain result if none does; ``further`` counts on from the drawn one. ways: the column, if they are listed."""
    if ways:
        at = f"get({ways}, cast(({d.draw(seed, key, 11)} + {further}) % greatest(size({ways}), 1) as int))"
        signs = "CASE op " + " ".join(f"WHEN {i} THEN ' {s} '" for i, s in enumerate(SIGNS)) + " END"
        result = f"CASE op WHEN 0 THEN l + r WHEN 1 THEN l - r WHEN 2 THEN l * r ELSE {d.div('l', 'r')} END"
        return f"coalesce({at}, {d.text('l')} || {signs} || {d.text('r')} || ' = ' || {d.text(result)})"
    ways = [d.one_of(list(Workings(d).methods(op).values()), f"({d.draw(seed, key, 11)} + {further})") for op in SIGNS]
    results = ["l + r", "l - r", "l * r", d.div("l", "r")]
    plain = [f"{d.text('l')} || ' {s} ' || {d.text('r')} || ' = ' || {d.text(v)}" for s, v in zip(SIGNS, results)]
    return "CASE op " + " ".join(f"WHEN {i} THEN coalesce({w}, {p})" for i, (w, p) in enumerate(zip(ways, plain))) + " END"


def how_many(d: Dialect) -> str:
    """How many workings of l op r apply."""
    count = lambda op: " + ".join(f"(CASE WHEN ({w}) IS NULL THEN 0 ELSE 1 END)" for w in Workings(d).methods(op).values())
    return "CASE op " + " ".join(f"WHEN {i} THEN {count(op)}" for i, op in enumerate(SIGNS)) + " END"


def total(d: Dialect, seed: int, key: str) -> str:
    """The short answer to l op r, once the working is done."""
    short = lambda n: f"replace({d.choice(seed, key, 13, TOTALS)}, '{{n}}', {d.text(n)})"
    rest = f"CASE WHEN l % r = 0 THEN {short(d.div('l', 'r'))} ELSE {d.text(d.div('l', 'r'))} || ' and ' || {d.text('l % r')} || ' over.' END"
    return f"CASE op WHEN 0 THEN {short('(l + r)')} WHEN 1 THEN {short('(l - r)')} WHEN 2 THEN {short('(l * r)')} ELSE {rest} END"


def sum_columns(d: Dialect, seed: int, key: str, ways: str | None = None) -> list[str]:
    """question, working, answer of a sum turn over the columns op, l, r (and ways, if listed); three in ten are of another kind. Draws 1 to 3 and 10 to 15."""
    kinds = list(OTHERS)
    parts = {k: other_problem(d, k, seed, key) for k in kinds}
    other = lambda i: f"CASE {d.draw(seed, key, 15)} % {len(kinds)} " + " ".join(f"WHEN {n} THEN {parts[k][i]}" for n, k in enumerate(kinds)) + " END"
    plain = (worded(d, seed, key), working(d, seed, key, ways=ways), total(d, seed, key))
    return [f"CASE WHEN {d.draw(seed, key, 14)} % 10 < 3 THEN {other(i)} ELSE {plain[i]} END AS {name}" for i, name in enumerate(("question", "working", "answer"))]


def conversation_ctes(d: Dialect, keys: str, seed: int, sums: int) -> str:
    """CTEs; the last, ``turns``, has conv_id, exchange, prompt, thought, reply, plain. keys: a relation of conv_id;
    sums: the percentage of units that are sums."""
    unit, own, h = "(cast(conv_id as string) || ':' || cast(u as string))", "conv_id", Held(d)
    draw = lambda i: d.draw(seed, unit, i)
    kind = f"CASE WHEN {draw(40)} % 100 < {sums} THEN 'sum' ELSE {d.pick([k for k, w in dialogue.KINDS.items() for _ in range(w // 2)], draw(41))} END"
    edge = {"open": (42, 50, "greet", -1), "close": (43, 45, "bye", 99)}
    made = {k: dialogue.turn(h, seed, unit, k) for k in [*dialogue.KINDS, "more"]}
    pick = lambda i: "CASE WHEN i > 0 THEN " + made["more"][i] + " ".join(f" WHEN kind = '{k}' THEN {made[k][i]}" for k in dialogue.KINDS) + " END"
    ends = " UNION ALL ".join(
        f"SELECT conv_id, {at} AS u, 0 AS i, {d.choice(seed, own, counter + 10, dialogue.SOCIAL[pool][0])} AS prompt, {dialogue.quoted(dialogue.THOUGHTS['social'])} AS thought, {d.choice(seed, own, counter + 20, dialogue.SOCIAL[pool][1])} AS reply, cast(null as {'string' if d.spark else 'varchar'}) AS plain FROM keys WHERE {d.draw(seed, own, counter)} % 100 < {share}"
        for counter, share, pool, at in edge.values()
    )
    ways, given = ("ways", f"(SELECT *, {listed(h)} FROM given) w") if d.spark else (None, "given")
    units = "n - 1" if d.spark else "19"  # a unit is a row at least, so the others would be cut
    length = f"(2 + least({d.draw(seed, own, 44)} % 19, {d.draw(seed, own, 45)} % 19 + 3))"
    return f"""keys AS (SELECT DISTINCT conv_id FROM {keys}),
units AS (SELECT conv_id, n, u, {kind} AS kind, {d.weighted(seed, unit, 46, FOLLOW_UPS)} AS more FROM (SELECT conv_id, {length} AS n FROM keys) k {d.lateral(units, 'u')}),
laid AS (SELECT conv_id, n, u, kind, i FROM units {d.lateral("(CASE WHEN kind = 'known' THEN more ELSE 0 END)", 'i')}),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY u, i) AS place FROM laid) x WHERE place <= n),
drawn AS (SELECT conv_id, u, i, kind, {', '.join(held(d, seed, unit, range(21)))} FROM cut),
talk AS (SELECT conv_id, u, i, {pick(0)} AS prompt, {pick(2)} AS thought, {pick(1)} AS reply, cast(null as {'string' if d.spark else 'varchar'}) AS plain FROM drawn WHERE kind <> 'sum'),
given AS (SELECT *, {', '.join(operands(h, seed, unit))} FROM drawn WHERE kind = 'sum'),
summed AS (SELECT conv_id, u, i, {', '.join(sum_columns(h, seed, unit, ways))} FROM {given}),
said AS (SELECT * FROM talk UNION ALL SELECT conv_id, u, i, question, working, answer, working FROM summed UNION ALL {ends}),
turns AS (SELECT conv_id, cast(row_number() OVER (PARTITION BY conv_id ORDER BY u, i) - 1 as int) AS exchange, prompt, thought, reply, coalesce(plain, reply) AS plain FROM said)"""


def forms_cte(d: Dialect, name: str = "forms") -> str:
    """conv_id, thinking, plain: the conversation of ``turns`` in both forms, without the start marker's line."""
    ask = f"'{USER}' || prompt || '{END}\\n{BOT}'" if d.spark else f"'{USER}' || prompt || '{END}' || chr(10) || '{BOT}'"
    return f"{name} AS (SELECT conv_id, {d.lines('exchange', f'''{ask} || thought || '{THINK}' || reply || '{END}' ''')} AS thinking, {d.lines('exchange', f'''{ask} || plain || '{END}' ''')} AS plain FROM turns GROUP BY conv_id)"


def conversations(spark: SparkSession, keys: DataFrame, seed: int, sums: int = 30) -> DataFrame:
    """keys: (conv_id). conv_id, exchange, prompt, thought, reply, plain."""
    return over(keys, lambda name: f"WITH {conversation_ctes(SPARK, name, seed, sums)} SELECT * FROM turns")


def over(*args) -> DataFrame:
    """over(df, ..., query): the result of SQL text about DataFrames, which ``query`` is told the names of (its own braces rule out spark.sql's parameters).
    The names are gone afterwards."""
    *tables, query = args
    spark, names = tables[0].sparkSession, [f"turnloom_{uuid.uuid4().hex}" for _ in tables]
    for df, name in zip(tables, names):
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query(*names))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def branch_sql(d: Dialect, seed: int, composed: int, think: int, math: int) -> str:
    """What a mixture makes of the conversation conv_id: reframed, thinking, math or talk."""
    key = "conv_id"
    return f"CASE WHEN {d.draw(seed, key, 60)} % 100 >= {composed} THEN 'reframed' WHEN {d.draw(seed, key, 61)} % 100 < {think} THEN 'thinking' WHEN {d.draw(seed, key, 61)} % 100 < {think + math} THEN 'math' ELSE 'talk' END"


def mixture_sql(d: Dialect, blocks: str, seed: int, composed: int, think: int, math: int, thinking_on: bool, keys: str | None = None, turns: str | None = None) -> str:
    """A query of conv_id, branch, text, size: every block of ``blocks`` (conv_id, place, role, body) once, replaced by a
    generated conversation in ``composed`` of a hundred cases, else framed anew. Of the generated ones one draw gives
    ``think`` of a hundred to thinking, the next ``math`` to sums, the rest to talk. User lines are roughened. A thinking
    conversation counts with its thinking form, whichever is written. keys, turns: relations of the blocks' conv_id, each once, and of the generated
    conversations that are asked for, if they are made already (in Spark); what a conversation becomes is then told from its conv_id, without joins."""
    made = f"keys AS (SELECT * FROM {keys}), turns AS (SELECT * FROM {turns})" if turns else conversation_ctes(d, "blocks", seed + 3, 35)
    key, h = "conv_id", Held(d)
    role = branch_sql(d, seed, composed, think, math)
    line_key = "(cast(conv_id as string) || ':' || cast(place as string))"
    rough = dialogue.roughened(d, seed + 1, line_key, "body")
    newline = "'\\n'" if d.spark else "chr(10)"
    social = lambda at, counter: f"SELECT conv_id, {at} + s AS place, CASE WHEN s = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN s = 0 THEN {dialogue.social_exchange(d, seed + 2, f'(cast(conv_id as string) || {dialogue.quoted(str(at))})')[0]} ELSE {dialogue.social_exchange(d, seed + 2, f'(cast(conv_id as string) || {dialogue.quoted(str(at))})')[1]} END AS body, branch{unformed} FROM branches {d.lateral('1', 's')} WHERE branch = 'reframed' AND {d.draw(seed, key, counter)} % 100 < 18"
    bot = f"CASE WHEN branch = 'thinking' THEN thought || '{THINK}' || reply ELSE plain END" if thinking_on else "plain"
    if turns:
        form = f"CASE WHEN s = 0 AND branch = 'thinking' THEN length('{USER}' || prompt || '{END}\\n{BOT}' || thought || '{THINK}' || reply || '{END}') END"
        reframed, unformed = f"{role} = 'reframed'", ", cast(null as int) AS form"
        exchanges = f"SELECT conv_id, 2 * exchange + s AS place, CASE WHEN s = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN s = 0 THEN prompt ELSE {bot} END AS body, branch, {form} AS form FROM (SELECT *, {role} AS branch FROM turns) t {d.lateral('1', 's')}"
        ways, several, given = "ways", "size(ways)", f"(SELECT *, {listed(h)} FROM sums_given) w"
        # Forms are joined by newlines.
        sizes, size = ", sum(form) + count(form) - 1 AS form", "form"
        forms, joined = "", "chunk c"
    else:
        reframed, unformed = "conv_id IN (SELECT conv_id FROM branches WHERE branch = 'reframed')", ""
        exchanges = f"SELECT t.conv_id, 2 * exchange + s AS place, CASE WHEN s = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN s = 0 THEN prompt ELSE {bot} END AS body, branch FROM turns t JOIN branches b ON b.conv_id = t.conv_id {d.lateral('1', 's')} WHERE branch IN ('thinking', 'talk')"
        ways, several, given = None, how_many(h), "sums_given"
        sizes, size = "", "length(thinking)"
        forms, joined = f",\n{forms_cte(d)}", "chunk c LEFT JOIN forms f ON f.conv_id = c.conv_id"
    return f"""WITH blocks AS (SELECT * FROM {blocks}), {made},
branches AS (SELECT conv_id, {role} AS branch FROM keys),
sums_drawn AS (SELECT conv_id, u, {', '.join(held(d, seed + 4, "(cast(conv_id as string) || ':m' || cast(u as string))", [*range(14), 63, 64, 65]))} FROM (SELECT conv_id, {d.weighted(seed, key, 62, [60, 30, 10])} AS more FROM branches WHERE branch = 'math') m {d.lateral('more', 'u')}),
sums_given AS (SELECT *, {', '.join(operands(h, 0, ''))} FROM sums_drawn),
worked AS (SELECT conv_id, u, {worded(h, 0, '')} AS question, {working(h, 0, '', ways=ways)} AS working, CASE WHEN {several} > 1 AND d63 % 100 < 35 THEN {h.choice(0, '', 64, AGAIN)} END AS again, {h.choice(0, '', 65, AGAIN_LEAD)} || {working(h, 0, '', 1, ways)} AS other_way FROM {given}),
math_lines AS (SELECT conv_id, 4 * u + s AS place, CASE WHEN s % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE s WHEN 0 THEN question WHEN 1 THEN working WHEN 2 THEN again ELSE other_way END AS body, 'math' AS branch{unformed} FROM worked {d.lateral('(CASE WHEN again IS NULL THEN 1 ELSE 3 END)', 's')}),
framed AS (SELECT conv_id, place, role, {dialogue.reframed_line(d, seed + 6, 'conv_id', 'place', 'role', 'body')} AS body, 'reframed' AS branch{unformed} FROM blocks WHERE {reframed}),
every AS (SELECT * FROM framed UNION ALL SELECT * FROM math_lines UNION ALL {social(-2, 66)} UNION ALL {social(1000000, 67)} UNION ALL {exchanges}),
rough AS (SELECT conv_id, place, branch{', form' if turns else ''}, CASE WHEN role = 'user' THEN '{USER}' || {rough} ELSE '{BOT}' || body END || '{END}' AS line FROM every),
chunk AS (SELECT conv_id, branch, '{START}' || {newline} || {d.lines('place', 'line')} AS text{sizes} FROM rough GROUP BY conv_id, branch){forms}
SELECT c.conv_id, branch, text, cast(greatest(length(text), CASE WHEN branch = 'thinking' THEN {size} + 2 ELSE 0 END) + 1 as bigint) AS size FROM {joined}"""


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many partitions as shuffles have, or the cluster cores: short rows that long ones are made of would else be gathered in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def mixture(blocks: DataFrame, seed: int, keys: DataFrame | None = None, **shares: int) -> DataFrame:
    """mixture_sql on the blocks (keys: their conv_id, each once). Of the conversations only those are generated that it asks for; they are stored first, to
    be dealt out anew with the rest."""
    keys = dealt(blocks.select("conv_id").distinct() if keys is None else keys, "conv_id")
    role = branch_sql(SPARK, seed, **{k: v for k, v in shares.items() if k != "thinking_on"})
    turns = staged(conversations(blocks.sparkSession, keys.where(f"conv_id IS NOT NULL AND {role} IN ('thinking', 'talk')"), seed + 3, 35), "turns")
    return over(keys, turns, blocks, lambda k, t, b: mixture_sql(SPARK, b, seed, **shares, keys=k, turns=t))


def _passed(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """The blocks, or their keys, once for every pass from ``first`` to ``last``, under names of their own: conv_id/pass."""
    step = 4096  # two steps, so that no row holds a list of all passes
    begun = blocks.withColumn("__from", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    each = begun.withColumn("pass", F.explode(F.sequence("__from", F.least(F.col("__from") + step - 1, F.lit(last)))))
    return each.select(pass_key(F.col("conv_id"), F.col("pass")).alias("conv_id"), *[c for c in blocks.columns if c != "conv_id"])


def pass_key(conv_id: Column, number: Column) -> Column:
    return F.concat(conv_id.cast("string"), F.lit("/"), number.cast("string"))


def pass_of(key: str = "conv_id") -> Column:
    return F.substring_index(key, "/", -1).cast("long")


def fills(blocks: DataFrame, targets: list[int], seed: int, **shares: int) -> DataFrame:
    """Corpora of the target sizes: target, pass, conv_id, branch, size, text; in the order of pass, then draw(seed, conv_id), then conv_id.

    The blocks are mixed again and again (mixture_sql, with ``shares``), each pass in an order and with draws of its own, until a target is reached; the
    conversation that crosses it is kept, whole. As many passes as the mean so far asks for are made and stored, each text once for all targets. Totals of
    passes, a running sum over them, and running sums inside the passes that a target ends in tell each target's last conversation; the stored texts are
    then read up to it, without a join. No row waits for another: a pass' conversations depend on their names alone. Without blocks, or for targets of 0,
    there is nothing.
    """
    most, reached, passes, made = max(targets, default=0), 0, 0, None
    if most > 0:
        blocks = staged(dealt(blocks.select("conv_id", "place", "role", "body")), "blocks")
        keys = staged(dealt(blocks.select("conv_id").distinct(), "conv_id"), "keys")
    while reached < most:
        more = 1 if not passes else -(-(most - reached) * passes * 21 // (20 * reached))  # a twentieth more than the mean asks for
        span = passes, passes + more - 1
        new = mixture(_passed(blocks, *span), seed, _passed(keys, *span), **shares)
        new = staged(new.select("conv_id", "branch", "size", "text", pass_of().alias("pass"), draw(seed, F.col("conv_id"), 0).alias("__draw")), "texts")
        got = new.agg(F.sum("size")).first()[0]
        if not got:
            break
        made, reached, passes = new if made is None else made.union(new), reached + got, passes + more
    if made is None:
        return blocks.sparkSession.createDataFrame([], "target long, pass long, conv_id string, branch string, size long, text string")
    summed = staged(prefix_sums(made.groupBy("pass").agg(F.sum("size").alias("total")), [F.col("pass")], F.col("total"), "before"), "passes")
    ends = [(t, *summed.where(F.col("before") < t).orderBy(F.desc("pass")).select("pass", "before").first()) for t in targets if t > 0]
    ended = made.where(F.col("pass").isin(sorted({e[1] for e in ends}))).select("pass", "__draw", "conv_id", "size")
    # Running sums go over all passes that a target ends in; what the earlier ones of them hold is taken off again.
    totals = ended.groupBy("pass").agg(F.sum("size").alias("n")).collect()  # a row a target at most
    inside = prefix_sums(ended, [F.col("pass"), F.col("__draw"), F.col("conv_id")], F.col("size"), "inside")
    room = [(F.col("pass") == at) & (F.col("inside") < t - before + sum(x["n"] for x in totals if x["pass"] < at)) for t, at, before in ends]
    lasts = inside.agg(*[F.max(F.when(fits, F.struct("__draw", "conv_id"))).alias(f"last{i}") for i, fits in enumerate(room)]).first()
    upto = [(F.col("pass") < at) | ((F.col("pass") == at) & ((F.col("__draw") < last[0]) | ((F.col("__draw") == last[0]) & (F.col("conv_id") <= last[1])))) for (_, at, _), last in zip(ends, lasts)]
    kept = F.array(*[F.struct(F.lit(t).cast("long").alias("target"), fits.alias("kept")) for (t, _, _), fits in zip(ends, upto)])
    return made.select("pass", "conv_id", "branch", "size", "text", F.explode(F.filter(kept, lambda x: x["kept"])).alias("k")).select("k.target", "pass", "conv_id", "branch", "size", "text")
