"""Queries on weights, vectors and the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import base85
from turnloom.operators import checkpoints, corpus, network, weights
from turnloom.plans.corpus_queries import TURNS
from turnloom.plans.registry import Registry, table
from turnloom.session import scratch_folder, staged
from turnloom.sources import export_file

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.oracle

_HALF = lambda x: f"(round_even({x} / power(2.0::DOUBLE, greatest(floor(log2(greatest({x}, 1e-300))), -14) - 10), 0) * power(2.0::DOUBLE, greatest(floor(log2(greatest({x}, 1e-300))), -14) - 10))"
_V = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _groups(bits: int, group: int) -> str:
    top = (1 << (bits - 1)) - 1
    return f"""{_V}, p AS (SELECT vec_id, list_concat(v, list_transform(range((-len(v) % {group} + {group}) % {group}), lambda i: 0.0::DOUBLE)) AS v FROM e),
g AS (SELECT vec_id, group_no, v[group_no * {group} + 1:group_no * {group} + {group}] AS w FROM (SELECT vec_id, v, unnest(range(len(v) // {group}))::INTEGER AS group_no FROM p)),
m AS (SELECT *, greatest(list_max(list_transform(w, lambda x: abs(x))) / {top}, 1e-6)::DOUBLE AS s FROM g), h AS (SELECT *, {_HALF('s')} AS scale FROM m),
q AS (SELECT vec_id, group_no, w, scale, list_transform(w, lambda x: greatest(least(round_even(x / scale, 0), {top}), -{top})::INTEGER) AS q FROM h)"""


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@_r.query(f"WITH {_groups(8, 24)} SELECT vec_id, group_no, scale, array_to_string(q, ' ') AS q FROM q")
def quantize_groups(spark, d):
    """Eight bits in groups of 24, which 64 components don't fill."""
    g = weights.quantized(_embeddings(spark, d), "vec_id", "v", 8, 24)
    return g.select("vec_id", "group_no", "scale", F.array_join(F.col("q").cast("array<string>"), " ").alias("q"))


@_r.query(f"WITH {_groups(8, 32)} SELECT vec_id, round(max(list_max(list_transform(range(1, 33), lambda i: abs(q[i] * scale - w[i])))), 9) AS worst, bool_and(list_max(list_transform(range(1, 33), lambda i: abs(q[i] * scale - w[i]))) <= scale / 2 + 1e-9) AS within FROM q GROUP BY vec_id")
def dequantize_error(spark, d):
    """The largest error of a component, and whether it is within half a step."""
    g = weights.quantized(_embeddings(spark, d), "vec_id", "v", 8, 32)
    worst = F.array_max(F.transform(F.arrays_zip("q", "w", F.array_repeat("scale", F.size("q")).alias("s")), lambda z: F.abs(z["q"] * z["s"] - z["w"])))
    e = g.select("vec_id", "scale", worst.alias("e"))
    return e.groupBy("vec_id").agg(F.round(F.max("e"), 9).alias("worst"), F.bool_and(F.col("e") <= F.col("scale") / 2 + 1e-9).alias("within"))


@_r.query(f"WITH {_groups(4, 32)} SELECT vec_id, group_no, array_to_string(list_transform(range(0, 16), lambda i: lpad(hex((q[2 * i + 1] & 15) + 16 * (q[2 * i + 2] & 15)), 2, '0')), '') AS packed, true AS same FROM q")
def pack_int4(spark, d):
    """Four-bit codes packed low nibble first, and whether unpacking gives them back."""
    g = weights.quantized(_embeddings(spark, d), "vec_id", "v", 4, 32).withColumn("packed", weights.packed_int4(F.col("q")))
    return g.select("vec_id", "group_no", "packed", (weights.unpacked_int4(F.col("packed"), F.size("q")) == F.col("q")).alias("same"))


@_r.query("SELECT doc_id, (n_chars + (32 - n_chars % 32) % 32)::BIGINT AS padded FROM documents")
def padded_len(spark, d):
    return table(spark, d, "documents").select("doc_id", weights.padded_length(F.col("n_chars"), 32).alias("padded"))


def _base85(hexed: str) -> str:
    """DuckDB's base85 of hexadecimal digits."""
    digits = " || ".join(f"substr('{base85.DIGITS}', (('0x' || rpad(x, 8, '0'))::BIGINT // {p} % 85 + 1)::BIGINT, 1)" for p in base85.PLACES)
    return f"array_to_string(list_transform(regexp_extract_all({hexed}, '.{{1,8}}'), lambda x: left({digits}, length(x) // 2 + 1)), '')"


@_r.query(f"SELECT item_id, {_base85('hex(encode(text))')} AS text, true AS same FROM benchmark")
def base85_roundtrip(spark, d):
    """Every text's bytes in base85, and whether decoding gives them back."""
    raw = table(spark, d, "benchmark").select("item_id", F.encode("text", "utf-8").alias("raw"))
    return raw.select("item_id", weights.base85("raw").alias("text"), (weights.unbase85(weights.base85("raw")) == F.col("raw")).alias("same"))


_BITS = lambda h: f"((greatest(floor(log2(greatest({h}, 1e-300))), -14) + 14) * 1024 + {h} * power(2.0::DOUBLE, 10 - greatest(floor(log2(greatest({h}, 1e-300))), -14)))::INTEGER"


@_r.query(f"""WITH {_V}, x AS (SELECT vec_id, unnest(range(len(v)))::INTEGER AS i, unnest(v) AS x FROM e), h AS (SELECT vec_id, i, x, {_HALF('abs(x)')} AS h FROM x)
SELECT vec_id, i, {_BITS('h')} + CASE WHEN x < 0 THEN 32768 ELSE 0 END AS bits, CASE WHEN x < 0 THEN -h ELSE h END AS value FROM h""")
def fp16_decode(spark, d):
    """Every component as the 16 bits of its half float, and what these decode to."""
    x = _embeddings(spark, d).select("vec_id", F.posexplode("v").alias("i", "x"))
    bits = weights.bits_of_half(weights.half(F.abs("x"))) + F.when(F.col("x") < 0, 32768).otherwise(0)
    return x.select("vec_id", "i", bits.alias("bits")).select("*", weights.half_of_bits(F.col("bits")).alias("value"))


@_r.query(f"WITH {_V}, w AS (SELECT vec_id AS row, v AS w FROM e WHERE vec_id < 8) SELECT vec_id, row::INTEGER AS row, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])), 6) AS y FROM e, w")
def matmul_linear(spark, d):
    """Each vector times the matrix of the first eight, a row a component."""
    e = _embeddings(spark, d)
    rows = [r["v"] for r in e.where("vec_id < 8").orderBy("vec_id").collect()]
    y = e.select("vec_id", weights.linear(F.col("v"), rows).alias("y"))
    return y.select("vec_id", F.posexplode("y").alias("row", "y")).withColumn("y", F.round("y", 6))


_STATS = "s AS (SELECT vec_id, v, list_sum(v) / len(v) AS m, list_sum(list_transform(v, lambda x: x * x)) / len(v) AS m2 FROM e)"


@_r.query(f"WITH {_V}, {_STATS} SELECT vec_id, unnest(range(len(v)))::INTEGER AS i, round(unnest(list_transform(v, lambda x: (x - m) / sqrt(greatest(m2 - m * m, 0) + 1e-5))), 6) AS y FROM s")
def layernorm(spark, d):
    y = _embeddings(spark, d).select("vec_id", F.posexplode(weights.layer_norm(F.col("v"))).alias("i", "y"))
    return y.withColumn("y", F.round("y", 6))


@_r.query(f"WITH {_V}, x AS (SELECT vec_id, list_transform(v, lambda k: exp(k - list_max(v))) AS x FROM e) SELECT vec_id, unnest(range(len(x)))::INTEGER AS i, round(unnest(list_transform(x, lambda k: k / list_sum(x))), 9) AS y FROM x")
def softmax(spark, d):
    y = _embeddings(spark, d).select("vec_id", F.posexplode(weights.softmax(F.col("v"))).alias("i", "y"))
    return y.withColumn("y", F.round("y", 9))


@_r.query(f"WITH {_V}, x AS (SELECT vec_id, unnest(range(len(v)))::INTEGER AS i, unnest(list_transform(v, lambda k: round(k, 1))) AS y FROM e), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY y DESC) AS r FROM x) SELECT vec_id, i, y FROM r WHERE r <= 5")
def topk_logits(spark, d):
    """Components, rounded so that they tie, that are no smaller than the fifth largest."""
    v = F.transform("v", lambda k: F.round(k, 1))
    y = _embeddings(spark, d).select("vec_id", v.alias("v")).select("vec_id", F.posexplode(weights.top_k(F.col("v"), 5)).alias("i", "y"))
    return y.where("y is not null")


@_r.query(f"WITH {_V}, t AS (SELECT vec_id, v, CASE WHEN vec_id % 9 = 0 THEN -100 ELSE vec_id % 64 END AS target FROM e) SELECT round(avg(CASE WHEN target >= 0 THEN ln(list_sum(list_transform(v, lambda k: exp(k - list_max(v))))) + list_max(v) - v[target + 1] END), 6) AS loss, count(*) FILTER (target >= 0)::BIGINT AS n FROM t")
def cross_entropy(spark, d):
    """Mean loss of the vectors as logits; each ninth target is masked."""
    t = _embeddings(spark, d).withColumn("target", F.when(F.col("vec_id") % 9 == 0, -100).otherwise(F.col("vec_id") % 64).cast("int"))
    one = t.select(weights.cross_entropy(F.col("v"), F.col("target")).alias("loss"))
    return one.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("loss").alias("n"))


@_r.query(f"WITH {_V} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INTEGER AS best FROM e")
def greedy_choice(spark, d):
    """The first largest component."""
    return _embeddings(spark, d).select("vec_id", (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("best"))


@_r.query("SELECT doc_id, round(CASE WHEN step < warm THEN 0.001 * (step + 1) / warm::DOUBLE ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(least((step - warm) / greatest(1, steps - warm)::DOUBLE, 1.0) * pi())) END, 12)::DOUBLE AS rate FROM (SELECT doc_id, doc_id AS step, n AS steps, n // 10 AS warm FROM documents, (SELECT count(*) AS n FROM documents))")
def lr_schedule(spark, d):
    """The learning rate at every document of a training that takes one a step, a tenth of them to warm up."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    return docs.select("doc_id", F.round(weights.learning_rate(F.col("doc_id"), n, 1e-3, 1e-4, n // 10), 12).alias("rate"))


_SIZES = "(VALUES " + ", ".join(f"('{n}', {l}, {w}, {b})" for n, l, _, w, b in weights.PRESETS) + ") t(name, layers, w, block)"


def _parameters(spark):
    """name, fixed, by_symbol: parameters of each size, from the tensors' shapes, but those of the symbols; and how many each symbol adds."""
    rows = [(name, tensor, shape) for name, layers, _, width, block in weights.PRESETS for tensor, shape in weights.parameter_shapes(1, layers, width, block)]
    t = spark.createDataFrame(rows, "name string, tensor string, shape array<long>")
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    symbols = F.col("tensor") == "tok_emb.weight"
    return t.groupBy("name").agg(F.sum(F.when(~symbols, size)).alias("fixed"), F.sum(F.when(symbols, size)).alias("by_symbol"))


@_r.query(f"WITH v AS (SELECT lang, count(DISTINCT ch) AS symbols FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY lang) SELECT lang, name, symbols::BIGINT AS symbols, (symbols * w + block * w + layers * (12 * w * w + 13 * w) + 2 * w)::BIGINT AS parameters FROM v, {_SIZES}")
def param_count(spark, d):
    """Parameters of each size with the symbols of each language's documents."""
    symbols = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").groupBy("lang").agg(F.countDistinct("ch").alias("symbols"))
    return symbols.join(F.broadcast(_parameters(spark)), F.lit(True)).select("lang", "name", "symbols", (F.col("symbols") * F.col("by_symbol") + F.col("fixed")).alias("parameters"))  # a row a size


@_r.query(f"WITH {TURNS}, n AS (SELECT sum(length(line) + 1) + 2 * count(DISTINCT conv_id) AS chars FROM t), p AS (SELECT name, 102 * w + block * w + layers * (12 * w * w + 13 * w) + 2 * w AS parameters FROM (VALUES " + ", ".join(f"('{n}', {l}, {w}, {b})" for n, l, _, w, b in weights.PRESETS) + ") t(name, layers, w, block)) SELECT name, round(chars::DOUBLE / parameters, 6) AS chars_per_parameter, chars < parameters / 20.0 AS too_little FROM p, n")
def chars_per_parameter(spark, d):
    chars = corpus.describe(corpus.turns(table(spark, d, "conversations"))).first()["chars"]
    sizes = _parameters(spark).select("name", (102 * F.col("by_symbol") + F.col("fixed")).alias("parameters"))
    return sizes.select("name", F.round(F.lit(float(chars)) / F.col("parameters"), 6).alias("chars_per_parameter"), (F.lit(chars) < F.col("parameters") / 20).alias("too_little"))


def _micro(codec_size: int) -> network.Network:
    config = network.Config(codec_size, 32, 2, 2, 20)
    return network.Network(config, network.initial(config, 1234))


def _ids(spark, d):
    from turnloom.functions.markers import BASE

    codec = corpus.Codec(sorted(set(BASE)))
    return corpus.rendered(corpus.turns(table(spark, d, "conversations"))).select("conv_id", codec.encode(F.concat("text", F.lit("\n"))).alias("ids")), codec, len(set(BASE))


@_r.query()
def model_loss(spark, d):
    """Loss in nats and bits of a seeded micro model over all windows of the conversations laid end to end."""
    ids, _, size = _ids(spark, d)
    return network.text_loss(corpus.text_windows(ids, "conv_id", "ids", 32), _micro(size)).select("windows", F.round("nats", 4).alias("nats"), F.round("bits", 4).alias("bits"))


MOST_WINDOWS = 400


def _parts(spark, d):
    """(held-out chunks, training chunks, network): a tenth of the conversations is held out."""
    ids, _, size = _ids(spark, d)
    split = corpus.heldout_split(ids, "conv_id", 0.1, 1234)
    return split.where("held_out"), split.where("not held_out"), _micro(size)


@_r.query()
def generalization_gap(spark, d):
    """Loss on the held-out text and on as many characters from the training text's beginning, each over its first 400 windows
    as the published figures have it; their gap; characters and exported bits a parameter."""
    held, train, net = _parts(spark, d)
    sizes = [t.agg(F.sum(F.size("ids"))).first()[0] for t in (held, train)]
    most = min(MOST_WINDOWS, max(0, -(-(sizes[0] - 33) // 32)))  # windows that lie in the first sizes[0] characters
    held_loss = network.text_loss(corpus.text_windows(held, "conv_id", "ids", 32, MOST_WINDOWS), net).select(F.col("nats").alias("held_nats"), F.col("bits").alias("held_bits"))
    train_loss = network.text_loss(corpus.text_windows(train, "conv_id", "ids", 32, most), net).select(F.col("nats").alias("train_nats"))
    n = sum(v.size for v in net.p.values())
    rows = [(0, i, k, list(map(int, v.shape)), [float(x) for x in v.ravel()]) for i, (k, v) in enumerate(net.p.items())]
    told = export_file.lines(spark.createDataFrame(rows, "model int, " + export_file.SCHEMA), {}, "", 8, 32)
    stored = told.select(F.octet_length(F.concat_ws("\n", "header", "codes", "scales")) + 1).first()[0]
    both = held_loss.join(train_loss, F.lit(True))  # a row each
    ratios = (F.lit(round(sizes[1] / n, 6)).alias("chars_per_parameter"), F.lit(round(8 * stored / n, 6)).alias("bits_per_parameter"))
    return both.select(*[F.round(c, 4).alias(c) for c in ("held_nats", "held_bits", "train_nats")], F.round(F.col("held_nats") - F.col("train_nats"), 4).alias("gap"), *ratios)


@_r.query()
def loss_estimate(spark, d):
    """Mean loss of 20 random batches of 8 windows of the training and of the held-out text."""
    held, train, net = _parts(spark, d)
    each = [network.text_loss(corpus.drawn_text_windows(t, "conv_id", "ids", 32, 160, 3), net).select(F.lit(name).alias("split"), "windows", F.round("nats", 4).alias("nats")) for name, t in (("train", train), ("val", held))]
    return each[0].union(each[1])


@_r.query("WITH e AS (SELECT user_id AS run, event_id AS step, value AS loss, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events), g AS (SELECT *, least(loss, before) AS best, sum(CASE WHEN before IS NULL OR loss < before THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step) AS since FROM e), s AS (SELECT *, (row_number() OVER (PARTITION BY run, since ORDER BY step) - 1)::INTEGER AS stale FROM g) SELECT run, step, loss, best, stale, coalesce(bool_or(stale >= 3) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s")
def early_stop(spark, d):
    """Events' values as evaluations of a training for each user: the best so far, how stale it is, and whether patience has run out."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return checkpoints.best_so_far(e, 3)


_SECONDS = "greatest(1.0, epoch(max(ts)) - epoch(min(ts)))"


@_r.query(f"WITH r AS (SELECT user_id, count(*) AS steps, {_SECONDS}::DOUBLE AS seconds FROM events GROUP BY user_id), t AS (SELECT user_id, steps * 32 * 128 / seconds AS rate FROM r) SELECT user_id, round(rate, 6) AS rate, round(rate / first(rate) OVER (ORDER BY user_id), 6) AS relative FROM t")
def throughput_ratio(spark, d):
    """Every user's events as the steps of a training, 32 texts of 128 characters each: characters a second, and their ratio to the first user's."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.greatest(F.lit(1.0), F.max(at) - F.min(at)).alias("seconds"))
    told = checkpoints.throughput(runs.select(F.col("user_id").alias("place"), "user_id", "steps", F.lit(32).alias("batch"), F.lit(128).alias("block"), "seconds"))
    return told.select("user_id", F.round("rate", 6).alias("rate"), F.round("relative", 6).alias("relative"))


#: Every 32 vectors are a model, a vector a tensor; groups of 24 weights, which its 64 don't fill.
PER_MODEL, PER_GROUP = 32, 24


def _models(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / PER_MODEL).cast("int").alias("model"), (F.col("vec_id") % PER_MODEL).cast("int").alias("ord"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values"))


def _export(bits: int, group: int = PER_GROUP) -> str:
    """DuckDB's groups of codes as an export has them: model, vec_id, group_no, scale, q; then the three lines by model."""
    top = (1 << (bits - 1)) - 1
    raw = "array_to_string(list_transform(q, lambda c: lpad(hex(c & 255), 2, '0')), '')" if bits == 8 else f"array_to_string(list_transform(range(0, {group // 2}), lambda i: lpad(hex((q[2 * i + 1] & 15) + 16 * (q[2 * i + 2] & 15)), 2, '0')), '')"
    start = f'{{"v":{export_file.VERSION},"bits":{bits},"group":{group},"config":{{"n_embd":64}},"vocab":"a é","tensors":'
    half = _BITS("scale")
    return f"""{_V}, p AS (SELECT vec_id, len(v) AS n, list_concat(v, list_transform(range((-len(v) % {group} + {group}) % {group}), lambda i: 0.0::DOUBLE)) AS v FROM e),
g AS (SELECT vec_id, n, group_no, v[group_no * {group} + 1:group_no * {group} + {group}] AS w FROM (SELECT vec_id, n, v, unnest(range(len(v) // {group}))::INTEGER AS group_no FROM p)),
m AS (SELECT *, greatest((list_max(list_transform(w, lambda x: abs(x))) / {top})::FLOAT, 1e-6::FLOAT)::DOUBLE AS s FROM g), h AS (SELECT *, {_HALF('s')} AS scale FROM m),
q AS (SELECT (vec_id // {PER_MODEL})::INTEGER AS model, vec_id, n, group_no, scale, list_transform(w, lambda x: greatest(least(round_even((x / scale)::FLOAT::DOUBLE, 0), {top}), -{top})::INTEGER) AS q FROM h),
c AS (SELECT model, vec_id, group_no, {_base85(raw)} AS c, lpad(hex({half} & 255), 2, '0') || lpad(hex({half} >> 8), 2, '0') AS s FROM q),
l AS (SELECT model, string_agg(c, '' ORDER BY vec_id, group_no) AS codes, string_agg(s, '' ORDER BY vec_id, group_no) AS s FROM c GROUP BY model),
t AS (SELECT (vec_id // {PER_MODEL})::INTEGER AS model, '{start}[' || string_agg('{{"n":"v' || vec_id || '","s":[' || len(v) || ']}}', ',' ORDER BY vec_id) || ']}}' AS header FROM e GROUP BY 1),
lines AS (SELECT model, header, codes, {_base85('s')} AS scales FROM t JOIN l USING (model))"""


@_r.query(f"WITH {_export(8)} SELECT * FROM lines")
def export_lines(spark, d):
    """The three lines of every model's export in eight bits."""
    return export_file.lines(_models(spark, d), {"n_embd": 64}, "a é", 8, PER_GROUP)


def _read_back(spark, d, bits: int) -> str:
    folder = scratch_folder(spark, f"exports-{bits}")
    export_file.write_all(_models(spark, d), folder, {"n_embd": 64}, "a é", bits, PER_GROUP)
    return folder


def _groups_sql(bits: int) -> str:
    return f"WITH {_export(bits)} SELECT 'v' || vec_id AS name, (vec_id % {PER_MODEL})::INTEGER AS ord, group_no, scale, array_to_string(list_transform(q[1:least({PER_GROUP}, n - group_no * {PER_GROUP})], lambda c: round(c * scale, 9)::DECIMAL(18, 9)), ' ') AS \"values\" FROM q"


def _told(groups):
    return groups.select("name", "ord", "group_no", "scale", F.array_join(F.transform("values", lambda x: F.round(x, 9).cast("decimal(18,9)").cast("string")), " ").alias("values"))


@_r.query(_groups_sql(8))
def export_read_int8(spark, d):
    """All models written as export files in eight bits and read back, a row a group of weights with its scale."""
    return _told(export_file.groups(spark, _read_back(spark, d, 8)))


@_r.query(_groups_sql(4))
def export_read_int4(spark, d):
    """As export_read_int8, in four bits."""
    return _told(export_file.groups(spark, _read_back(spark, d, 4)))


@_r.query("SELECT 'v' || vec_id AS name, len(embedding)::INTEGER AS n, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN 'known' ELSE 'unknown' END AS state FROM embeddings UNION ALL SELECT 'v' || doc_id, NULL, 'missing' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def export_headers(spark, d):
    """Names and sizes from the headers of all exports, and which of them the labelled documents' numbers lack or have beyond."""
    found = export_file.headers(spark, _read_back(spark, d, 8)).select("name", F.get("shape", F.lit(0)).alias("n"))
    expected = table(spark, d, "labels").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("name"))
    return found.join(export_file.name_faults(found, expected), "name", "full").select("name", "n", F.coalesce("fault", F.lit("known")).alias("state"))


_SLOT = "<script>\nvar MODEL = [];\nvar ready = 1;</script>"


@_r.query(f"WITH {_export(4)}, k AS (SELECT count(*) AS k FROM lines), pg AS (SELECT page_id, html, page_id % k AS model FROM pages, k) SELECT page_id, sha256(html || '<script>' || chr(10) || 'var MODEL = ' || to_json([header, codes, scales])::VARCHAR || ';' || chr(10) || 'var ready = 1;</script>') AS sha256 FROM pg JOIN lines USING (model)")
def baked_pages(spark, d):
    """Every page with the script of one model's export in place of an empty one."""
    lines = export_file.lines(_models(spark, d), {"n_embd": 64}, "a é", 4, PER_GROUP)
    scripts = staged(lines.select("model", export_file.script_module(F.col("header"), F.col("codes"), F.col("scales")).alias("script")), "scripts")
    n = scripts.count()
    pages = table(spark, d, "pages").select("page_id", F.concat("html", F.lit(_SLOT)).alias("page"), (F.col("page_id") % n).alias("model"))
    return pages.join(scripts, "model").select("page_id", F.sha2(export_file.baked(F.col("page"), F.col("script")), 256).alias("sha256"))


@_r.query()
def model_generate(spark, d):
    """What the seeded micro model answers to every user's turn, greedily, in eight characters."""
    from turnloom.functions.markers import BOT

    _, codec, size = _ids(spark, d)
    asked = corpus.turns(table(spark, d, "conversations")).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), codec.encode(F.concat("line", F.lit("\n" + BOT))).alias("ids"))
    out = network.generated(asked, _micro(size), "k", 8)
    return out.select("k", codec.decode(F.col("ids")).alias("text"), F.size("ids").alias("n"))
