"""Corpora of a size, pairs, windows, digests, dictionaries, the encode manifest and lesson sessions, against plain versions and on awkward input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions.draws import draw
from turnloom.functions.markers import BOT, END, USER
from turnloom.operators import assemble, checkpoints, corpus, dictionary, lessons
from turnloom.sources import texts
from turnloom.streaming import sessions

SHARES = {"composed": 60, "think": 50, "math": 20, "thinking_on": False}


def test_fills(spark):
    """Whatever the partitions: whole passes, then the beginning of one, in a drawn order; the conversation that crosses the target is kept."""
    rows = [(c, p, "user" if p % 2 == 0 else "assistant", f"line {p} of block {c}.") for c in range(7) for p in range(4)]
    blocks = spark.createDataFrame(rows, "conv_id long, place int, role string, body string")
    targets = [1, 2500, 20_000]
    got = assemble.fills(blocks, targets, 5, **SHARES).withColumn("d", draw(5, F.col("conv_id"), 0)).collect()
    assert {r["branch"] for r in got} == {"reframed", "thinking", "math", "talk"}
    chosen = {}
    for t in targets:
        mine = sorted((r["pass"], r["d"], r["conv_id"], r["size"], r["text"]) for r in got if r["target"] == t)
        before = 0
        for m in mine:
            assert before < t
            before += m[3]
        assert before >= t and len({m[4] for m in mine}) > 0.9 * len(mine)
        chosen[t] = mine
        last = mine[-1][0]
        for p in range(last):
            assert sorted(m[2] for m in mine if m[0] == p) == [f"{c}/{p}" for c in range(7)]
    assert len(chosen[1]) == 1 and chosen[2500] == chosen[20_000][: len(chosen[2500])] and chosen[20_000][-1][0] > 2
    assert any(r["size"] > len(r["text"]) + 1 for r in got if r["branch"] == "thinking") and all(r["size"] == len(r["text"]) + 1 for r in got if r["branch"] == "math")
    again = assemble.fills(blocks.repartition(5), [2500], 5, **SHARES).select("conv_id", "text").collect()
    assert sorted((m[2], m[4]) for m in chosen[2500]) == sorted(map(tuple, again))
    empty = assemble.fills(blocks.limit(0), [100], 5, **SHARES)
    assert empty.count() == 0 and empty.columns == ["target", "pass", "conv_id", "branch", "size", "text"]


def test_fills_make_a_conversation_once(spark, monkeypatch):
    """Texts are not made a second time once the sizes are known, only conversations that the mixture asks for are generated, and many tasks generate them."""
    from turnloom import session

    session.release(spark)
    rows = [(c, p, "user" if p % 2 == 0 else "assistant", f"line {p} of block {c}.") for c in [*range(40), None] for p in range(4)]
    blocks = spark.createDataFrame(rows, "conv_id long, place int, role string, body string")
    parts, generated = [], assemble.conversations
    monkeypatch.setattr(assemble, "conversations", lambda s, keys, *a: parts.append(keys.distinct().rdd.getNumPartitions()) or generated(s, keys, *a))
    got = assemble.fills(blocks, [60_000], 5, **SHARES).collect()
    assert got and all(r["conv_id"] for r in got) and max(r["pass"] for r in got) > 0
    turns = [spark.read.parquet(p).select("conv_id", "exchange") for p in session._staged if "-turns-" in p]
    made = [tuple(r) for t in turns for r in t.collect()]
    assert made and len(made) == len(set(made))
    branch = {r["conv_id"]: r["branch"] for r in got}
    assert {branch[c] for c, _ in made if c in branch} == {"thinking", "talk"}
    assert min(parts) >= spark.sparkContext.defaultParallelism
    session.release(spark)


@pytest.mark.parametrize("size", ["64", "10m"])
def test_pairs_of_large_files(spark, tmp_path, size):
    """Files cut into many splits: parity goes by lines that aren't blank, a mismatch doesn't shift it, and every file begins anew."""
    rng, want = random.Random(3), {}
    for name in ("a.txt", "b.txt"):
        lines = [rng.choice([USER, BOT, USER, BOT, "x"]) + f"{i}é" * rng.randint(1, 6) + END if rng.random() > 0.2 else rng.choice(["", "  ", "\t"]) for i in range(300)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        told = [x for x in lines if x.strip()]
        want[name] = [(i // 2, told[i], told[i + 1]) for i in range(0, len(told) - 1, 2) if told[i].startswith(USER) and told[i + 1].startswith(BOT)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = texts.pairs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, rows in want.items():
        assert sorted((r["pair"], r["user"], r["bot"]) for r in got if r["file"].endswith(name)) == rows and rows


def test_pairs_awkward(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, " ", 3), (4, "b", 4), (5, "c", 5)], "k long, line string, pair int")
    got = corpus.paired(df, ["k"], F.lit(True), F.lit(True)).collect()
    assert [tuple(r) for r in got] == [(0, "a", "b")]
    assert corpus.paired(df.limit(0), ["k"], F.lit(True), F.lit(True)).count() == 0


def written_bytes(spark):
    """What all stages so far shuffled and stored."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        s = stages.next()
        total += s.shuffleWriteBytes() + s.outputBytes()
    return total


def test_a_million_windows(spark):
    rng = random.Random(1)
    chunks = [(i, [i * 1000 + j for j in range(rng.choice([0, 1, 3, 50, 900, 9000]))]) for i in range(200)]
    whole = [x for _, ids in chunks for x in ids]
    df = spark.createDataFrame(chunks, "k long, ids array<int>")
    block, n = 24, len(whole)
    starts = corpus.drawn_starts(spark, 1_000_000, 4, n - block - 1)
    got = corpus.windows_at(df, "k", "ids", block, starts)
    assert got.count() == 1_000_000 and got.where((F.size("x") != block) | (F.size("y") != block)).count() == 0
    for r in got.where("at % 997 = 0").collect():
        assert r["x"] == whole[r["start"] : r["start"] + block] and r["y"] == whole[r["start"] + 1 : r["start"] + block + 1]
    edge = spark.createDataFrame([(i, s) for i, s in enumerate([-1, 0, 0, n - block - 2, n - block - 1, n, 4095, 4096 - block])], "at long, start long")
    assert {r["at"]: r["x"] for r in corpus.windows_at(df, "k", "ids", block, edge).collect()} == {i: whole[s : s + block] for i, s in ((1, 0), (2, 0), (3, n - block - 2), (6, 4095), (7, 4096 - block))}
    wide = corpus.windows_at(df, "k", "ids", 5000, spark.createDataFrame([(0, 7)], "at long, start long")).first()
    assert wide["x"] == whole[7:5007]


def test_windows_of_texts_shuffle_little(spark):
    """Texts take the place of ids; what is shuffled and stored is a few times the text, where every window of ids had been stored and shuffled in pieces."""
    rng = random.Random(2)
    chunks = [(i, "".join(rng.choice("ab cdé𝄞") for _ in range(rng.choice([0, 1, 30, 900, 20_000])))) for i in range(120)]
    whole = "".join(t for _, t in chunks)
    df = spark.createDataFrame(chunks, "k long, text string")
    starts = corpus.drawn_starts(spark, len(whole) // 50, 4, len(whole) - 33)
    before = written_bytes(spark)
    got = {r["at"]: r for r in corpus.windows_at(df, "k", "text", 32, starts).collect()}
    assert len(got) == len(whole) // 50 and all(r["x"] == whole[r["start"] : r["start"] + 32] and r["y"] == whole[r["start"] + 1 : r["start"] + 33] for r in got.values())
    assert 0 < written_bytes(spark) - before < 5 * len(whole.encode())


def test_digest_depends_on_order_and_merges(spark):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    words = lambda part: tuple(corpus.digest_words(spark.createDataFrame(part, "k long, text string"), ["k"], "text").first())
    whole = words(rows)
    assert whole == words(random.Random(2).sample(rows, 40))
    swapped = [(3, rows[4][1]) if k == 3 else (4, rows[3][1]) if k == 4 else (k, t) for k, t in rows]
    assert words(swapped) != whole and words([(k + 1000, t) for k, t in rows]) == whole
    for cut in (0, 1, 17, 40):
        assert corpus.merged_words(words(rows[:cut]), words(rows[cut:])) == whole
    plain = [0] * 8
    import hashlib

    for _, t in rows:
        h = hashlib.sha256(t.encode()).hexdigest()
        plain = [(x * b + int(h[8 * i : 8 * i + 8], 16)) % corpus.DIGEST_MODULUS for i, (x, b) in enumerate(zip(plain, corpus.DIGEST_BASES))]
    assert whole == (40, plain) and words([]) == (0, [0] * 8)


@pytest.mark.parametrize("letters", [dictionary.LETTERS, 40])
def test_names_in_texts(spark, letters):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abé𝄞") for _ in range(rng.randint(1, 6))) for _ in range(60)}) + ["zq", "qz"]
    rows = [(i, "".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(200, None), (201, ""), (202, "zqz"), (203, "ab" * 400_000 + names[0]), (204, "x")]
    texts_ = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "k long, text string, name string, ord int")
    table = spark.createDataFrame([*enumerate(names), (900, ""), (901, None)], "ord long, name string")
    got = {r["k"]: (r["ord"], r["name"], r["n_names"]) for r in dictionary.named_in(texts_, table, "k", letters=letters).collect()}
    want = {}
    for i, t in rows:
        there = [(-len(x), o, x) for o, x in enumerate(names) if t and x in t]
        if there:
            want[i] = (min(there)[1], min(there)[2], len(there))
    assert got == want and got[202][1] == "zq"
    assert dictionary.named_in(texts_, table.limit(0), "k").count() == 0 and dictionary.named_in(texts_.limit(0), table, "k").count() == 0


def test_manifest_reads_what_changed(spark, tmp_path):
    folder, cache, symbols = tmp_path / "text", f"{tmp_path}/cache", sorted(set("abc \n"))
    folder.mkdir()
    for name, text in (("a b.txt", "ab\nb\n"), ("b.txt", "c\n"), ("c.txt", "")):
        (folder / name).write_text(text)

    def held():
        codec = corpus.Codec(symbols)
        rows = checkpoints.encoded_files(spark, cache).withColumn("text", codec.decode(F.col("ids"))).orderBy("file", "block", "at").collect()
        return "".join(r["text"] for r in rows)

    refresh = lambda: checkpoints.refresh_encoded(spark, str(folder), symbols, cache, at_a_time=2)
    assert (refresh(), held()) == (2, "ab\nb\nc\n")  # an empty file holds nothing
    assert (refresh(), held()) == (0, "ab\nb\nc\n")
    (folder / "b.txt").write_text("ccc\n")
    (folder / "d.txt").write_text("a\n")
    assert (refresh(), held()) == (2, "ab\nb\nccc\na\n")
    (folder / "a b.txt").unlink()
    assert (refresh(), held()) == (0, "ccc\na\n")
    assert sorted(p.name.split("=")[0] for p in (tmp_path / "cache" / "ids").iterdir() if p.is_dir()) == ["seal"] * 2
    symbols.append("d")  # another vocabulary
    assert refresh() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_of_any_split(spark, tmp_path, files):
    """Records in any order, over any number of files, some of them twice: the same sessions as in one batch."""
    rng = random.Random(files)
    log = []
    for i in range(300):
        who, minute = rng.choice("abc"), rng.randint(0, 4000)
        log.append({"when": f"2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00Z", "question": f"q{rng.randint(0, 3)}", "answer": who, "learned": rng.random() < 0.5, "generalized": rng.random() < 0.3,
                    "drift": rng.random() / 4, "checks": rng.randint(3, 6), "checks_baseline": 6, "rolled_back": rng.random() < 0.2})
    log += rng.sample(log, 20)
    lines = [json.dumps(x) for x in log] + ["", "{broken", json.dumps({"question": "no time", "answer": "a"})]
    rng.shuffle(lines)
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    # Records of one name differ in their figures: the one that comes first counts, so only the other figures are compared.
    same = {(r["when"], r["question"], r["answer"]): r for r in log}
    df = spark.createDataFrame([(x if not x.startswith('{"when"') else json.dumps(same[tuple(json.loads(x)[k] for k in ("when", "question", "answer"))]),) for x in lines], "value string")
    df.repartition(files * 2).write.text(f"{tmp_path}/in")
    got = sessions.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", F.col("answer"), 1800, "3000 days", files=files, close=True)
    want = sessions.batch(lessons.records(df), F.col("answer"), 1800)
    columns = ["learner", "began", "ended", *sessions.FIGURES]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.count() > 20 and got.agg(F.sum("lessons")).first()[0] == len(same)
    # A second run finds nothing new.
    assert sessions.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", F.col("answer"), 1800, "3000 days").count() == got.count()


def test_sessions_close_by_time_and_late_records_fall(spark, tmp_path):
    record = lambda day, q="q": json.dumps({"when": f"2024-01-{day:02d}T00:00:00Z", "question": q, "answer": "a", "rolled_back": False})
    run = lambda *lines: (
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in"),
        sorted((r["began"].day, r["lessons"]) for r in sessions.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", F.col("answer"), 3600, "2 days").collect()),
    )[1]
    assert run(record(3), record(3, "r")) == []
    assert run(record(10)) == [(3, 2)]  # the watermark has passed the first session's end
    assert run(record(4)) == [(3, 2)]  # too late: dropped
    assert run(record(20)) == [(3, 2), (10, 1)]


def test_text_windows_are_not_shuffled_by_window(spark):
    """Chunks are stored once and cut into cells; before, they were stored twice, and every window shuffled in pieces."""
    rng = random.Random(3)
    chunks = [(i, [rng.randint(0, 60_000) for _ in range(rng.choice([1, 30, 20_000]))]) for i in range(60)]
    whole = [x for _, ids in chunks for x in ids]
    before = written_bytes(spark)
    got = {r["at"]: r for r in corpus.text_windows(spark.createDataFrame(chunks, "k long, ids array<int>"), "k", "ids", 32).collect()}
    assert len(got) == -(-(len(whole) - 33) // 32) and all(r["start"] == 32 * i and r["x"] + r["y"][-1:] == whole[32 * i : 32 * i + 33] for i, r in got.items())
    told = (written_bytes(spark) - before) / len(whole)
    assert told < 9, told


def test_lines_of_documents_are_made_once(spark, tmp_path):
    """No empty text or null among them, and no text translated for a filter."""
    from turnloom.plans.corpus_queries import _one_line

    spark.createDataFrame([(1, "a", "x\ny"), (2, "a", ""), (3, "b", None), (4, "b", "\n")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/d")
    df = _one_line(spark.read.parquet(f"{tmp_path}/d"))
    assert sorted(map(tuple, df.collect())) == [(1, "a", "x y"), (4, "b", " ")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_lessons_of_one_second_are_told_apart(spark, tmp_path):
    """Different lessons of a learner with one time, question and answer count each; equal ones once."""
    import duckdb

    from turnloom.plans.lesson_queries import ORACLE_SQL, QUERIES

    rows = [(1, 5, "click", 70.0), (2, 5, "click", 90.0), (3, 5, "error", 70.0), (8, 5, "click", 70.0), (15, 5, "view", 70.0), (4, 6, "view", 1.0), (11, 6, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.expr("timestamp'2024-01-05 10:00:00.25' + make_interval(0, 0, 0, 0, 0, 0, event_id / 100.0)")).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["session_stream"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["session_stream"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and sorted(r["lessons"] for r in got.collect()) == [1, 4]


def test_sessions_are_told_to_the_microsecond(spark, tmp_path):
    """A pause of the gap joins, one a part of a millisecond longer doesn't, and a session's ends are whole; before, the stream cut times to milliseconds."""
    times = ["10:00:00.000100", "10:30:00.000100", "11:00:00.000500", "11:30:00.000500", "11:30:00.000500"]
    lines = [json.dumps({"when": f"2024-01-03T{t}Z", "question": "q", "answer": a}) for t in times for a in "ab"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    df.repartition(3).write.text(f"{tmp_path}/in")
    got = sessions.run_once(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", F.col("answer"), 1800, "3000 days", close=True)
    want = sessions.batch(lessons.records(df), F.col("answer"), 1800)
    columns = ["learner", "began", "ended", *sessions.FIGURES]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert sorted((r["learner"], f"{r['began']:%T.%f}", f"{r['ended']:%T.%f}", r["lessons"]) for r in got.collect()) == [(a, times[i], times[i + 1], 2) for a in "ab" for i in (0, 2)]


def test_sessions_are_folded_without_python(spark, tmp_path):
    """No learner's rows or session's digests are held in a Python worker; before, each lesson was compared with all that its learner had open."""
    (tmp_path / "in").mkdir()
    stream = sessions.stream(spark.readStream.format("text").load(f"{tmp_path}/in"), F.col("answer"), 1800, "2 days")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert stream.isStreaming and "session_window" in plan and "Python" not in plan and "Pandas" not in plan and "UDF" not in plan
    with pytest.raises(ValueError, match="above 0"):
        sessions.stream(spark.readStream.format("text").load(f"{tmp_path}/in"), F.col("answer"), 0, "2 days")


def test_session_stream_takes_two_batches(spark, tmp_path, monkeypatch):
    """However many files the log has; before, two files a batch, and each batch opens every partition's state."""
    from turnloom import session
    from turnloom.plans.lesson_queries import QUERIES

    spark.range(1, 60).selectExpr("id AS event_id", "id % 9 AS user_id", "'click' AS event_type", "double(id) AS value", "timestamp'2024-01-05 10:00:00' + make_interval(0, 0, 0, 0, id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    frame = type(spark.range(1))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: plain(self, 12 if n == 4 else n, *by))
    found = QUERIES["session_stream"](spark, str(tmp_path))
    assert found.agg({"lessons": "sum"}).first()[0] == 58  # event 50's line is cut
    folder = next(x for x in reversed(session._staged) if "turnloom-sessions-" in x).removeprefix("file:").replace("//", "/", 1)
    with_rows = [x for x in spark.read.text(f"file:{folder}/state/sources/0").where("value like '{%'").selectExpr("get_json_object(value, '$.batchId') AS b").distinct().collect()]
    assert len(with_rows) == 3  # two, and the log's end
