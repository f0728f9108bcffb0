"""Sources and sinks on small files, and live teaching on a toy model."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom import chat
from turnloom.functions.markers import BASE, BOT, END, START, USER
from turnloom.operators import checkpoints, corpus, network, teaching, training
from turnloom.sources import conformance, export_file, texts


def written(folder, name, body):
    path = folder / name
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_blocks_and_pairs(spark, tmp_path):
    path = written(tmp_path, "b.txt", f"{USER}a{END}\n{BOT}b{END}\n\n\n  \n\n{USER}c{END}\n{BOT}d{END}\n")
    assert [r["lines"] for r in texts.blocks(spark, path).orderBy("block").collect()] == [[f"{USER}a{END}", f"{BOT}b{END}"], [f"{USER}c{END}", f"{BOT}d{END}"]]
    path = written(tmp_path, "p.txt", f"{USER}1{END}\n{BOT}2{END}\n\n{BOT}x{END}\n{USER}y{END}\n{USER}3{END}\n{BOT}4{END}\n{USER}odd{END}\n")
    assert [(r["pair"], r["user"], r["bot"]) for r in texts.pairs(spark, path).orderBy("pair").collect()] == [(0, f"{USER}1{END}", f"{BOT}2{END}"), (2, f"{USER}3{END}", f"{BOT}4{END}")]


def test_history(spark, tmp_path):
    assert texts.history(spark, f"file://{tmp_path}/none.json").count() == 0
    path = written(tmp_path, "h.json", json.dumps([{"role": "user", "text": "hi", "timestamp": "2024-05-01T10:00:00+00:00"}]))
    r = texts.history(spark, path).first()
    assert (r["role"], r["text"], r["timestamp"].year) == ("user", "hi", 2024)
    texts.add_history(spark.createDataFrame([("user", "x")], "role string, text string"), f"{tmp_path}/log")
    assert spark.read.schema(texts.HISTORY).json(f"{tmp_path}/log").first()["text"] == "x"


def test_vectors_and_notes(spark, tmp_path):
    case = {"prompt": "a", "ids": [1], "logits": [0.5, 1.0], "greedy_ids": [1], "greedy_text": "a"}
    path = written(tmp_path, "v.json", json.dumps({"about": "x", "tolerance": 1e-4, "greedy_steps": 1, "cases": [case, case]}))
    assert [r["case"] for r in texts.vectors(spark, path).collect()] == [0, 1]
    path = written(tmp_path, "n.md", "# R\n## 1.2.0\nnew\n\n## 1.1.0\nold\n")
    whole = spark.read.text(path, wholetext=True)
    assert [texts.notes(whole, t).first()[0] for t in ("v1.2.0", "1.1.0", "v9")] == ["## 1.2.0\nnew", "## 1.1.0\nold", ""]


def test_corpus_writer(spark, tmp_path):
    rows = [("train", f"{START}\n{USER}a{END}"), ("train", f"{START}\n{USER}b{END}\n{BOT}c{END}"), ("heldout", f"{START}\n{USER}d{END}")]
    df = spark.createDataFrame(rows, "split string, text string")
    stats = {r["split"]: r for r in texts.write_corpus(df, f"{tmp_path}/c").collect()}
    assert (stats["train"]["chars"], stats["train"]["conversations"], stats["train"]["distinct_chars"]) == (16, 2, 8)
    assert sorted(spark.read.text(f"{tmp_path}/c/split=heldout").toPandas()["value"]) == sorted([START, f"{USER}d{END}"])
    a, b = ({r["split"]: r["digest"] for r in texts.publication(x).collect()} for x in (df, df.repartition(3)))
    assert a == b and {r["split"]: r["turns"] for r in texts.publication(df).collect()} == {"train": 3, "heldout": 1}


def micro(symbols, block=96, width=16, seed=2):
    config = network.Config(len(symbols), block, 1, 2, width)
    return network.Network(config, network.initial(config, seed))


def test_teaching_and_undo(spark):
    symbols = sorted(set(BASE))
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, len(symbols), 16).tolist(), rng.integers(0, len(symbols), 16).tolist()) for i in range(20)]
    windows = spark.createDataFrame(rows, "start long, x array<int>, y array<int>")
    drawn = teaching.drawn_windows(windows, 6, 1)
    assert drawn[0].shape == (6, 16) and (teaching.drawn_windows(windows.repartition(5), 6, 1)[0] == drawn[0]).all() and teaching.drawn_windows(windows.limit(0), 6, 1) is None
    state = teaching.started(micro(symbols), symbols, drawn, drawn)
    now, record = teaching.lesson(state, ["Who is Ada?", "who is Ada", "please say who Ada is"], "A cat.", steps=8, rate=1e-2, size=4)
    assert record["loss_after"] < record["loss_before"] and record["held_out_wording"] == "please say who Ada is" and len(now.taught) == 2 and record["drift"] is not None
    assert teaching.undone(now) is not now and teaching.undone(now).net is state.net and teaching.undone(teaching.undone(now)).net is state.net and not teaching.undone(now).taught
    assert (now.net.p["tok_emb.weight"] != state.net.p["tok_emb.weight"]).any()
    back, record = teaching.guarded(state, ["Who is Ada?"], "A cat.", most_drift=-9.0, steps=2, rate=1e-2, size=4)
    assert record["rolled_back"] and back.net is state.net
    with pytest.raises(ValueError, match="no symbol"):
        teaching.lesson(state, ["é?"], "x")
    with pytest.raises(ValueError, match="longer"):
        teaching.examples(state, [("q" * 200, "a")], 0)
    x, y = teaching.examples(state, [("q", "a")], 0)
    assert x.shape == y.shape and [symbols[i] for i in y[1] if i != network.IGNORE] == ["a", END]
    log = spark.createDataFrame([("q", "a"), ("q", "a"), ("r", "b")], "wording string, answer string")
    polished, losses = teaching.polished(state, log, steps=6, rate=1e-2, size=4)
    assert losses[-1] < losses[0] and polished.earlier.net is state.net


def test_checkpoints_and_guards(spark, tmp_path):
    symbols = sorted("abc é\n")
    net = micro(symbols, 8, 8)
    checkpoints.save(spark, net, symbols, f"{tmp_path}/c")
    again, same = checkpoints.load(spark, f"{tmp_path}/c")
    assert same == symbols and again.config == net.config and all((again.p[k] == v).all() for k, v in net.p.items())
    texts_ = spark.createDataFrame([("abc",), ("xé x",)], "text string")
    assert [tuple(r) for r in checkpoints.missing_symbols(texts_, symbols).collect()] == [("x", 1)]
    with pytest.raises(ValueError, match="no symbol for: 'x'"):
        checkpoints.guard_vocabulary(texts_, symbols)
    checkpoints.guard_vocabulary(texts_.limit(1), symbols)
    bad, good = written(tmp_path, "bad.txt", "abc€"), written(tmp_path, "good.txt", "abc\ncab\n" + "€" * 3)
    assert checkpoints.first_readable(spark, [f"{tmp_path}/none", bad, good], symbols, head=8) == good and checkpoints.first_readable(spark, [bad], symbols) is None
    ids = checkpoints.encoded_corpus(spark, good, symbols, f"{tmp_path}/cache")
    want = [[symbols.index(c) for c in t] for t in ("abc\n", "cab\n", "\n")]
    assert [r["ids"] for r in ids.orderBy("at").collect()] == want
    kept = sorted(os.listdir(tmp_path / "cache"))
    checkpoints.encoded_corpus(spark, good, symbols, f"{tmp_path}/cache")
    assert sorted(os.listdir(tmp_path / "cache")) == kept
    written(tmp_path, "good.txt", "a\n")
    assert checkpoints.encoded_corpus(spark, good, symbols, f"{tmp_path}/cache").count() == 1


def test_training_keeps_the_best(spark, tmp_path):
    symbols = list("abcde")
    net = micro(symbols, 8, 8)
    chunks = spark.createDataFrame([(1, [0, 1, 2, 3, 4] * 8), (2, [0, 1, 2] * 3)], "k long, ids array<int>")
    windows = corpus.text_windows(chunks, "k", "ids", 8).cache()
    said = []
    best, history = training.train(net, windows, windows, symbols, 6, lambda step: 1e-2 if step < 4 else 30.0, every=1, patience=1, checkpoint=f"{tmp_path}/best", log=f"{tmp_path}/log", out=said.append)
    assert history[-1]["stale"] == 1 and said[-1] == "stopped early" and (tmp_path / "log").read_text().splitlines() == said
    assert all((checkpoints.load(spark, f"{tmp_path}/best")[0].p[k] == v).all() for k, v in best.p.items())


def test_text_windows(spark):
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 9, int(n)).tolist() for n in rng.integers(0, 30, 40)]
    whole = [v for p in parts for v in p]
    chunks = spark.createDataFrame(list(enumerate(parts)), "k long, ids array<int>").repartition(5)
    for block, most in ((7, None), (7, 5), (50, None), (len(whole), None)):
        got = [(r["start"], r["x"], r["y"]) for r in corpus.text_windows(chunks, "k", "ids", block, most).orderBy("at").collect()]
        starts = list(range(0, len(whole) - block - 1, block))[:most]
        assert got == [(s, whole[s : s + block], whole[s + 1 : s + block + 1]) for s in starts]
    drawn = corpus.drawn_text_windows(chunks, "k", "ids", 7, 30, 1).collect()
    assert len(drawn) == 30 and len({r["start"] for r in drawn}) > 20 and all((r["x"], r["y"]) == (whole[r["start"] : r["start"] + 7], whole[r["start"] + 1 : r["start"] + 8]) for r in drawn)
    assert corpus.drawn_text_windows(chunks, "k", "ids", 5000, 30, 1).count() == 0


def test_conformance_kit_and_chat(spark, tmp_path):
    symbols = sorted(set(BASE))
    kit = conformance.write(spark, f"{tmp_path}/kit", symbols)
    assert len(kit["cases"]) == 5 and max(len(c["ids"]) for c in kit["cases"]) == 16
    rows = export_file.read(spark, f"{tmp_path}/kit/micro").collect()
    net = network.Network(network.Config(len(symbols), **conformance.MICRO), {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows})
    assert conformance.worst_gap(spark, f"{tmp_path}/kit", net) < kit["tolerance"] and [r["case"] for r in texts.vectors(spark, f"{tmp_path}/kit/vectors").collect()] == list(range(5))
    checkpoints.save(spark, net, symbols, f"{tmp_path}/c")
    said, lines = [], iter(["Hello?", ""])
    chat.chat(spark, f"{tmp_path}/c", lambda: next(lines), said.append, f"{tmp_path}/talk", new=4)
    assert len(said) >= 1 and [r["role"] for r in spark.read.schema(texts.HISTORY).json(f"{tmp_path}/talk").orderBy(F.desc("role")).collect()] == ["user", "assistant"]


def test_line_writer_and_publication(spark, tmp_path):
    stats = texts.write_lines(spark.createDataFrame([("a",), ("a",), ("b",)], "line string"), f"{tmp_path}/g").first()
    assert tuple(stats) == (3, 2, 0.666667) and spark.read.text(f"{tmp_path}/g").count() == 3
    df = spark.createDataFrame([("train", f"{START}\n{USER}a{END}"), ("heldout", f"{START}\n{USER}d{END}")], "split string, text string")
    readme = texts.publish(df, f"{tmp_path}/p", "make it")
    assert "| conversations | 1 | 1 |" in readme and readme.count("heldout") == 2 and spark.read.text(f"{tmp_path}/p/README.md").first()[0] == "# Corpus"
