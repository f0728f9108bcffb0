"""How far texts agree with a corpus: the longest beginning of each that stands in one of the corpus' lines.

Texts of MOST_BYTES together are shipped as one trie, which every place of every line walks as far as it agrees, many places at once: the corpus is read
once and only what each task found of the texts is shuffled. More texts than that go the way of sorted suffixes:

Every place of a line begins a suffix. Suffixes and texts are sorted together, and a text agrees longest with the suffix before or behind it. The sort is
by ranges, so no task and not the driver holds more than its part; a range hands its first and last suffix to its neighbours, and
texts at its edge wait for those. Ties are told apart by line and place, so a passage that a third of the lines repeat is cut into ranges like any other.

Suffixes are cut to WIDTH characters in the first round, which ends most texts. What agrees that far goes through a second one, in which only the
suffixes behind such a beginning take part, as long as the longest text. Equal lines are taken once. Cost: a shuffle of WIDTH characters for each character of
the corpus and one of its lines, at most. Where the texts have few enough different heads of three characters (MOST_HEADS, counted), these are shipped, and
suffixes with another head stay away: they agree with a text on two characters at most, which the corpus' different pairs of characters tell. Else
nothing is broadcast but the ranges' edges, two short texts each.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import spread, staged

WIDTH, FLUSH, HEAD, MOST_HEADS = 24, 50_000, 3, 500_000
MOST_BYTES = 4 << 20
#: A byte that no text in UTF-8 has.
BREAK = b"\xff"
#: s: a suffix (text 0) or a text (1); at, place: where a suffix stands.
SORTED = "s string, text int, at long, place int"
#: What the merge of a range tells: of a text, how far it agrees within the range, and whether a neighbour is missing on
#: one side; the range's first and last suffix; and the places where a text of full width stands, or may stand if it is told by a range before.
TOLD = "what string, range int, s string, n int, at long, place int"


def _suffixes(batches: Iterator[pa.RecordBatch], width: int, heads: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """(at, line) to SORTED: the suffixes with one of the heads and, once a task, the pairs of characters; all suffixes without heads."""
    held: tuple[list, list, list] = [], [], []
    twos: set[str] = set()

    def out() -> pa.RecordBatch:
        n = len(held[0])
        batch = pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(np.zeros(n, np.int32)), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int32())], ["s", "text", "at", "place"])
        for x in held:
            x.clear()
        return batch

    for batch in batches:
        for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for low in range(0, len(line), FLUSH):
                places = range(low, min(low + FLUSH, len(line)))
                if heads is not None:
                    new = {line[i : i + HEAD - 1] for i in places} - twos
                    twos |= new
                    held[0].extend(new)
                    held[1].extend([None] * len(new))
                    held[2].extend([None] * len(new))
                    places = [i for i in places if line[i : i + HEAD] in heads]
                held[0].extend([line[i : i + width] for i in places])
                held[1].extend([at] * len(places))
                held[2].extend(places)
                if len(held[0]) >= FLUSH:
                    yield out()
    yield out()


class Trie:
    """Texts by their bytes. keys: 256 node + byte of every edge in order, levels one after another, so that edge i leads to node i + 1; the root is 0."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        coded = [t.encode() for t in texts]
        self.sizes = np.array([len(b) for b in coded], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(coded) + BREAK, np.uint8)
        node, levels, n, alive = np.zeros(len(texts), np.int64), [], 0, np.flatnonzero(self.sizes)
        for depth in range(int(self.sizes.max(initial=0))):
            alive = alive[self.sizes[alive] > depth]
            edges, which = np.unique(node[alive] * 256 + self.bytes[self.begins[alive] + depth], return_inverse=True)
            node[alive] = n + 1 + which
            levels.append(edges)
            n += len(edges)
        self.keys = np.concatenate([*levels, [np.iinfo(np.int64).max]])
        first = np.searchsorted(self.keys, 256)
        self.one = np.zeros(256, np.int64)
        self.one[self.keys[:first]] = np.arange(1, first + 1)
        node, a, b = self.step(np.repeat(self.one, 256), np.tile(np.arange(256), 256))
        self.two = np.where(np.repeat(self.one, 256) > 0, node, 0).astype(np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next nodes, 0 where there is none; the keys and their places."""
        key = node * 256 + byte
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at + 1, 0), key, at

    def walk(self, data: np.ndarray, seen: np.ndarray) -> None:
        """Marks the nodes that any place of data leads to; data ends with two breaks."""
        seen[self.one[np.flatnonzero(np.bincount(data, minlength=256))]] = True
        node = self.two[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]
        at, depth = np.flatnonzero(node), 2
        node = node[at].astype(np.int64)
        while len(at):
            seen[node] = True
            node = self.step(node, data[at + depth])[0]
            at, node, depth = at[node > 0], node[node > 0], depth + 1

    def reached(self, seen: np.ndarray) -> np.ndarray:
        """Of each text, how many whole characters the marked nodes spell."""
        node, size, alive, depth = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64), np.flatnonzero(self.sizes), 0
        while len(alive):
            alive = alive[self.sizes[alive] > depth]
            node[alive] = self.step(node[alive], self.bytes[self.begins[alive] + depth])[0]
            alive = alive[seen[node[alive]]]
            depth += 1
            size[alive] = depth
        leads = np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])
        inside = (size < self.sizes) & ((self.bytes[self.begins + size] & 0xC0) == 0x80)  # it ends within a character
        return leads[self.begins + size] - leads[self.begins] - inside


def _found(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[pa.RecordBatch]:
    """(line) to (t, n): how far the task's lines have each text, where they have any of it."""
    seen = np.zeros(len(trie.keys), bool)
    for batch in batches:
        data = BREAK.join([x for x in batch.column(0).cast(pa.binary()).to_pylist() if x] + [BREAK * 2])
        trie.walk(np.frombuffer(data, np.uint8), seen)
    seen[0] = False
    n = trie.reached(seen)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array([trie.texts[i] for i in some], pa.string()), pa.array(n[some], pa.int32())], ["t", "n"])


def _common(a: str | None, b: str | None) -> int:
    return len(os.path.commonprefix([a, b])) if a is not None and b is not None else 0


def _merge(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One range in order: SORTED to TOLD."""
    me = TaskContext.get().partitionId()
    last: str | None = None  # the last suffix so far
    waiting: list[tuple[str, int]] = []  # texts behind it, and how far they agree with it
    begun: str | None = None  # the last text of full width; suffixes equal to it follow it
    first: str | None = None
    opening = True  # no other s than the range's first has come

    def told(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["what", "range", "s", "n", "at", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows: list[tuple] = []
        s, text = batch.column(0), np.asarray(batch.column(1)) == 1
        if first is None:
            opened = s[0].as_py()
        texts, suffixes = np.flatnonzero(text), np.flatnonzero(~text)
        # Texts between one suffix and the next share both.
        before = np.searchsorted(suffixes, texts) - 1
        if waiting and len(suffixes):  # texts of batches before
            behind = s[int(suffixes[0])].as_py()
            rows += [("text", me, x, max(n, _common(x, behind)), None, None) for x, n in waiting]
            waiting = []
        for t, b in zip(texts.tolist(), before.tolist()):
            x = s[t].as_py()
            ahead = s[int(suffixes[b])].as_py() if b >= 0 else last
            n = _common(x, ahead)
            if ahead is None:
                rows.append(("first", me, x, n, None, None))
            if b + 1 < len(suffixes):
                rows.append(("text", me, x, max(n, _common(x, s[int(suffixes[b + 1])].as_py())), None, None))
            else:
                waiting.append((x, n))
        if len(suffixes):
            if last is None:
                rows.append(("low", me, s[int(suffixes[0])].as_py(), None, None, None))
            last = s[int(suffixes[-1])].as_py()
        # Places of texts of full width: the suffixes equal to the text before them.
        whole = texts[[len(s[int(t)].as_py()) == width for t in texts]] if len(texts) else texts
        owner = np.searchsorted(whole, suffixes) - 1
        if len(suffixes):
            names = pa.array([begun, *(s[int(t)].as_py() for t in whole)], pa.string())
            mine = s.take(pa.array(suffixes))
            hit = pc.fill_null(pc.equal(mine, names.take(pa.array(owner + 1))), False).to_numpy(zero_copy_only=False)
            if opening:
                same = pc.equal(mine, pa.scalar(opened)).to_numpy(zero_copy_only=False) & ~hit
                at, place = batch.column(2).take(pa.array(suffixes[same])), batch.column(3).take(pa.array(suffixes[same]))
                if len(opened) == width:
                    rows += [("perhaps", me, opened, None, a, p) for a, p in zip(at.to_pylist(), place.to_pylist())]
            at = suffixes[hit]
            rows += [("place", me, None, None, a, p) for a, p in zip(batch.column(2).take(pa.array(at)).to_pylist(), batch.column(3).take(pa.array(at)).to_pylist())]
        first = opened
        opening = opening and s[batch.num_rows - 1].as_py() == opened
        if len(whole):
            begun = s[int(whole[-1])].as_py()
        yield told(rows)
    rows = [("last", me, x, n, None, None) for x, n in waiting]
    if last is not None:
        rows.append(("high", me, last, None, None, None))
    yield told(rows)


def agreement(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at their beginnings; 0 with null."""
    return F.pandas_udf(_agreements, "int")(a, b)


def _agreements(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common(x, y) for x, y in zip(a, b)], dtype="int32")


def _round(texts: DataFrame, suffixes: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """texts: (s), distinct. (s, n): how far each agrees with the nearest suffixes; (at, place): the suffixes of full width that equal a text."""
    every = texts.select("s", F.lit(1).alias("text"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("place")).unionByName(suffixes)
    # A text comes before the suffixes that equal it.
    order = [F.col("s"), F.desc("text"), F.col("at"), F.col("place")]
    told = every.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _merge(it, width), TOLD)
    told = staged(told, "merged")
    ranges = told.where("what in ('low', 'high')").groupBy("range").agg(F.max(F.when(F.col("what") == "low", F.col("s"))).alias("low"), F.max(F.when(F.col("what") == "high", F.col("s"))).alias("high"))
    edges = told.select("range").distinct().join(ranges, "range", "left")  # two short texts a range
    by = Window.orderBy("range")
    edges = edges.select("range", F.last("high", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"), F.first("low", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    open_ = told.where("what in ('first', 'last')").join(F.broadcast(edges), "range")
    mended = open_.select("s", F.greatest("n", agreement(F.col("s"), F.when(F.col("what") == "first", F.col("ahead")).otherwise(F.col("behind")))).alias("n"))
    found = told.where("what = 'text'").select("s", "n").union(mended).groupBy("s").agg(F.max("n").alias("n"))
    perhaps = told.where("what = 'perhaps'").join(texts, "s", "left_semi")
    places = told.where("what = 'place'").select("at", "place").union(perhaps.select("at", "place"))
    return found, places


def longest_prefixes(texts: DataFrame, lines: DataFrame, key: str, text: str = "reply", line: str = "line", width: int = WIDTH, most_heads: int = MOST_HEADS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, length, prefix: of each text, its length and the length of its longest beginning that stands in one of the lines. Null counts as empty."""
    t = F.col(text)
    said = staged(texts.select(t.alias("t")).where(F.length(t) > 0).distinct(), "texts")
    total, longest = said.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.max(F.length("t")), F.lit(0))).first()
    if total <= most_bytes:
        shipped = lines.sparkSession.sparkContext.broadcast(Trie([r["t"] for r in said.collect()]))  # counted: most_bytes at most
        best = spread(lines.select(F.col(line).alias("line"))).mapInArrow(lambda it: _found(it, shipped.value), "t string, n int").groupBy("t").agg(F.max("n").alias("n"))
    else:
        best = _by_suffixes(said, lines, line, longest, width, most_heads)
    size: Column = F.coalesce(F.length(t), F.lit(0))
    asked = texts.select(F.col(key).alias("__key"), t.alias("__text"), size.alias("__length"))
    return asked.join(best, F.col("__text") == F.col("t"), "left").select(F.col("__key").alias(key), F.col("__length").alias("length"), F.coalesce("n", F.lit(0)).alias("prefix"))


def _by_suffixes(said: DataFrame, lines: DataFrame, line: str, longest: int, width: int, most_heads: int) -> DataFrame:
    """t, n of the texts (t), by sorted suffixes."""
    kept = staged(lines.select(F.col(line).alias("line")).where(F.length(line) > 0).distinct().select(F.xxhash64("line").alias("at"), "line"), "lines")  # lines of one hash are all looked up
    heads = said.select(F.left("t", F.lit(HEAD)).alias("h")).distinct()
    few = width > HEAD and heads.count() <= most_heads
    shipped = lines.sparkSession.sparkContext.broadcast(frozenset(r["h"] for r in heads.collect()) if few else None)  # three characters each
    cut = spread(kept).mapInArrow(lambda it: _suffixes(it, width, shipped.value), SORTED)
    found, places = _round(said.select(F.left("t", F.lit(width)).alias("s")).distinct(), cut, width)
    best = said.join(found.withColumnRenamed("n", "short"), F.left("t", F.lit(width)) == F.col("s")).select("t", "short")
    if longest > width:
        tails = places.distinct().join(kept, "at").select(F.substr("line", F.col("place") + 1, F.lit(longest)).alias("s"), F.lit(0).alias("text"), "at", "place")
        deep = staged(best.where((F.col("short") == width) & (F.length("t") > width)).select(F.col("t").alias("s")), "texts")
        further, _ = _round(deep, tails, longest + 1)
        return best.join(further.withColumnRenamed("n", "far"), F.col("t") == F.col("s"), "left").select("t", F.greatest("short", "far").alias("n"))
    return best.select("t", F.col("short").alias("n"))
