"""Names of a dictionary in texts: which occur, and the longest, by one pass with a trie of all names.

The trie is a table (node, character) -> node in arrays, made from the names once and shipped. All places of a batch of texts walk it
together, a character a step, until none is left; so the cost is the texts' length times how deep the names go, whatever their number.
Names beyond LETTERS letters in all are dealt by hash over several tries of that size, each a pass over the texts, whose findings are folded: what is shipped at once, and what the
driver holds of the names, is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import spread, text_batches

LETTERS, SLICE = 32_000_000, 1 << 18
#: Stands between texts; no character has its code.
BREAK = 0x110000


class Trie:
    def __init__(self, names: list[str]):
        edges: dict[int, int] = {}
        ends = [-1]
        for i, name in enumerate(names):
            node = 0
            for c in name:
                node = edges.setdefault(node << 21 | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            if name and ends[node] < 0:
                ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.depth = max(map(len, names), default=0)
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.nodes = np.append(np.fromiter(edges.values(), np.int64, len(edges))[order], -1)

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, name) of every name that begins at a place of the characters' codes, of equal names the first."""
        place, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(self.depth):
            inside = place + step < len(codes)
            place, node = place[inside], node[inside]
            key = node << 21 | codes[place + step]
            at = np.searchsorted(self.keys, key)
            on = self.keys[at] == key
            place, node = place[on], self.nodes[at[on]]
            if not len(place):
                break
            end = self.ends[node]
            some = end >= 0
            places.append(place[some])
            found.append(end[some])
        return np.concatenate(places), np.concatenate(found)


def _slices(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of whole texts, about SLICE at a time, and each code's text; a longer text in parts that overlap by less than a name."""
    held, whose, size = [], [], 0
    for i, t in enumerate(texts):
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        for low in range(0, max(len(codes), 1), SLICE):
            part = codes[low : low + SLICE + overlap]
            held += [part, np.array([BREAK])]
            whose.append(np.full(len(part) + 1, i))
            size += len(part)
            if size >= SLICE:
                yield np.concatenate(held), np.concatenate(whose)
                held, whose, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(whose)


def _found(batches: Iterator[pa.RecordBatch], trie: Trie, rank: np.ndarray, ords: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, best, n): the ord of the best name and how many different ones occur."""
    by_rank = np.empty(len(rank), np.int64)
    by_rank[rank] = np.arange(len(rank))
    for batch in batches:
        best, n = np.full(batch.num_rows, len(rank)), np.zeros(batch.num_rows, np.int64)
        seen = np.zeros(0, np.int64)
        for codes, whose in _slices(batch.column(1).to_pylist(), max(trie.depth - 1, 0)):
            place, name = trie.occurrences(codes)
            np.minimum.at(best, whose[place], rank[name])
            seen = np.union1d(seen, whose[place] * len(rank) + name)
        if len(seen):
            n += np.bincount(seen // len(rank), minlength=batch.num_rows)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(ords[by_rank[best[hit]]], pa.int64()), pa.array(n[hit], pa.int64())], ["key", "best", "n"])


def named_in(texts: DataFrame, names: DataFrame, key: str, text: str = "text", letters: int = LETTERS) -> DataFrame:
    """key, ord, name, n_names: of each text that holds a name, the longest (of equally long ones the least ord) and the number of different ones.

    names: (ord long, name), a name once; null and empty ones are passed over. key tells texts apart.
    """
    text_batches(texts.sparkSession)
    there = names.where(F.length("name") > 0).select(F.col("ord").cast("long").alias("ord"), "name")
    total = there.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = max(1, -(-total // letters))
    told = None
    for part in range(parts):
        mine = there.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).orderBy("ord").collect()  # about ``letters`` letters
        trie = Trie([r["name"] for r in mine])
        ords = np.array([r["ord"] for r in mine], np.int64)
        rank = np.empty(len(mine), np.int64)
        rank[np.lexsort((ords, [-len(r["name"]) for r in mine]))] = np.arange(len(mine))
        shipped = texts.sparkSession.sparkContext.broadcast((trie, rank, ords))
        schema = f"key {texts.schema[key].dataType.simpleString()}, best long, n long"
        one = spread(texts.select(key, text)).mapInArrow(lambda it, s=shipped: _found(it, *s.value), schema)
        told = one if told is None else told.unionByName(one)
    best = told.join(there, told["best"] == there["ord"]).select("key", "n", "ord", "name")
    if parts > 1:
        first = F.min_by(F.struct("ord", "name"), F.struct(-F.length("name"), F.col("ord")))
        best = best.groupBy("key").agg(F.sum("n").alias("n"), first.alias("b")).select("key", "n", "b.ord", "b.name")
    return best.select(F.col("key").alias(key), "ord", "name", F.col("n").alias("n_names"))
