"""Vector codes: product quantization of whole-number vectors, every assignment exact.

A vector's entries become floor(256 c) and are cut into equal consecutive parts; each part position has a codebook, which starts
as that part of the first vectors by id and is moved to its members' rounded means in a few rounds.

The nearest entry is found in two steps. A float32 matrix product gives all distances (less the part's own square) of a batch at once, with an
interval around each that no rounding can leave: products of m terms are off by at most m + 3 units of rounding times the two norms, sums
and squares by a few units more. Entries whose interval overlaps the best one's are evaluated again in 64-bit whole numbers (in Python's, where
squares could exceed them), and equal distances go to the lower index. Where float32 overflows, nothing is ruled out.

Scale: rounds + 1 passes over the vectors, no shuffle of vectors. A task emits at most a count and a sum for each entry and dimension, which
Spark adds up; the driver gets the codebooks' size, fixed by the parameters. Codes are written once, and the sums by label joined to them: such a table
is broadcast only while it is small, and labels that a third of the rows hold are folded on the map side.

Defined cases: vectors that are null, or hold null or non-finite entries, give no row, and neither do empty ones and those of
another length than most; repeated rows, and rows of one id, give a result each and count each; a null id stays null and comes last among the first vectors;
equal ids there are ordered by their vectors; fewer vectors than entries give as many entries; equal distances go to the lower index, so repeated entries stay unused; a length that isn't a
multiple of the number of parts makes some parts one longer; errors beyond a long are null; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.integer_vectors import commonest_length, finite, whole
from turnloom.session import staged, text_batches

PARTS, ENTRIES, ROUNDS = 16, 64, 2
UNIT = 2.0**-24


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if squares of their differences fit a long when added up, else as Python's numbers."""
    most = sum(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0)))) for v in (x, y))
    if most * most * x.shape[1] < 1 << 62:
        return x, y
    return x.astype(object), y.astype(object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, ties to the lower one, and the squared distance."""
    p, c = x.astype(np.float32), book.astype(np.float32)
    wide_p, wide_c = x.astype(float), book.astype(float)
    squares = (wide_c * wide_c).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        about = (squares.astype(np.float32) - 2 * (p @ c.T)).astype(float)
        norms = np.sqrt((wide_p * wide_p).sum(1))[:, None] * np.sqrt(squares)
        error = UNIT * ((2 * x.shape[1] + 16) * norms + 4 * squares)
        best = (about + error).min(1, keepdims=True)
        near = ~(about - error > best)  # what is not a number stays
    at = near.argmax(1)
    x, book = _exact(x, book)
    gap = x - book[at]
    found = (gap * gap).sum(1)
    rows = np.flatnonzero(near.sum(1) > 1)
    if len(rows):
        i, j = np.nonzero(near[rows])  # by row, then by index
        gap = x[rows[i]] - book[j]
        distance = (gap * gap).sum(1)
        first = np.flatnonzero(np.diff(i, prepend=-1))
        least = np.minimum.reduceat(distance, first)
        tie = np.where(distance == least[i], j, len(book))
        at[rows], found[rows] = np.minimum.reduceat(tie, first), least
    return at, found


@dataclass
class Codebooks:
    """entries[i] holds the i-th entry of every part, side by side; part p is the columns cuts[p] to cuts[p + 1]."""

    entries: np.ndarray
    cuts: list[int]

    @classmethod
    def begin(cls, first: np.ndarray, parts: int) -> Codebooks:
        d = first.shape[1]
        return cls(first, [p * d // parts for p in range(parts + 1)])

    def slices(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.cuts, self.cuts[1:])]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and squared distances added up over the parts."""
        codes, errors = [], 0
        for part in self.slices():
            at, found = nearest(x[:, part], self.entries[:, part])
            codes.append(at)
            errors = errors + found.astype(object)
        return np.stack(codes, 1), errors

    def sha256(self) -> str:
        numbers = [str(int(v)) for part in self.slices() for row in self.entries[:, part] for v in row]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _member_sums(vectors: DataFrame, books: Codebooks) -> list:
    """(place, entry, members, total) of every entry with members, for each column of the codebooks; vectors: x."""
    k, d = books.entries.shape
    shipped = vectors.sparkSession.sparkContext.broadcast(books)  # k x d numbers

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        members, totals = np.zeros((k, d), np.int64), np.zeros((k, d), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), d)
            codes, _ = books.assign(x)
            if max(int(x.max()), -int(x.min())) * len(x) >= 1 << 62:
                x = x.astype(object)
            for p, part in enumerate(books.slices()):
                order = np.argsort(codes[:, p], kind="stable")
                at, first = np.unique(codes[order, p], return_index=True)
                totals[at, part] += np.add.reduceat(x[order, part], first, 0)
                members[at, part] += np.diff(first, append=len(x))[:, None]
        entry, place = np.nonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(entry, pa.int32()), pa.array(members[entry, place], pa.int64()), pa.array([Decimal(int(t)) for t in totals[entry, place]], pa.decimal128(38, 0))],
            ["place", "entry", "members", "total"],
        )

    sums = vectors.mapInArrow(gather, "place int, entry int, members long, total decimal(38,0)")
    return sums.groupBy("place", "entry").agg(F.sum("members").alias("members"), F.sum("total").alias("total")).collect()  # at most k x d rows


def fit(vectors: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of (vec_id, x), x being d long."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = Codebooks.begin(np.array([r.x for r in first], np.int64), parts)
    for _ in range(rounds):
        moved = books.entries.copy()
        for r in _member_sums(vectors.select("x"), books):
            moved[r.entry, r.place] = int(r.total) // r.members
        books = Codebooks(moved, books.cuts)
    return books


def encode(vectors: DataFrame, books: Codebooks, others: list[str]) -> DataFrame:
    """Columns ``others`` of (x, others...), code and error."""
    d = books.entries.shape[1]
    shipped = vectors.sparkSession.sparkContext.broadcast(books)  # k x d numbers
    kept = vectors.select("x", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = shipped.value.assign(_matrix(batch.column(0), d))
            digits = codes.astype(np.uint8).tobytes().hex()
            width = 2 * codes.shape[1]
            texts = [digits[i : i + width] for i in range(0, len(digits), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], [*others, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}, code string, error long")


def codes_report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part. At most 256 entries, two hexadecimal digits each."""
    if not 0 < entries <= 256:
        raise ValueError("codes have one byte a part")
    text_batches(vectors.sparkSession)
    v = F.col(vector)
    rows = vectors.where(finite(v))
    d = commonest_length(rows, vector)
    if not d:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.where(F.size(v) == d).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(v).alias("x"))
    books = fit(rows, d, parts, entries, rounds)
    coded = staged(encode(rows, books, ["vec_id", "label"]), "vector-codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
