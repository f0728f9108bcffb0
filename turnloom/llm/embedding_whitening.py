"""Whitening of embeddings: projections on the leading components of their covariance, scaled to unit variance.

Each entry c becomes the whole number floor(256 c). The fit list holds each distinct vector once. Its mean and centred
products are gathered by Welford's updates, one of rank one for each vector, in iterators over the partitions; the partitions' states are merged by the
parallel update formula in groups of FAN, level by level, so that no task and not the driver holds more than FAN of them.
The covariance (divisor n) is solved on the driver by symmetric QR: Householder reflections to a tridiagonal matrix, then
implicit QR steps with Wilkinson's shift. Sums are exact; a second pass over the fit list measures the whitened covariance.

Scale: one shuffle, of the vectors for their distinct values, which are folded on the map side first, so one very common vector costs a row a task; the fit
list is written once. Everything else is passes over rows. States are d + d * d doubles, whatever the number of rows.

Defined cases: vectors that are null, or hold null or non-finite entries, give no row, and neither do empty ones and those of
another length than most; repeated rows, and rows of one id, give results each, and count once in the fit list; a null id stays null; vectors of fewer dimensions than
components have as many components; a component without variance (one distinct vector, say) has whitened null and takes no part
in identity_error, which is null if there is no other; deviation is null where it exceeds a long; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.integer_vectors import commonest_length, finite, whole
from turnloom.session import staged, text_batches

FAN = 16
STATE = "at int, n long, sums array<decimal(38,0)>, mean array<double>, products array<double>"


@dataclass
class Moments:
    """Number, exact sums, mean and centred products of vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, object), np.zeros(d), np.zeros((d, d)))

    def take_each(self, x: np.ndarray) -> None:
        """Welford's update for every row: the products grow by a matrix of rank one."""
        n, mean, products, step = self.n, self.mean, self.products, np.empty_like(self.products)
        for row in x.astype(float):
            n += 1
            row -= mean
            np.multiply(row[:, None], row * ((n - 1) / n), out=step)
            products += step
            row /= n
            mean += row
        self.n = n

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if other.n:
            gap = other.mean - self.mean
            self.products += other.products + np.outer(gap, gap) * (self.n * other.n / n)
            self.mean += gap * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, at: int) -> dict:
        return {"at": [at], "n": [self.n], "sums": [[Decimal(int(s)) for s in self.sums]], "mean": [self.mean.tolist()], "products": [self.products.ravel().tolist()]}


def _sums(x: np.ndarray) -> np.ndarray:
    wide = len(x) and max(int(x.max()), -int(x.min())) * len(x) >= 1 << 62
    return (x.astype(object) if wide else x).sum(0).astype(object)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def moments(vectors: DataFrame, column: str, d: int, values=None) -> Moments:
    """Moments of a column of vectors of d long entries; of ``values(x)``, d numbers a row, if given, block by block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Moments.empty(d)
        for batch in batches:
            if not batch.num_rows:
                continue
            if values is None:
                x = _matrix(batch.column(0), d)
                mine.take_each(x)
                mine.sums = mine.sums + _sums(x)
            else:
                y = values(batch.column(0))
                mean = y.mean(0)
                mine.merge(Moments(len(y), np.zeros(d, object), mean, (y - mean).T @ (y - mean)))
        row = mine.row(TaskContext.get().partitionId())
        row["sums"] = pa.array(row["sums"], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_pydict(row, pa.schema([("at", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))]))

    def fold(states: pd.DataFrame) -> pd.DataFrame:
        total = Moments.empty(d)
        for s in states.sort_values("at").itertuples():
            total.merge(Moments(s.n, np.array([int(v) for v in s.sums], object), np.array(s.mean), np.array(s.products).reshape(d, d)))
        return pd.DataFrame(total.row(int(states["at"].min()) // FAN))

    one = vectors.select(column)
    parts = one.rdd.getNumPartitions()
    states = one.mapInArrow(gather, STATE)
    while parts > 1:
        states = states.groupBy(F.floor(F.col("at") / FAN).alias("group")).applyInPandas(fold, STATE)
        parts = -(-parts // FAN)
    out = Moments.empty(d)
    for s in states.collect():  # one row of d + d * d numbers; none from an empty table
        out.merge(Moments(s.n, np.array([int(v) for v in s.sums], object), np.array(s.mean), np.array(s.products).reshape(d, d)))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: diagonal, its neighbours, and the transposed transformation of a symmetric matrix."""
    a, n = a.copy(), len(a)
    turned = np.eye(n)
    nothing = np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)  # reflecting what is lost in rounding would lose the angles
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size <= nothing:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        turned[k + 1 :] -= 2 * np.outer(v, v @ turned[k + 1 :])
    return a.diagonal().copy(), a.diagonal(-1).copy(), turned


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows."""
    d, e, q = tridiagonal(a)
    tiny = np.finfo(float).eps
    least = tiny * tiny * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    end = len(d) - 1
    while end > 0:
        joined = np.abs(e[:end]) > np.maximum(tiny * (np.abs(d[:end]) + np.abs(d[1 : end + 1])), least)
        if not joined[end - 1]:
            e[end - 1] = 0
            end -= 1
            continue
        apart = np.flatnonzero(~joined)
        begin = int(apart[-1]) + 1 if len(apart) else 0
        half = (d[end - 1] - d[end]) / 2
        x = d[begin] - (d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half)))
        z = e[begin]
        for k in range(begin, end):  # the bulge runs down
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            p, m, g = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * m + s * s * g, s * s * p - 2 * c * s * m + c * c * g
            e[k] = c * s * (g - p) + (c * c - s * s) * m
            x = e[k]
            if k + 1 < end:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    q = q[order]
    return d[order], q / np.linalg.norm(q, axis=1, keepdims=True)


@dataclass
class Whitening:
    """A fitted whitening: n, exact sums, the components with their variances, and the checks."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        return self.variances > self.components.shape[1] * np.finfo(float).eps * self.total

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact."""
        most = max((abs(int(s)) for s in self.sums), default=0)
        if len(x) and self.n * max(int(x.max()), -int(x.min())) + most >= 1 << 62:
            return self.n * x.astype(object) - self.sums
        return self.n * x - self.sums.astype(np.int64) if len(x) else x

    def whitened(self, gaps: np.ndarray) -> np.ndarray:
        """A row each, a column for each component with variance."""
        fine = self.usable()
        return (gaps / self.n).astype(float) @ (self.components[fine] / np.sqrt(self.variances[fine])[:, None]).T


def deviations(gaps: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond a long."""
    if not len(gaps):
        return []
    most = max(int(gaps.max()), -int(gaps.min()))
    if most * most * gaps.shape[1] < 1 << 63:
        return (gaps * gaps).sum(1).tolist()
    sums = (gaps.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, vector: str, components: int = 4) -> Whitening | None:
    """The whitening of a column of vectors; None where no vector takes part."""
    text_batches(vectors.sparkSession)
    d = commonest_length(vectors.where(finite(F.col(vector))), vector)
    if not d:
        return None
    xs = vectors.where(finite(F.col(vector)) & (F.size(vector) == d)).select(whole(F.col(vector)).alias("x"))
    xs = staged(xs.distinct(), "whitening-fit")
    m = moments(xs, "x", d)
    values, rows = symmetric_qr(m.products / m.n)
    found = Whitening(m.n, m.sums, rows[:components], np.maximum(values[:components], 0), float(m.products.trace()) / m.n)
    k = int(found.usable().sum())
    if k:
        check = moments(xs, "x", k, lambda x: found.whitened(found.gaps(_matrix(x, d))))
        found.identity_error = float(np.abs(check.products / check.n - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, model: Whitening, vector: str, into: str) -> DataFrame:
    """The rows that take part, with a struct in column ``into``: deviation, and whitened, an array with an entry a component."""
    d, fine = model.components.shape[1], model.usable()

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(xs: pd.Series) -> pd.DataFrame:
        gaps = model.gaps(np.stack(xs.to_list()) if len(xs) else np.zeros((0, d), np.int64))
        out = np.full((len(xs), len(fine)), None, object)
        out[:, fine] = model.whitened(gaps)
        return pd.DataFrame({"deviation": pd.array(deviations(gaps), "Int64"), "whitened": out.tolist()})

    v = F.col(vector)
    return vectors.where(finite(v) & (F.size(v) == d)).withColumn(into, project(whole(v)))


def whitening_report(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    model = fit(rows, "v", components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share: Column = F.array(*[F.lit(float(e) / model.total if model.total > 0 else None).cast("double") for e in model.variances])
    each = whiten(rows, model, "v", "w").select("vec_id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
