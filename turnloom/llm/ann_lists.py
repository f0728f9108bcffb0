"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample, split at medians until every list is equally full and then moved to
their members' means. A nearest-neighbour graph over the centroids is held in memory; searches walk it
from fixed entry points, opening every centroid within the bound of the best seen. A vector is posted to
its nearest list and, if it lies near a boundary, to the next ones as well. A query reads the lists whose
centroid lies within ``ratio`` of its nearest one; the ratio is the smallest that finds ``target`` of the
true neighbours within the sample, for queries that centroids were made from as well as for others.

The number of lists grows with the table: beyond the lists that the sample gives, about the square root of the number of
vectors. Then the sample's centroids part the vectors coarsely, and each part's own bounded sample (16 vectors a list, by hash) is split into
its lists on the executors; the centroids that come back (at most ``most_lists``) replace the coarse ones.

Only centroids, graph and ratio depend on samples; every row is posted. Of equal vectors the k + 1
least vec_ids are posted: no other can be among k nearest with ties to the smaller id, so nothing is lost,
and a vector that a third of the rows repeat does not swell a list. Lists that are large all the same are cut
by hash into blocks, their queries too, so that a task meets one block of each.

Scores are Euclidean distances in double precision on the original vectors.

Defined cases: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part (there is no distance between different lengths), nor do rows without id; a row repeated whole counts once; a query never returns its own
id; fewer candidates than k give fewer rows; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import staged

SAMPLE, LIST_SAMPLE, REPLICAS, BOUNDARY, TARGET, BLOCK, MOST_LISTS = 16_384, 16, 3, 1.05, 0.96, 4096, 65_536
RATIOS = (*(1 + i / 50 for i in range(1, 31)), 2.0, 3.0, 1e9)


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _balanced(x: np.ndarray, size: int) -> np.ndarray:
    """Means of equal parts: split at the median of the widest direction until at most ``size`` rows are left."""
    parts, done = [np.arange(len(x))], []
    while parts:
        p = parts.pop()
        if len(p) <= size:
            done.append(x[p].mean(0))
            continue
        y = x[p] - x[p].mean(0)
        way = y[np.argmax((y * y).sum(1))]
        for _ in range(3):
            way = y.T @ (y @ way)
            way /= np.linalg.norm(way) or 1.0
        order = np.argsort(y @ way, kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    return np.array(done)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def _neighbours(c: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest others of every row, in blocks of bounded memory."""
    out = np.empty((len(c), degree), np.int64)
    step = max(1, (1 << 22) // len(c))
    for at in range(0, len(c), step):
        d = _squares(c[at : at + step], c)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near = np.argpartition(d, degree - 1, 1)[:, :degree] if degree < len(c) - 1 else np.argsort(d, 1, kind="stable")[:, :degree]
        out[at : at + step] = near
    return out


class Index:
    """Centroids, their graph, and the probing ratio; shipped to every task. fine: centroids to use in place of the sample's own."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5, list_sample: int = LIST_SAMPLE, target: float = TARGET, fine: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        x = np.unique(sample, axis=0)
        x = x[rng.permutation(len(x))]
        half = x[: max(1, (len(x) + 1) // 2)]
        if fine is None:
            c = _balanced(half, list_sample)
            for _ in range(3):  # means of members; an emptied list keeps its place
                near = np.argmin(_squares(half, c), 1)
                n = np.bincount(near, minlength=len(c))
                total = np.zeros_like(c)
                np.add.at(total, near, half)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        else:
            c = fine
        self.c = c
        degree = min(len(c) - 1, 24)
        links = [set() for _ in range(len(c))]
        for i, row in enumerate(_neighbours(c, degree).tolist() if degree else []):  # edges in both directions, so that every centroid can be reached from its neighbours
            for j in row:
                links[i].add(j)
                links[j].add(i)
        width = max((len(s) for s in links), default=0)
        width = min(width, 4 * degree) if degree else 0  # a hub keeps its own and the first others; they reach it all the same
        self.graph = np.array([sorted(s)[:width] + [i] * (width - len(s)) for i, s in enumerate(links)], np.int64).reshape(len(c), width)
        self.entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), max(16, math.isqrt(len(c))))).astype(np.int64))
        self.rows = max(8, min(256, (1 << 22) // len(c)))  # searched at a time
        self.ratio = self._tune(x, len(half), k, target)

    def search(self, x: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the centroids met, else inf, by walking the graph; and which lie within the bound."""
        q, n = len(x), len(self.c)
        d = np.full((q, n), np.inf)
        d[:, self.entries] = np.sqrt(_squares(x, self.c[self.entries]))
        opened = np.zeros((q, n), bool)
        while True:
            bound = np.partition(d, min(least, n) - 1, 1)[:, min(least, n) - 1]
            bound = np.maximum(bound, d.min(1) * ratio)
            todo = (d <= bound[:, None]) & ~opened
            if not todo.any():
                return d, d <= bound[:, None]
            opened |= todo
            r, c = np.nonzero(todo)
            r, c = np.repeat(r, self.graph.shape[1]), self.graph[c].ravel()
            new = np.isinf(d[r, c])
            key = np.unique(r[new] * n + c[new])
            r, c = key // n, key % n
            for at in range(0, len(r), 65_536):
                i, j = r[at : at + 65_536], c[at : at + 65_536]
                diff = x[i] - self.c[j]
                d[i, j] = np.sqrt((diff * diff).sum(1))

    def posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every posting."""
        d, _ = self.search(x, BOUNDARY, REPLICAS)
        order = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        best = np.take_along_axis(d, order, 1)
        keep = (best <= best[:, :1] * BOUNDARY) & np.isfinite(best)
        r, j = np.nonzero(keep)
        return r, order[r, j]

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, near = self.search(x, self.ratio, 2)
        return np.nonzero(near)

    def _tune(self, x: np.ndarray, made_from: int, k: int, target: float) -> float:
        """The least ratio with the wanted recall over the sample, for rows that made centroids as for rows that didn't."""
        if len(x) - made_from <= k or len(self.c) == 1:
            return RATIOS[-1]
        asked = np.concatenate((np.arange(min(made_from, 192)), np.arange(made_from, min(len(x), made_from + 192))))
        made = asked < made_from
        queries = x[asked]
        d = _squares(queries, x)
        d[np.arange(len(asked)), asked] = np.inf
        true = np.argsort(d, 1)[:, :k]
        member = np.zeros((len(x), len(self.c)), bool)
        for at in range(0, len(x), self.rows):
            r, c = self.posted(x[at : at + self.rows])
            member[r + at, c] = True
        for ratio in RATIOS:
            near = np.concatenate([self.search(queries[at : at + self.rows], ratio, 2)[1] for at in range(0, len(queries), self.rows)])
            found = np.array([(member[true[i]] & near[i]).any(1).mean() for i in range(len(queries))])
            found = min(found[made].mean(), found[~made].mean())
            if found >= target:
                return ratio
        return RATIOS[-1]


def _routed(vectors: DataFrame, index, queries: bool) -> DataFrame:
    """(id, v) to (list, id, v): a row for each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, ix.rows):
                part = batch.slice(at, ix.rows)
                x = np.array(part.column(1).to_pylist(), float)
                r, c = ix.probed(x) if queries else ix.posted(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r))], ["list", "id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "list long, id long, v array<double>")


def _fine_centroids(vectors: DataFrame, index, quota: int, per_list: int = LIST_SAMPLE) -> np.ndarray:
    """``quota`` centroids a coarse list: each vector goes to its nearest list, whose first quota * per_list by hash are split evenly. What
    a task holds and what reaches the driver is bounded by the quota."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, ix.rows):
                part = batch.slice(at, ix.rows)
                d, _ = ix.search(np.array(part.column(1).to_pylist(), float), 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.argmin(d, 1)), part.column(0), part.column(1)], ["list", "id", "v"])

    w = Window.partitionBy("list").orderBy(F.xxhash64("id"), "id")
    routed = vectors.select("id", "v").mapInArrow(run, "list long, id long, v array<double>")
    chosen = routed.withColumn("r", F.row_number().over(w)).where(f"r <= {quota * per_list}").select("list", "v")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": list(_balanced(np.unique(np.stack(rows["v"].to_list()), axis=0), per_list))})

    return np.array([r["c"] for r in chosen.groupBy("list").applyInPandas(split, "c array<double>").collect()], float)


def _in_blocks(routed: DataFrame, sizes: DataFrame, mine: str, other: str) -> DataFrame:
    """Cuts large lists: a row goes to one block of its own side and to every block of the other side."""
    own = F.pmod(F.xxhash64("id"), F.col(mine))
    return routed.join(sizes, "list").withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("list", F.col("mine").alias(mine), F.col("other").alias(other), "id", "v")


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, sample: int = SAMPLE, target: float = TARGET, lists: int | None = None, most_lists: int = MOST_LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that ``queries`` selects, among all rows.
    lists: how many there should be at least; by default the square root of the number of vectors, ``most_lists`` at most."""
    found, _ = search(vectors, queries, vec_id, embedding, k, sample, target, lists, most_lists)
    return found


def search(vectors: DataFrame, queries: Column, vec_id: str, embedding: str, k: int, sample: int = SAMPLE, target: float = TARGET, lists: int | None = None, most_lists: int = MOST_LISTS) -> tuple[DataFrame, DataFrame | None]:
    """nearest(), and (list, pb, qb, n_posted, n_asked) of every list that is read."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    valid = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("asked")).where(F.col("id").isNotNull() & usable(F.col(embedding)))
    rows = valid.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # a bounded sample
    if not rows:
        return spark.createDataFrame([], result), None
    dims = int(np.bincount([len(r[1]) for r in rows]).argmax())
    valid = valid.where(F.size("v") == dims)
    x = np.array([r[1] for r in rows if len(r[1]) == dims], float)
    made = Index(x, k, target=target)
    index = spark.sparkContext.broadcast(made)
    wanted = min(most_lists, lists or math.isqrt(valid.count()))
    if wanted > len(made.c):
        fine = _fine_centroids(valid, index, -(-wanted // len(made.c)))
        index = spark.sparkContext.broadcast(Index(x, k, target=target, fine=fine))

    w = Window.partitionBy("v").orderBy("id")  # limited to k + 1 rows a vector before the shuffle as well
    distinct = valid.select("id", "v").withColumn("r", F.dense_rank().over(w)).where(f"r <= {k + 1}").select("id", "v").distinct()
    posted = staged(_routed(distinct, index, False), "postings")
    asked = staged(_routed(valid.where(F.coalesce("asked", F.lit(False))).select("id", "v").distinct(), index, True), "probes")
    count = lambda df, name, n: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias(name), F.count("*").alias(n))
    sizes = staged(count(posted, "pb", "n_posted").join(count(asked, "qb", "n_asked"), "list"), "list-sizes")  # a row for each centroid
    p = _in_blocks(posted, sizes.select("list", "pb", "qb"), "pb", "qb")
    q = _in_blocks(asked, sizes.select("list", "pb", "qb"), "qb", "pb")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = right["id"].to_numpy(), np.stack(right["v"].to_list())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for own, v in zip(left["id"].to_numpy(), left["v"]):
                diff = x - v
                d = np.sqrt((diff * diff).sum(1))
                d[ids == own] = np.inf
                best = np.lexsort((ids, d))[:k] if len(ids) <= 64 else None
                if best is None:
                    kth = np.partition(d, k - 1)[k - 1]
                    near = np.flatnonzero(d <= kth)
                    best = near[np.lexsort((ids[near], d[near]))][:k]
                best = best[np.isfinite(d[best])]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    keys = ["list", "pb", "qb"]
    met = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), sizes
