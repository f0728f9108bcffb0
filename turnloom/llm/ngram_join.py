"""N-gram Jaccard self-join by filters under several global token orders, up to connected components.

Sets are the distinct k-word shingles of the lower-cased text. Under any total order of shingles, two
sets of Jaccard t or more share a shingle among the first n - ceil(t n) + 1 of each. Three orders are used:
all put shingles frequent in a sample of the documents last, by rising frequency, and break ties by three different
hashes. The first order's prefixes give the candidates; those must also share a prefix shingle under
the second and the third order, and pass the sizes' and a bitmap's bounds, before the sets are compared.
The orders steer speed only: any order is exact.

Copies: texts with equal sets form one class, joined as its least doc_id. Near copies: pairs within large
buckets are not all made. Round 1 compares each bucket's members with its least document; round 2, in
buckets that still hold several components, with up to 16 of its members. Round 3 makes all pairs
that are still in different components, within parts by the second order's prefix shingles (of which a link shares one as
well) where a bucket is very large, so no link between components is lost. Links within a component don't
change the components.

Scale: the text is read once for the sketches and once a round for the documents still in question. What is
shuffled is prefix shingles (a tenth of the set, hashed), once, then the few pairs that pass the bounds with
their sets. Buckets of more than ``heavy`` documents are found beforehand (by counts of 65,536 cells of tokens) and cut
by hash of the document into parts, in every join on the token. The frequent list (at most ``most_frequent``
hashes) is all that reaches the driver; 65,536 cells are the largest table that is always broadcast.

Defined cases: null and wordless texts have the empty set, no link, and are their own component; fewer than
k words are one shingle; rows with the same doc_id count as one document whose links are joined, each with its own
n_shingles; rows without doc_id have no component and link with nothing; equal rows are all returned; an empty
table gives an empty table; texts are read whole, one at a time beyond 256 KB; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from turnloom.llm.components import connected
from turnloom.llm.shingle_sets import Shingler, mix
from turnloom.session import small, spread, staged, text_batches

SAMPLE, MOST_FREQUENT, PIVOTS, BITS, CLASS, FIRST, CELLS, HEAVY = 16, 524_288, 16, 512, 1.5, 8, 65_536, 1000
_U = np.uint64


def _prefix(s: np.ndarray, rank: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles in an order, and any that tie with the last."""
    n = len(s)
    k = n - (percent * n + 99) // 100 + 1
    key = (rank << _U(48)) | (mix(s, order) >> _U(16))
    return s[key <= np.partition(key, k - 1)[k - 1]]


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of a hash; two shingles that fall together only add candidates."""
    return np.unique((tokens >> _U(32)).astype(np.uint32).view(np.int32))


def _buckets(tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Bucket keys of prefix shingles: the shingle and a class of set sizes, CLASS times wide. A set that may link with
    larger ones of the next class stands there too, so any two that link meet under each shingle they share."""
    at = int(np.floor(np.log(n) / np.log(CLASS) + 1e-9))
    classes = [at]
    while CLASS ** (classes[-1] + 1) * percent / 100 <= n * (1 + 1e-9):
        classes.append(classes[-1] + 1)
    return _short(np.concatenate([mix(tokens, 31 + c) for c in classes]))


def _bitmap(s: np.ndarray, places: int) -> np.ndarray:
    """Parities of the set's shingles over a power of two of places: the bits in which two sets' maps differ bound their difference from below."""
    return np.packbits((np.bincount((mix(s, 21) & _U(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8))


def _wide(s: np.ndarray) -> bytes:
    """A map of two to four bits a shingle, BITS at least: a sixteenth or less of the set itself."""
    return _bitmap(s, max(BITS, 2 << max(0, len(s) - 1).bit_length())).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two maps differ, the longer one folded to the shorter's places."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def frequent(docs: DataFrame, k: int, sample: int = SAMPLE, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes on two or more of every ``sample``-th document (by hash), ascending, with their counts; the ``most`` most frequent."""
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for s in shingler.sets(batch.column(0).slice(at, 64).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    counted = chosen.select("text").mapInArrow(cut, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 2")
    found = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h = found.column("h").to_numpy().view(_U)
    n = found.column("n").to_numpy().astype(_U)
    at = np.argsort(h)
    return h[at], np.minimum(n[at], _U(65535))


def sketches(docs: DataFrame, k: int, percent: int, sample: int = SAMPLE, most: int = MOST_FREQUENT) -> DataFrame:
    """uid, doc_id, n, sig (null for empty sets), p1 (bucket keys of the first order's prefix), p2, p3 (prefixes), bits and wide (maps)."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs, k, sample, most))  # bounded by ``most``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shipped.value
        shingler = Shingler(k)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n, sig, p, bits, wide = [], [], ([], [], []), [], []
                for s in shingler.sets(part.column(1).to_pylist()):
                    n.append(len(s))
                    if not len(s):
                        for x in (sig, *p, bits, wide):
                            x.append(None)
                        continue
                    rank = np.zeros(len(s), _U)
                    if len(hashes):
                        i = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        rank = np.where(hashes[i] == s, counts[i], _U(0))
                    sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    p[0].append(_buckets(_prefix(s, rank, 11, percent), len(s), percent))
                    for j in (1, 2):
                        p[j].append(_short(_prefix(s, rank, 11 + j, percent)))
                    bits.append(_bitmap(s, BITS).view(np.int64))
                    wide.append(_wide(s))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), *(pa.array(x, ints) for x in p), pa.array(bits, longs), pa.array(wide, pa.binary())], ["doc_id", "n", "sig", "p1", "p2", "p3", "bits", "wide"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, sig binary, p1 array<int>, p2 array<int>, p3 array<int>, bits array<long>, wide binary")
    return made.withColumn("uid", F.monotonically_increasing_id())


def _may_link(a: str, b: str, percent: int) -> Column:
    """Bounds on the sizes and on the symmetric difference, exact for any two sets that link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(f"{a}.bits", F.lit(0)).bitwiseXOR(F.get(f"{b}.bits", F.lit(0)))))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ * (100 + percent) <= (100 - percent) * (na + nb))


def _salts(parts: str = "parts") -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("salt")


def _buckets_of(entries: DataFrame, counted: DataFrame, heavy: int) -> DataFrame:
    """entries: (token, doc_id), rows distinct. token, doc_id, m, first, salt, parts of every bucket of two documents or more: its size, its
    least document, and the part of it that holds the row. counted: (token), the entries' or more of them, cheaper to scan."""
    cell = F.pmod(F.xxhash64("token"), F.lit(CELLS)).alias("cell")
    cells = staged(counted.select(cell).groupBy("cell").agg(F.count("*").alias("c")), "cells")
    total = cells.agg(F.sum("c")).first()[0] or 0
    crowded = staged(cells.where(F.col("c") > heavy + total / CELLS).select("cell"), "crowded")  # CELLS rows at most
    one = lambda x: F.lit(x).cast("int")
    w = Window.partitionBy("token")
    placed = entries.select("token", "doc_id", cell)
    light = placed.join(F.broadcast(crowded), "cell", "left_anti").select("token", "doc_id", F.count("*").over(w).alias("m"), F.min("doc_id").over(w).alias("first")).where("m >= 2")
    light = light.select("*", one(0).alias("salt"), one(1).alias("parts"))
    rest = staged(placed.join(F.broadcast(crowded), "cell", "left_semi").select("token", "doc_id"), "crowded-entries")
    sizes = rest.groupBy("token").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m >= 2")
    sizes = staged(sizes.withColumn("parts", F.ceil(F.col("m") / heavy).cast("int")), "sizes")
    large = small(staged(sizes.where("parts > 1").select("token", F.col("parts").alias("cuts")), "large"))
    own = F.when(F.col("cuts").isNull(), one(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    salted = rest.join(large, "token", "left").select("token", "doc_id", own.alias("salt"))
    return light.unionByName(salted.join(sizes.select("token", "m", "first", "parts", _salts()), ["token", "salt"]))


def _still_open(buckets: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The rows (token, doc_id, salt, parts, label) of buckets that hold several components."""
    marked = buckets.select("token", "doc_id", "salt", "parts").join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    open_ = marked.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("parts").alias("parts")).where("x <> y").select("token", _salts())
    return staged(marked.join(open_, ["token", "salt"], "left_semi"), f"open-{name}")


def _ids(pairs: DataFrame) -> DataFrame:
    return staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "asked")


def _verified(pairs: DataFrame, docs: DataFrame, all_: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose wide maps allow it, that share a prefix shingle under orders 2
    and 3 as well, and whose sets then have the Jaccard."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y, sizes = (part.column(i).to_pylist() for i in (2, 3, 4))
                keep = [(100 + percent) * _differ(x[i], y[i]) <= (100 - percent) * sizes[i] for i in range(len(x))]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def with_both(pairs: DataFrame, *wanted: str) -> DataFrame:
        """pairs with the columns of a and b from the sketches; only the documents in question are read off."""
        own = staged(heads.join(small(_ids(pairs)), "doc_id", "left_semi"), "own")
        held = staged(all_.select("uid", *wanted).join(small(own), "uid").drop("uid"), "held")
        side = lambda x: held.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in wanted])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    met = with_both(staged(pairs, "pairs"), "n", "wide")
    fitting = staged(met.select("a", "b", "wide_a", "wide_b", (F.col("n_a") + F.col("n_b")).alias("sizes")).mapInArrow(screen, "a long, b long").distinct(), "fitting")
    both = F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    pairs = staged(with_both(fitting, "p2", "p3").where(both).select("a", "b").distinct(), "candidates")
    ids = _ids(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingler.sets(part.column(1).to_pylist())], pa.binary())], ["doc_id", "s"])

    sets = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").mapInArrow(cut, "doc_id long, s binary"), "sets")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                keep = []
                for i in range(len(x)):
                    u, v = np.frombuffer(x[i], _U), np.frombuffer(y[i], _U)
                    shared = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(u) + len(v) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return asked.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, sample: int = SAMPLE, pivots: int = PIVOTS, heavy: int = HEAVY) -> DataFrame:
    """docs: (doc_id, text). Returns doc_id, n_shingles, component_id for every row."""
    text_batches(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    all_, heads_of = _classes_and_components(docs, k, percent, sample, pivots, heavy)
    return all_.select("doc_id", "n", "sig").join(heads_of, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _classes_and_components(docs: DataFrame, k: int, percent: int, sample: int, pivots: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (sig, head, component) of every set that occurs: its least document and its component."""
    all_ = staged(sketches(docs, k, percent, sample), "sketches")
    classes = staged(all_.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "uid")).alias("h")).select("sig", F.col("h.doc_id").alias("head"), F.col("h.uid").alias("uid")), "classes")
    # A class is joined as its head. Rows of one doc_id with different sets tie their classes together.
    split = all_.where("sig is not null and doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("x"), F.max("sig").alias("y")).where("x <> y").select("doc_id")
    split = all_.join(split, "doc_id", "left_semi").join(classes.select("sig", "head"), "sig").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    heads = classes.select("uid", F.col("head").alias("doc_id"))
    narrow = lambda *c: all_.select("uid", *c).join(heads, "uid")

    # Everything that shares a prefix shingle with another document. Two heads of one doc_id are one member.
    entries = narrow("p1").select(F.explode("p1").alias("token"), "doc_id")
    buckets = staged(_buckets_of(entries, all_.select(F.explode("p1").alias("token")), heavy), "buckets")
    own = buckets.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRST).alias("tokens"))  # of as many as a prefix has
    marks = staged(own.join(narrow("n", "bits"), "doc_id").select("doc_id", "n", "bits", "tokens"), "marks")

    # Round 1: each bucket against its least document.
    star = buckets.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    x, y = (marks.select(F.col("doc_id").alias(s), F.struct("n", "bits").alias(f"m{s}")) for s in "ab")
    star = star.join(x, "a").join(y, "b").where(_may_link("ma", "mb", percent)).select("a", "b").distinct()
    links = staged(_verified(star, docs, all_, heads, k, percent).union(split), "links-1")
    labels = connected(links)

    # A pair that shares one of its first tokens meets in the first such bucket only.
    shared = F.array_min(F.array_intersect("a.tokens", "b.tokens"))
    meets = F.coalesce(shared >= F.col("a.token"), F.lit(True)) & (F.col("a.label") != F.col("b.label")) & _may_link("a", "b", percent)
    ordered = (F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))

    # Round 2: buckets of more than two documents (two are done) against up to ``pivots`` of their members.
    rows = _still_open(buckets.where("m > 2"), labels, "2")
    w = Window.partitionBy("token").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = rows.withColumn("r", F.row_number().over(w)).where(f"r <= {pivots}").select("token", "doc_id", "label", _salts())
    met = few.join(marks, "doc_id").alias("a").join(rows.join(marks, "doc_id").alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.doc_id") != F.col("b.doc_id")) & meets)
    more = staged(_verified(met.select(*ordered).distinct(), docs, all_, heads, k, percent), "links-2")
    if not more.isEmpty():
        links = links.union(more)
        labels = connected(links)

    # Round 3: larger buckets, all pairs of different components; those beyond ``heavy`` are parted by the second prefixes first.
    rows = _still_open(buckets.where(f"m > {pivots + 1}"), labels, "3")
    whole = rows.where("parts = 1").select("token", "doc_id", "label").join(marks, "doc_id")
    same = (F.col("a.token") == F.col("b.token")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = whole.alias("a").join(whole.alias("b"), same & meets).select(*ordered)
    large = rows.where("parts > 1").select("token", "doc_id")
    if not large.isEmpty():
        second = narrow("p2").join(small(staged(large.select("doc_id").distinct(), "in-question")), "doc_id", "left_semi").select("doc_id", "p2")
        parted = staged(large.join(second, "doc_id").select("token", F.explode("p2").alias("q"), "doc_id").select(F.xxhash64("token", "q").alias("token"), "doc_id").distinct(), "parted")
        fine = _still_open(staged(_buckets_of(parted, parted.select("token"), heavy), "fine"), labels, "fine").join(marks, "doc_id")
        every = fine.drop("salt").select("*", _salts())  # one side in all parts; pairs that meet twice fall together by distinct()
        apart = (F.col("a.salt") == F.col("b.salt")) & (F.col("a.label") != F.col("b.label")) & _may_link("a", "b", percent)
        pairs = pairs.union(fine.alias("a").join(every.alias("b"), same & apart).select(*ordered))
    more = staged(_verified(pairs.distinct(), docs, all_, heads, k, percent), "links-3")
    if not more.isEmpty():
        labels = connected(links.union(more))
    return all_, classes.join(labels.select(F.col("node").alias("head"), "label"), "head", "left").select("sig", "head", F.coalesce("label", "head").alias("component"))


def _distinct_ids(rows: DataFrame) -> DataFrame:
    return staged(rows.select("doc_id").distinct(), "in-question")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one whose doc_id names it. The columns of ``docs``.

    Rows of one doc_id with different texts are documents of their own here: the text of the least MD5 bears the doc_id, the others come behind
    all documents in the order of representatives, and one goes only if a text that it is linked with stays. Of rows equal in doc_id and text one stays, the least by
    hash of all columns. Rows without doc_id stay; null and wordless texts are linked with nothing."""
    again = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "repeated-ids")
    gone_of = lambda found, key: staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "near-copies")
    if again.isEmpty():
        return docs.join(gone_of(near_components(docs, k, percent), "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    single = docs.join(again, "doc_id", "left_anti")
    rows = docs.join(again, "doc_id", "left_semi").select("doc_id", F.md5("text").alias("h"), F.struct(*docs.columns).alias("r"), F.xxhash64(*docs.columns).alias("o"))
    rows = staged(rows.groupBy("doc_id", "h").agg(F.min_by("r", "o").alias("r")), "repeated-rows")
    top = docs.agg(F.max("doc_id")).first()[0]
    rows = staged(_ranked(rows.select("doc_id", "h"), top).join(rows.select("doc_id", F.coalesce("h", F.lit("")).alias("h"), "r"), ["doc_id", "h"]), "renamed-rows")
    found = near_components(single.select("doc_id", "text").union(rows.select("own_id", "r.text")), k, percent)
    gone = gone_of(found, "own_id")
    kept = rows.join(gone, "own_id", "left_anti").select("r.*")
    return single.join(gone.withColumnRenamed("own_id", "doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(kept)


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """doc_id, h, own_id: the doc_id for its least h, for others numbers above ``top`` in the order of (doc_id, h), in two phases: range
    partitions, then offsets of one row a partition."""
    order = ["doc_id", "h"]
    ranged = staged(rows.select("doc_id", F.coalesce("h", F.lit("")).alias("h")).repartitionByRange(*order).withColumn("p", F.spark_partition_id()), "ranged")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("p").agg(F.count("*").alias("c")).select("p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(*order)) + F.col("o")
    least = ranged.groupBy("doc_id").agg(F.min("h").alias("least"))
    numbered = ranged.join(F.broadcast(offsets), "p").select(*order, (place + top).cast("long").alias("n"))
    return numbered.join(least, "doc_id").select(*order, F.when(F.col("h") == F.col("least"), F.col("doc_id")).otherwise(F.col("n")).alias("own_id"))
