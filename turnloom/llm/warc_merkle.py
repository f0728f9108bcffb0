"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed (SHA-256) and sit at ordered offsets. A node of level l covers the ordered range of
16 ** l offsets and hashes its children's digests in order; the root covers everything. To compare two
replicas only roots are read first; below, only the children of ranges that differ are read and compared,
down to the offsets at which a record is changed, missing or extra.

Scale: a node has at most 16 children, so no group grows; the tree shrinks 16 times a level and is kept in
the shared folder, level by level, each in files sorted by ranges of nodes. A comparison reads of a level only what lies
in at most 64 intervals around the children of ranges that differ (their bounds reach the driver and are pushed into the scan, which
skips files, row groups and pages), and joins that with the differing ranges. Records that share an offset (a fault, yet
possible) are folded by map-side sums of their digests' words, in bounded memory however many there are.

Defined cases: a null offset is the range before all others, reported as -1 and told from a real offset -1 by its digest; null record
content hashes as an empty record with a mark of its own; repeated offsets and repeated rows compare as multisets; two empty replicas
agree; records are hashed whole, however long; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import staged

FANOUT_BITS = 4


def warc_record(uri: Column, body: Column) -> Column:
    """A response record as bytes-to-be: header and body. Null parts are marked, so they differ from empty ones."""
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("\0")), F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length(body), F.lit(-1)).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, F.coalesce(body, F.lit("")), F.lit("\r\n\r\n"))


def leaves(records: DataFrame, offset: Column, record: Column) -> DataFrame:
    """(node, n, digest) at level 0: one row an offset."""
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    sums = [F.sum(word(i)).alias(f"s{i}") for i in range(8)]
    return (
        records.select(F.coalesce(offset.cast("long"), F.lit(-1)).alias("node"), F.sha2(F.when(offset.isNull(), F.concat(F.lit("no offset\0"), record)).otherwise(record).cast("binary"), 256).alias("h"))
        .groupBy("node").agg(F.count("*").alias("n"), F.min("h").alias("one"), *sums)
        .select("node", "n", F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(8)]), 256)).alias("digest"))
    )


class Tree:
    """The levels of a replica's tree, each a stored table (node, n, digest); the last has the root alone."""

    def __init__(self, bottom: DataFrame, height: int):  # bottom: staged leaves
        self.levels = [bottom]
        for level in range(1, height + 1):
            children = F.array_sort(F.collect_list(F.struct("node", "digest")))
            text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
            parent = F.lit(0).cast("long") if level == height else F.shiftright("node", FANOUT_BITS)
            up = self.levels[-1].groupBy(parent.alias("node")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))
            self.levels.append(stored(up, f"merkle-{level}"))


def stored(level: DataFrame, name: str) -> DataFrame:
    """A level in files that hold ranges of nodes in order, so that a scan for some nodes skips the others."""
    return staged(level.repartitionByRange("node").sortWithinPartitions("node"), name)


def intervals(ranges: DataFrame, width: int) -> list[tuple[int, int]]:
    """At most 64 intervals (and one below 0) that cover the nodes of ``ranges`` (up), which number 2 ** width at most."""
    rows = ranges.groupBy(F.shiftright("up", max(0, width - 6))).agg(F.min("up").alias("low"), F.max("up").alias("high")).collect()
    return sorted((r["low"], r["high"]) for r in rows)


def children_within(level: DataFrame, found: list[tuple[int, int]]) -> DataFrame:
    keep = F.lit(False)
    for low, high in found:
        keep = keep | F.col("node").between(low << FANOUT_BITS, ((high + 1) << FANOUT_BITS) - 1)
    return level.where(keep)


def height_of(*bottoms: DataFrame) -> int:
    """Levels until one node covers the largest offset of all replicas; the null range (-1) joins at the root."""
    top = max((b.agg(F.max("node")).first()[0] or 0) for b in bottoms)
    height = 1
    while top >> (FANOUT_BITS * height):
        height += 1
    return height


def compare(a: Tree, b: Tree) -> DataFrame:
    """(node, status, digest_a, digest_b): the offsets at which the replicas differ."""
    bad, height = None, len(a.levels) - 1
    for level in reversed(range(len(a.levels))):
        left, right = (t.levels[level].select("node", F.col("digest").alias(d)) for t, d in ((a, "digest_a"), (b, "digest_b")))
        if bad is not None and level < height - 1:
            # children of the ranges that differ; below the root all are children of node 0
            found = intervals(bad, FANOUT_BITS * (height - level - 1))
            left, right = (children_within(x, found).withColumn("up", F.shiftright("node", FANOUT_BITS)).join(bad, "up", "left_semi").drop("up") for x in (left, right))
        elif bad is not None and bad.isEmpty():
            left, right = left.where(F.lit(False)), right.where(F.lit(False))
        found = left.join(right, "node", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        if level == 0:
            status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
            return found.select("node", status.alias("status"), "digest_a", "digest_b")
        bad = staged(found.select(F.col("node").alias("up")), f"merkle-bad-{level}")
    raise ValueError("a tree has two levels at least")


def audit(primary: DataFrame, replica: DataFrame, offset: str, record: Column) -> DataFrame:
    """Where ``replica`` differs from ``primary``; both have the columns used by ``offset`` and ``record``."""
    bottoms = [stored(leaves(x, F.col(offset), record), "merkle-leaves") for x in (primary, replica)]
    height = height_of(*bottoms)
    return compare(*(Tree(x, height) for x in bottoms))
