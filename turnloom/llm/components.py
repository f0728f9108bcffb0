"""Connected components of a link table by label propagation with pointer jumping, on DataFrames.

Each step takes for every node the least label among its own, its neighbours' and its label's label, and is
written to the shared folder; a step that changes nothing ends it. Minimums fold on the map side, so a
node with very many links costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import staged


def connected(links: DataFrame) -> DataFrame:
    """links: (a, b). (node, label): every node that has a link, with the least node it can reach."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nxt = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nxt = staged(nxt, "labels")
        jump = nxt.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = staged(nxt.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
