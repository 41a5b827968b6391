"""Connected components by minimum labels and pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import park


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) for each of ``nodes`` (node long), comp being the smallest node reachable by ``edges`` (a, b).

    Each round takes the least label of all neighbours and then the label of that label, so that the
    number of rounds grows with the logarithm of the longest path. It ends when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = park(both.distinct(), "cc-edges")
    linked = park(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "cc-0")
    k = 0
    while True:
        k += 1
        told = both.join(linked, both["b"] == linked["node"]).groupBy("a").agg(F.min("comp").alias("heard"))
        lower = linked.join(told, linked["node"] == told["a"], "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp")
        )
        lower = park(lower, f"cc-{k}-heard")
        top = lower.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = park(lower.join(top, "comp", "left").select("node", "old", F.least("comp", "up").alias("comp")), f"cc-{k}")
        linked = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            break
    return nodes.join(linked, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
