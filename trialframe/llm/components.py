"""Connected components of an edge table, by rounds of minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that it can reach.

    Large star / small star: every round keeps one edge per node to the smallest of its neighbours, so hubs do not
    grow. Every round's edges and minima are written to the shared folder: that cuts the lineage, and leaves plain joins,
    of which Spark can split the side of a hub. The rounds, about as many as the logarithm of the longest chain, go on
    until only stars are left. Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Done when no node both points to a smaller one and is pointed to: only stars are left.
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            ends = e.groupBy("u").agg(F.count_distinct("v").alias("n")).where("n > 1")
            if ends.isEmpty():
                return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        # Large star: the larger neighbours of u go to the smallest of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = durable(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: all smaller neighbours of u, and u, go to the smallest of them.
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = durable(small.where("u <> v").distinct())
