"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until a round leaves every edge as it was.
    Each is an aggregation and a join on one end of the edges. What was aggregated is written before it is joined, so
    that both sides of the join come straight from a shuffle and Spark can split the tasks of a node with many
    neighbours; every round is written to the shared folder, which ends its lineage. Null ends and edges from a node
    to itself are ignored."""
    now = cut(edges.select("a", "b").where("a != b").distinct())
    n = now.count()
    while True:
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of those; here a > b throughout
        smallest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(smallest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(moved.where("a != b").distinct())
        found = after.count()
        same = found == n and after.join(now, ["a", "b"], "left_anti").isEmpty()
        drop(now, least, large, smallest)
        now, n = after, found
        if same:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
