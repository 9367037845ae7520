"""Directed graphs as edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.scratch import cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """(id, outdegree) over different edges."""
    return edges.distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outdegree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): the sorted list of each source's targets, for export."""
    return edges.distinct().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def dangling(edges: DataFrame) -> DataFrame:
    """Nodes without an edge out."""
    return nodes(edges).join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, formula: str = "standard") -> DataFrame:
    """(id, rank). "standard": (1 - d) / N + d (v + m / N), with v the rank that flows in and m that of the nodes
    without an edge out; every node keeps a rank and they sum to 1. "additive": 1 / N + (v + m / N).

    The edges carry their source's out-degree and stay partitioned by source; the sums that flow in are combined
    before the shuffle, so a node with many links in is no hot spot. Each pass is cut by a checkpoint."""
    edges = edges.select("src", "dst").distinct()
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut(edges.join(degrees, "src").select("src", "dst", "degree"))
    every = cut(nodes(links).join(degrees.select(F.col("src").alias("id"), "degree"), "id", "left"))
    n = every.count()
    if n == 0:
        return every.select("id", F.lit(0.0).alias("rank"))
    ranks = every.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        lost = ranks.where("degree is null").agg(F.sum("rank")).first()[0] or 0.0
        flows = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("v"))
        v = F.coalesce("v", F.lit(0.0)) + lost / n
        rank = F.lit((1 - damping) / n) + damping * v if formula == "standard" else F.lit(1.0 / n) + v
        ranks = cut(every.join(flows, "id", "left").select("id", "degree", rank.alias("rank")))
    return ranks.select("id", "rank")
