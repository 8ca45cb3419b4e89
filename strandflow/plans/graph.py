"""Graph operators over edge lists (pos, src, dst), as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.lineage import cut


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are never a target."""
    targets = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node")).distinct().join(targets, "node", "left_anti")


def adjacents(edges: DataFrame, node: Column) -> DataFrame:
    return edges.where(F.col("src") == node).select("pos", "dst")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """(place, edge): edges as text, sources sorted, edges of a source in order of insertion; place counts from 0.

    Listing is a total order, so this ends in one sort; it is for topologies, whose edges are few.
    """
    order = Window.orderBy("src", "pos")
    return edges.select((F.row_number().over(order) - 1).alias("place"), F.concat_ws(" -> ", "src", "dst").alias("edge"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, depth): length of the longest path from a root. Frontiers are joined round by round; a cycle is an error."""
    frontier = roots(edges).withColumn("depth", F.lit(0))
    steps = edges.select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().count()
    found, depth = frontier, 0
    while True:
        depth += 1
        frontier = cut(frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if depth >= nodes:  # a path of as many edges as there are nodes meets one of them twice
            raise ValueError("the graph has a cycle")
        found = found.unionByName(frontier)
    out = found.groupBy("node").agg(F.max("depth").alias("depth"))
    if out.count() < nodes:  # the others are on a cycle that no root reaches
        raise ValueError("the graph has a cycle")
    return out
