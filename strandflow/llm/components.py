"""Connected components by alternating large and small stars, on DataFrames.

Edges stay distributed; each round combines least neighbours before it shuffles
and writes its edges to the shared folder. Rounds grow with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.tables import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (u, v): label is the least node that it reaches. Loops and repeats are fine."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(nearest.withColumnRenamed("m", "v")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = nodes.select(F.col("label").alias("node"), "label").distinct()
    return nodes.unionByName(roots)
