"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def min_label_components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """(node, label): label is the smallest node of the component, for every node of ``edges`` (src, dst).

    Alternates the large-star and small-star steps until only stars are left. Each step is a grouped minimum, which is
    combined before the shuffle, and an equi-join back; neither gathers a node's neighbours. Each round is written to
    the shared folder. Loops, repeated edges and nulls are ignored. Edges that are ``stored`` already, so that reading them
    again costs little, are not written once more.
    """
    edges = edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = edges if stored else written(edges.distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "small-star")
        # Done when every node is either the root of others or has one root.
        nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not nodes.groupBy("node").agg((F.sum("child") + F.max("root")).alias("n")).filter("n > 1").head(1):
            break
    # Every node now points at its component's smallest node.
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
