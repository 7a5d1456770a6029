"""Nodes like another one, and reciprocity of directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph


def similar_nodes(graph: Graph, threshold: int = 10) -> DataFrame:
    """(id, common): nodes with more than `threshold` neighbours in common with the node of highest degree, itself included."""
    top = graph.max_degree_node().select(F.col("id").alias("src"))
    near = graph.edges.join(top, "src", "left_semi").select("dst")
    return graph.edges.join(near, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("common")).where(F.col("common") > threshold)


def reciprocity(graph: Graph) -> DataFrame:
    """(id, out_deg, in_deg, both, ratio): ratio is |out and in| / |out or in|; nodes without edges have no row."""
    edges = graph.edges.select("src", "dst")
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    pairs = ends.groupBy("a", "b").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    sums = pairs.groupBy(F.col("a").alias("id")).agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"), F.sum(F.col("o") * F.col("i")).alias("both"))
    return sums.withColumn("ratio", F.round(F.col("both") / (F.col("out_deg") + F.col("in_deg") - F.col("both")), 6))


def symbiosity(graph: Graph, threshold: float = 0.5) -> DataFrame:
    """(n): nodes whose reciprocity is above `threshold`."""
    above = F.col("both") > threshold * (F.col("out_deg") + F.col("in_deg") - F.col("both"))
    return reciprocity(graph).where(above).agg(F.count("*").alias("n"))
