"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.lineage import cut, release


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots: root is the smallest node that it reaches.

    Each round is written to the shared folder and replaces the one before. An error if `rounds` don't suffice;
    their number grows with the logarithm of the nodes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    seen = None
    for _ in range(rounds):
        # smallest neighbours are written first: a join of two tables can split a node that a third of all links share,
        # one with an aggregation in its stage can't
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(edges, low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        release(large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
