"""Breadth-first search, a job for each level."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut, scratch

UNBOUNDED = 0xEFFFFFF


def bfs_levels(graph: Graph, start: int | None = None, limit: int = UNBOUNDED) -> DataFrame:
    """(id, level): nodes by their distance from `start` (the node of highest degree if None), up to `limit`.

    A start that is no node is an error; a graph without edges and start has no levels.
    """
    spark = graph.edges.sparkSession
    if start is None:
        top = graph.max_degree_node().first()
        if top is None:
            return spark.createDataFrame([], "id bigint, level bigint")
        start = top.id
    else:
        graph.require(start)
    links = cut(graph.edges.select("src", "dst"))
    path = scratch(spark)  # each level is added to what is seen
    seen = cut(spark.createDataFrame([(start, 0)], "id bigint, level bigint"), path)
    for level in count(1):
        if level > limit:
            break
        front = seen.where(F.col("level") == level - 1).select(F.col("id").alias("src"))
        near = links.join(front, "src").select(F.col("dst").alias("id")).distinct()
        seen = cut(near.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level).cast("bigint")), path)
        if seen.where(F.col("level") == level).isEmpty():
            break
    return seen


def path_length(graph: Graph, start: int | None = None, limit: int = UNBOUNDED) -> DataFrame:
    """(n): the largest distance from `start`, `limit` at most."""
    return bfs_levels(graph, start, limit).agg(F.coalesce(F.max("level"), F.lit(0)).cast("bigint").alias("n"))
