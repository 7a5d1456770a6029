"""Graphs of the sales tables: parts or suppliers that share an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..graph import Graph


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


#: Lines of orders to a partition of edges, at most.
LINES = 250_000


def _partitions(spark: SparkSession, sf_dir: str) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_lines(spark, sf_dir).count() // LINES))


def _shared(spark: SparkSession, sf_dir: str, key: str, n: int, only: Column | None = None, forward: bool = False, dated: bool = False) -> DataFrame:
    """(src, dst[, attr]) of lines in one order, repeated, in partitions by src whose number grows with the table.

    What is distinct or summed by src or by src and dst needs no other shuffle.
    """
    rows = _lines(spark, sf_dir)
    if only is not None:
        rows = rows.where(only)
    # both sides have the same columns, so one shuffle serves them; its partitions are as many, so the join's tasks don't grow either
    year = [F.year("l_shipdate").cast("bigint").alias("attr")] if dated else []
    rows = rows.select("l_orderkey", F.col(key).alias("key"), *["l_linenumber"] * forward, *year).repartition(n, "l_orderkey")
    pairs = rows.alias("a").join(rows.alias("b"), F.col("a.l_orderkey") == F.col("b.l_orderkey")).where("a.key <> b.key")
    if forward:
        pairs = pairs.where("a.l_linenumber < b.l_linenumber")
    return pairs.select(F.col("a.key").alias("src"), F.col("b.key").alias("dst"), *["a.attr"] * dated).repartition(n, "src")


def parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected: parts in one order."""
    n = _partitions(spark, sf_dir)
    pairs = _shared(spark, sf_dir, "l_partkey", n)
    return Graph(pairs.distinct(), None, False, n, pairs)


def returned_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: from a part to one on a later line of the order, both returned."""
    n = _partitions(spark, sf_dir)
    return Graph(_shared(spark, sf_dir, "l_partkey", n, F.col("l_returnflag") == "R", True).distinct(), None, True, n)


def returned_suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: the same for suppliers."""
    n = _partitions(spark, sf_dir)
    return Graph(_shared(spark, sf_dir, "l_suppkey", n, F.col("l_returnflag") == "R", True).distinct(), None, True, n)


def dated_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed with attributes: an edge has the first year in which its source was shipped in such an order, a node its size."""
    n = _partitions(spark, sf_dir)
    edges = _shared(spark, sf_dir, "l_partkey", n, dated=True).groupBy("src", "dst").agg(F.min("attr").alias("attr"))
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("attr"))
    return Graph(edges, nodes, True, n)
