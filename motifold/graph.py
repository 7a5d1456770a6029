"""Graphs as DataFrames: edges (src, dst[, attr]) and nodes (id[, attr])."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Graph:
    """edges: distinct (src, dst) of longs; an undirected graph holds each edge both ways.

    nodes: only needed for attributes and for nodes without edges. partitions: for shuffles of the edges, where their
    number is known. pairs: the edges, repeated maybe, all of a src in one of `partitions` partitions, for what sorts them itself.
    """

    edges: DataFrame
    nodes: DataFrame | None = None
    directed: bool = False
    partitions: int | None = None
    pairs: DataFrame | None = None

    @staticmethod
    def from_pairs(pairs: DataFrame, directed: bool = False, nodes: DataFrame | None = None) -> Graph:
        """From (src, dst): rows that are repeated count once; self-loops stay; ids are cast to longs.

        Pairs with a null end are no edges. Undirected: both directions of each pair.
        """
        both = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src is not null and dst is not null")
        if not directed:
            both = both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return Graph(both.distinct(), nodes, directed)

    def node_table(self) -> DataFrame:
        """(id, attr): all nodes; attributes that are missing are 0."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id"))).distinct()
        if self.nodes is None:
            return ends.withColumn("attr", F.lit(0).cast("bigint"))
        own = self.nodes.select("id", F.coalesce(F.col("attr") if "attr" in self.nodes.columns else F.lit(None), F.lit(0)).cast("bigint").alias("attr"))
        return ends.join(own, "id", "full").select("id", F.coalesce("attr", F.lit(0).cast("bigint")).alias("attr"))

    def filter(self, node: Column | None = None, edge: Column | None = None) -> Graph:
        """The subgraph of nodes that satisfy `node` (over id, attr) and edges that satisfy `edge` (over src, dst, attr).

        Both ends of an edge have to be selected. An edge's predicate sees it from src to dst, once.
        """
        edges, nodes = self.edges if edge is None else self.edges.where(edge), self.nodes
        if node is not None:
            nodes = self.node_table().where(node)
            chosen = nodes.select("id")
            edges = edges.join(chosen.withColumnRenamed("id", "src"), "src", "left_semi").join(chosen.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=edges, nodes=nodes, pairs=None)

    def reversed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), pairs=None)

    def adjacency(self, incoming: bool = False) -> DataFrame:
        """(id, nbrs, degree): sorted distinct neighbours of each node that has any.

        A list is one value, so it has to fit a task; where hubs have more neighbours, adjacency_blocks() has them all.
        """
        edges = self.reversed().edges if incoming else self.edges
        return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs")).withColumn("degree", F.size("nbrs").cast("bigint"))

    def adjacency_blocks(self, bits: int = 16, incoming: bool = False) -> DataFrame:
        """(id, block, nbrs): sorted distinct neighbours, in blocks of 2**bits values, which bounds a row whatever the degree."""
        edges = self.reversed().edges if incoming else self.edges
        return edges.groupBy(F.col("src").alias("id"), F.shiftright("dst", bits).alias("block")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))

    def degrees(self, incoming: bool = False) -> DataFrame:
        """(id, degree), without building neighbour lists."""
        return self.edges.groupBy(F.col("dst" if incoming else "src").alias("id")).agg(F.count("*").alias("degree"))

    def max_degree_node(self) -> DataFrame:
        """(id, degree) of the node with most neighbours; of equals, the smallest id."""
        return self.degrees().orderBy(F.desc("degree"), "id").limit(1)

    def neighbours(self, node: int, incoming: bool = False) -> DataFrame:
        """(id) of the out- or in-neighbours of a node."""
        mine, other = ("dst", "src") if incoming else ("src", "dst")
        return self.edges.where(F.col(mine) == node).select(F.col(other).alias("id"))

    def require(self, node: int) -> int:
        """The id, if it is a node's; else an error."""
        if self.node_table().where(F.col("id") == node).isEmpty():
            raise ValueError(f"no such node: {node}")
        return node
