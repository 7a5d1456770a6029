"""Renumberings of nodes: (old, new) maps with new ids from 0, and their application.

A dense number needs a total order. Rows are range-partitioned by the sort key, numbered within their
partition, and shifted by the sizes of the partitions before, so no task sees all rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph
from ..plans.lineage import cut, scratch
from .components import components


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """With `new`: the row's place, from 0, in the given order, which has to be total."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    part, at = F.shiftright("pos", 33), F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "p bigint, before bigint")
    return ranged.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("new", F.col("before") + at).drop("p", "before", "pos")


def _map(rows: DataFrame, *order: Column) -> DataFrame:
    return numbered(rows, *order).select(F.col("id").alias("old"), "new")


def by_degree(graph: Graph) -> DataFrame:
    """Degree descending, then id."""
    return _map(graph.degrees(), F.desc("degree"), F.asc("id"))


def by_reverse_degree(graph: Graph) -> DataFrame:
    """Degree ascending, then id."""
    return _map(graph.degrees(), F.asc("degree"), F.asc("id"))


def at_random(graph: Graph, seed: int = 0) -> DataFrame:
    """By a hash of seed and id."""
    return _map(graph.degrees().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))), F.asc("h"), F.asc("id"))


def by_strong_runs(graph: Graph) -> DataFrame:
    """Neighbours of the nodes of highest degree first: by the rank of the first node that has it as a neighbour, then id."""
    rank = by_degree(graph).select(F.col("old").alias("src"), "new")
    first = graph.edges.join(rank, "src").groupBy(F.col("dst").alias("id")).agg(F.min("new").alias("r"))
    return _map(first, F.asc("r"), F.asc("id"))


def by_shingles(graph: Graph, seeds: tuple[int, int] = (1, 2)) -> DataFrame:
    """By two min-hashes of the neighbours, then id."""
    h = lambda s: F.md5(F.concat(F.lit(f"{s}:"), F.col("dst").cast("string")).cast("binary"))
    each = graph.edges.groupBy(F.col("src").alias("id")).agg(F.min(h(seeds[0])).alias("h1"), F.min(h(seeds[1])).alias("h2"))
    return _map(each, F.asc("h1"), F.asc("h2"), F.asc("id"))


def component_roots(graph: Graph) -> DataFrame:
    """(id, root): the smallest id of the component of each node, edges taken both ways."""
    links = graph.edges if graph.directed else graph.edges.where("src < dst")  # the other direction says the same
    found = components(links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.node_table().select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


#: Bits of an id that its block of a list of successors leaves out, which bounds the row of a hub.
BITS = 20


def _successors(graph: Graph) -> DataFrame:
    """(src, to): each node's successors in blocks, written, as they are read for each level."""
    return cut(graph.edges.groupBy("src", F.shiftright("dst", BITS).alias("block")).agg(F.collect_list("dst").alias("to")).select("src", "to"))


def by_bfs(graph: Graph, root: int | None = None) -> DataFrame:
    """Breadth-first order, component by component, each from its smallest node (`root` in its own, which comes first).

    Within a level, nodes stand in the order of the first node that leads to them, as a queue would have them, then
    by id. All components go a level at a time together.
    """
    return _by_bfs(graph, _successors(graph), root)


def _by_bfs(graph: Graph, links: DataFrame, root: int | None) -> DataFrame:
    roots = component_roots(Graph(links.select("src", F.explode("to").alias("dst")), graph.nodes, graph.directed))
    if root is not None:
        home = roots.where(F.col("id") == root).select("root").first()
        if home is None:
            raise ValueError(f"no such node: {root}")
        roots = roots.withColumn("root", F.when(F.col("root") == home.root, root).otherwise(F.col("root")))
    roots = cut(roots.withColumn("later", F.lit(False) if root is None else F.col("root") != root))
    path = scratch(roots.sparkSession)  # each level is added to what is seen
    front, seen = roots.where("id = root"), None
    order = [F.asc("later"), F.asc("root")]
    for level in count():
        front = numbered(front, *order).select("id", F.lit(level).alias("level"), F.col("new").alias("pos"))
        seen = cut(front, path)
        front = seen.where(F.col("level") == level)
        if front.isEmpty():
            break
        # a node's number alone goes along the edges: its smallest is found in hash tables
        near = links.join(front.select(F.col("id").alias("src"), "pos"), "src").select("pos", F.explode("to").alias("id"))
        front = near.groupBy("id").agg(F.min("pos").alias("parent")).join(seen.select("id"), "id", "left_anti")
        order = [F.asc("parent"), F.asc("id")]
    # nodes that are only reached against the direction of edges come last in their component
    rows = roots.join(seen.select("id", "level", "pos"), "id", "left").select("id", "root", "later", F.coalesce("level", F.lit(1 << 30)).alias("level"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return _map(rows, F.asc("later"), F.asc("root"), F.asc("level"), F.asc("pos"), F.asc("id"))


def by_game(graph: Graph, root: int | None = None) -> DataFrame:
    """Degree descending; of equals, in breadth-first order."""
    links = _successors(graph)
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum(F.size("to")).alias("degree"))
    rows = _by_bfs(graph, links, root).withColumnRenamed("old", "id").withColumnRenamed("new", "b").join(degree, "id", "left")
    return _map(rows, F.desc(F.coalesce("degree", F.lit(0))), F.asc("b"))


def relabel(graph: Graph, new_ids: DataFrame) -> Graph:
    """The graph under a map (old, new)."""
    ends = graph.edges.join(new_ids.toDF("src", "a"), "src").join(new_ids.toDF("dst", "b"), "dst")
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    nodes = graph.nodes
    if nodes is not None:
        nodes = nodes.join(new_ids.toDF("id", "new"), "id").drop("id").withColumnRenamed("new", "id")
    return Graph(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest), nodes, graph.directed)


ORDERINGS = {
    "degree": by_degree, "rev_degree": by_reverse_degree, "bfs": by_bfs, "strong_run": by_strong_runs,
    "random": at_random, "shingles": by_shingles, "game": by_game,
}
