"""The graph queries by name, and the same in DuckDB's SQL where whole tables allow it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .functions import sets
from .graph import Graph
from .operators import ordering, patterns, similarity, stats, traversal
from .plans import lineage
from .sources import files, projections as P, sinks

YEAR = 1996


def _pairs(what):
    """(src, dst, n) for each edge src < dst, of the number of common neighbours and the degrees of both ends."""

    def run(spark, sf_dir):
        g = P.parts(spark, sf_dir)
        up, ds, dd = F.col("src") < F.col("dst"), F.col("ds"), F.col("dd")
        n = what(F.col("t"), F.when(up, ds).otherwise(dd), F.when(up, dd).otherwise(ds))
        return patterns.shared_neighbours(g).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), n.alias("n"))

    return run


def _set_strategies(spark, sf_dir):
    """Sets of successors of each node and the next one: sizes of their algebra, by arrays, by a join and by bitmaps."""
    g = P.returned_parts(spark, sf_dir)
    order = _dense(g)
    pairs = order.toDF("a", "k").join(order.select(F.col("old").alias("b"), (F.col("new") - 1).alias("k")), "k").select("a", "b").repartition(g.partitions, "a")
    adj = g.adjacency()
    rows = pairs.join(adj.select(F.col("id").alias("a"), F.col("nbrs").alias("na")), "a").repartition(g.partitions, "b").join(adj.select(F.col("id").alias("b"), F.col("nbrs").alias("nb")), "b")
    na, nb = F.col("na"), F.col("nb")
    first = F.array_min(nb)
    rows = rows.select("a", "b", sets.intersection_size(na, nb).alias("n_array"), F.size(sets.union(na, nb)).cast("bigint").alias("n_union"), F.size(sets.difference(na, nb)).cast("bigint").alias("n_only_a"), F.size(sets.merge(sets.difference(na, nb), nb)).cast("bigint").alias("n_merged"), sets.any_member(na, lambda x: x >= first).alias("reaches"))
    edges = g.edges
    joined = pairs.join(edges.toDF("a", "x"), "a").repartition(g.partitions, "b", "x").join(edges.toDF("b", "x").repartition(g.partitions, "b", "x"), ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("n_join"))
    maps = sets.bitmap_overlap(pairs, sets.bitmaps(edges, "src", "dst"), "src", g.partitions).withColumnRenamed("n", "n_bitmap")
    return rows.join(joined, ["a", "b"], "left").join(maps, ["a", "b"], "left").fillna(0, ["n_join", "n_bitmap"])


def _synthetic_sets(spark, sf_dir):
    """Synthetic sets, written and read as set files: the size of each, and of their common part by relations and by bitmaps."""
    made = {"runs": files.random_set(spark, 4000, 20_000, 1, run=8), "even": files.random_set(spark, 4000, 20_000, 2), "skewed": files.skewed_set(spark, 1000, 5000, 10_000, 3)}
    read = {}
    for name, rows in made.items():
        sinks.write_set(rows, path := lineage.scratch(spark))
        read[name] = files.set_file(spark, path)
    table = reduce(DataFrame.union, (rows.select(F.lit(name).alias("name"), "value") for name, rows in read.items()))
    names = sorted(read)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    mapped = sets.bitmap_overlap(pairs, sets.bitmaps(table, "name", "value"), "name").withColumnRenamed("n", "n_bitmap")
    both = table.toDF("a", "value").join(table.toDF("b", "value"), "value").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_join"))
    sizes = table.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("d"))
    out = both.join(mapped, ["a", "b"], "full").join(sizes.select(F.col("name").alias("a"), F.col("n").alias("size_a")), "a").join(sizes.select(F.col("name").alias("b"), F.col("n").alias("size_b")), "b")
    return out.select("a", "b", "size_a", "size_b", "n_join", "n_bitmap")


def _edge_list_files(directed):
    def run(spark, sf_dir):
        sinks.write_edge_list(Graph(P.returned_parts(spark, sf_dir).edges), path := lineage.scratch(spark))
        return files.edge_list(spark, path, directed).edges

    return run


def _attribute_files(directed):
    def run(spark, sf_dir):
        g = P.dated_parts(spark, sf_dir)
        sinks.write_edge_list(g if directed else Graph(g.edges.where("src < dst")), path := lineage.scratch(spark))
        sinks.write_node_attributes(g.nodes, nodes := lineage.scratch(spark))
        back = files.attribute_list(spark, path, nodes, directed)
        return back.edges.join(back.nodes.toDF("src", "size"), "src").select("src", "dst", "attr", "size")

    return run


def _binary_files(directed):
    def run(spark, sf_dir):
        edges = P.returned_parts(spark, sf_dir).edges
        g = Graph(edges, None, True) if directed else Graph.from_pairs(edges)
        sinks.write_binary(g, path := lineage.scratch(spark))
        return files.binary_adjacency(spark, path, directed).edges

    return run


def _row_dump(spark, sf_dir):
    rows = sinks.row_dump(P.dated_parts(spark, sf_dir), 8)
    one = F.transform("members", lambda x: F.concat_ws(":", x["id"].cast("string"), x["attr"].cast("string")))
    return rows.select("side", "id", "node_attr", "degree", "block", F.array_join(one, ",").alias("members"))


def _adjacency_blocks(spark, sf_dir):
    rows = P.parts(spark, sf_dir).adjacency_blocks(8)
    return rows.select("id", "block", F.size("nbrs").cast("bigint").alias("n"), F.array_join("nbrs", ",").alias("nbrs"))


def _bitmap_overlap(spark, sf_dir):
    g = P.returned_parts(spark, sf_dir)
    maps = sets.bitmaps(g.edges, "src", "dst")
    return sets.bitmap_overlap(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), maps, "src", g.partitions).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")


def _max_nbrs(spark, sf_dir):
    g = P.parts(spark, sf_dir)
    return g.edges.join(g.max_degree_node().select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))


def _bfs(spark, sf_dir):
    return traversal.bfs_levels(P.returned_parts(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n_nodes"))


def _filtered(spark, sf_dir):
    g = P.dated_parts(spark, sf_dir).filter(node=F.col("attr") <= 25, edge=(F.col("attr") == YEAR) & (F.col("src") < F.col("dst")))
    return g.edges.select("src", "dst", "attr")


def _spmv(spark, sf_dir):
    g = P.dated_parts(spark, sf_dir)
    return stats.multiply(g.edges, g.nodes.select("id", F.col("attr").alias("value")))


def _relabelled(spark, sf_dir):
    g = P.returned_parts(spark, sf_dir)
    return ordering.relabel(g, _dense(g)).edges


def _dense(g):
    return ordering.numbered(g.node_table(), F.asc("id")).select(F.col("id").alias("old"), "new")


def _in_out(spark, sf_dir):
    g = P.returned_parts(spark, sf_dir)
    out = g.degrees().select("id", F.col("degree").alias("out_deg"))
    return out.join(g.degrees(incoming=True).select("id", F.col("degree").alias("in_deg")), "id", "full").select("id", F.coalesce("out_deg", F.lit(0)).alias("out_deg"), F.coalesce("in_deg", F.lit(0)).alias("in_deg"))


def _adjacency(spark, sf_dir):
    adj = P.parts(spark, sf_dir).adjacency()
    return adj.select("id", "degree", sets.span(F.col("nbrs")).alias("span"), sets.prefixes(F.col("nbrs"), 4).alias("blocks"), F.array_join("nbrs", ",").alias("nbrs"))


def _two_sets(op):
    def run(spark, sf_dir):
        a = P.returned_parts(spark, sf_dir).edges
        return op(a, a.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    return run


QUERIES = {
    "triangles": lambda s, d: patterns.triangles(P.parts(s, d)),
    "triangles_join": lambda s, d: patterns.triangles(P.parts(s, d), "join"),
    "cliques_4": lambda s, d: patterns.cliques(P.parts(s, d), 4),
    "cliques_5": lambda s, d: patterns.cliques(P.parts(s, d), 5),
    "clique_list_3": lambda s, d: patterns.clique_list(P.parts(s, d), 3),
    "clique_list_4": lambda s, d: patterns.clique_list(P.parts(s, d), 4),
    "lollipops": lambda s, d: patterns.lollipops(P.parts(s, d)),
    "tadpoles": lambda s, d: patterns.tadpoles(P.parts(s, d)),
    "fish": lambda s, d: patterns.fish(P.parts(s, d)),
    "bfs_levels": _bfs,
    "path_length": lambda s, d: traversal.path_length(P.returned_parts(s, d)),
    "path_length_4": lambda s, d: traversal.path_length(P.returned_parts(s, d), limit=4),
    "similar_nodes": lambda s, d: similarity.similar_nodes(P.parts(s, d)),
    "similar_nodes_count": lambda s, d: similarity.similar_nodes(P.parts(s, d)).agg(F.count("*").alias("n")),
    "reciprocity": lambda s, d: similarity.reciprocity(P.returned_suppliers(s, d)),
    "symbiosity": lambda s, d: similarity.symbiosity(P.returned_suppliers(s, d)),
    "symbiosity_undirected": lambda s, d: similarity.symbiosity(P.parts(s, d)),
    "degrees": lambda s, d: P.parts(s, d).degrees(),
    "degrees_directed": _in_out,
    "adjacency": _adjacency,
    "max_degree_node": lambda s, d: P.parts(s, d).max_degree_node(),
    "max_degree_neighbours": _max_nbrs,
    "pruned_edges": lambda s, d: patterns.pruned(P.parts(s, d)),
    "attribute_filter": _filtered,
    "common_neighbours": _pairs(lambda t, a, b: t),
    "neighbour_union": _pairs(lambda t, a, b: a + b - t),
    "neighbour_difference": _pairs(lambda t, a, b: a - t),
    "set_strategies": _set_strategies,
    "synthetic_sets": _synthetic_sets,
    "adjacency_blocks": _adjacency_blocks,
    "random_graph": lambda s, d: files.random_graph(s, 500, 3000, 4).edges,
    "bitmap_overlap": _bitmap_overlap,
    "edges_union": _two_sets(sets.relation_union),
    "edges_intersect": _two_sets(sets.relation_intersect),
    "edges_difference": _two_sets(sets.relation_difference),
    "order_degree": lambda s, d: ordering.by_degree(P.parts(s, d)),
    "order_rev_degree": lambda s, d: ordering.by_reverse_degree(P.parts(s, d)),
    "order_random": lambda s, d: ordering.at_random(P.parts(s, d)),
    "order_strong_run": lambda s, d: ordering.by_strong_runs(P.parts(s, d)),
    "order_shingles": lambda s, d: ordering.by_shingles(P.parts(s, d)),
    "order_bfs": lambda s, d: ordering.by_bfs(P.parts(s, d)),
    "order_game": lambda s, d: ordering.by_game(P.parts(s, d)),
    "relabelled_edges": _relabelled,
    "dataset_stats": lambda s, d: stats.dataset_stats(P.parts(s, d)),
    "matrix_vector": _spmv,
    "block_counts": lambda s, d: stats.block_counts(P.parts(s, d), 8),
    "adjacency_file": lambda s, d: sinks.ligra_lines(P.returned_parts(s, d)),
    "row_dump": _row_dump,
    "edge_list_files": _edge_list_files(False),
    "edge_list_files_directed": _edge_list_files(True),
    "attribute_files": _attribute_files(False),
    "attribute_files_directed": _attribute_files(True),
    "binary_files": _binary_files(False),
    "binary_files_directed": _binary_files(True),
}


# The same in SQL


def _shared(key: str, forward: bool = False, only: str = "") -> str:
    rows = f"(SELECT * FROM lineitem {only})"
    return f"SELECT DISTINCT a.{key} AS src, b.{key} AS dst FROM {rows} a JOIN {rows} b USING (l_orderkey) WHERE a.{key} <> b.{key}" + " AND a.l_linenumber < b.l_linenumber" * forward


_R = "WHERE l_returnflag = 'R'"
U = f"WITH RECURSIVE e AS MATERIALIZED ({_shared('l_partkey')}), "
D = f"WITH RECURSIVE e AS MATERIALIZED ({_shared('l_partkey', True, _R)}), "
S = f"WITH RECURSIVE e AS MATERIALIZED ({_shared('l_suppkey', True, _R)}), "
A = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.l_partkey AS src, b.l_partkey AS dst, MIN(year(a.l_shipdate)) AS attr
 FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2), """
_P = "p AS MATERIALIZED (SELECT src, dst FROM e WHERE dst < src), "
_T = _P + "t AS MATERIALIZED (SELECT a.src AS v1, a.dst AS v2, b.dst AS v3 FROM p a JOIN p b ON a.dst = b.src JOIN p c ON c.src = a.src AND c.dst = b.dst), "
_DEG = "g AS MATERIALIZED (SELECT src AS id, COUNT(*) AS degree FROM e GROUP BY 1), "
_TOP = _DEG + "top AS (SELECT id FROM g ORDER BY degree DESC, id LIMIT 1), "
_ADJ = "adj AS MATERIALIZED (SELECT src AS id, list_sort(list(dst)) AS nbrs FROM e GROUP BY 1), "
# cliques a node at a time over lists of smaller neighbours
_C3 = _P + """pl AS MATERIALIZED (SELECT src AS id, list(dst) AS l FROM p GROUP BY 1),
 c2 AS (SELECT a.src AS v1, a.dst AS v2, list_intersect(x.l, y.l) AS c FROM p a JOIN pl x ON x.id = a.src JOIN pl y ON y.id = a.dst),
 c3 AS MATERIALIZED (SELECT v1, v2, v3, list_intersect(c, z.l) AS c FROM (SELECT v1, v2, c, unnest(c) AS v3 FROM c2) JOIN pl z ON z.id = v3), """
_Q4 = _C3 + "q4 AS MATERIALIZED (SELECT v1, v2, v3, c, unnest(c) AS v4 FROM c3), "
_LEVELS = _TOP + "b(id, level) AS (SELECT id, 0 FROM top UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.id WHERE b.level < {limit}), l AS (SELECT id, MIN(level) AS level FROM b GROUP BY 1) "
# breadth-first order as a queue gives it, from the smallest node; the part graph is connected
_BFS = _DEG + """h AS (SELECT MIN(id) AS id FROM g),
 v(id, level) AS (SELECT id, 0 FROM h UNION SELECT e.dst, v.level + 1 FROM v JOIN e ON e.src = v.id WHERE v.level < 40), l AS MATERIALIZED (SELECT id, MIN(level) AS level FROM v GROUP BY 1),
 b(id, level, pos) AS (SELECT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM h UNION ALL SELECT l.id, CAST(l.level AS BIGINT), ROW_NUMBER() OVER (ORDER BY MIN(b.pos), l.id)
  FROM b JOIN e ON e.src = b.id JOIN l ON l.id = e.dst AND l.level = b.level + 1 GROUP BY l.id, l.level),
 o AS (SELECT id, ROW_NUMBER() OVER (ORDER BY level, pos) - 1 AS new FROM b) """
_REC = """d AS MATERIALIZED (SELECT src AS a, dst AS b, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e),
 d2 AS (SELECT a, b, MAX(o) AS o, MAX(i) AS i FROM d GROUP BY 1, 2),
 r AS (SELECT a AS id, CAST(SUM(o) AS BIGINT) AS out_deg, CAST(SUM(i) AS BIGINT) AS in_deg, CAST(SUM(o * i) AS BIGINT) AS "both" FROM d2 GROUP BY 1) """
_ONE = "one AS (SELECT 1) "


def _drawn(seed: int, top: int, name: str = "set") -> str:
    return f"CAST('0x' || substr(md5('{seed}:{name}:' || i), 1, 12) AS BIGINT) % {top}"


def _set_sizes(f: str) -> str:
    return U + _ADJ + _ONE + f"SELECT e.src, e.dst, CAST({f} AS BIGINT) AS n FROM e JOIN adj a ON a.id = e.src JOIN adj b ON b.id = e.dst WHERE e.src < e.dst"


def _order(base: str, by: str) -> str:
    return base + f"SELECT id AS old, ROW_NUMBER() OVER (ORDER BY {by}) - 1 AS new FROM w"


_COMMON = "len(list_intersect(a.nbrs, b.nbrs))"
ORACLE = {
    "triangles": U + _T + _ONE + "SELECT COUNT(*) AS n FROM t",
    "triangles_join": U + _T + _ONE + "SELECT COUNT(*) AS n FROM t",
    "cliques_4": U + _C3 + _ONE + "SELECT CAST(SUM(len(c)) AS BIGINT) AS n FROM c3",
    "cliques_5": U + _Q4 + _ONE + "SELECT CAST(SUM(len(list_intersect(c, w.l))) AS BIGINT) AS n FROM q4 JOIN pl w ON w.id = v4",
    "clique_list_3": U + _T + _ONE + "SELECT v1, v2, v3 FROM t",
    "clique_list_4": U + _Q4 + _ONE + "SELECT v1, v2, v3, v4 FROM q4",
    "lollipops": U + _T + _DEG + "x AS (SELECT unnest([v1, v2, v3]) AS id FROM t) SELECT CAST(SUM(degree) AS BIGINT) AS n FROM x JOIN g USING (id)",
    "tadpoles": U + _DEG + """w AS MATERIALIZED (SELECT a.src AS x, b.dst AS z, COUNT(*) AS c, SUM(g.degree - 1) AS dd FROM e a JOIN e b ON a.dst = b.src JOIN g ON g.id = a.dst WHERE a.src <> b.dst GROUP BY 1, 2),
 s AS (SELECT e.src AS x, SUM(degree - 1) AS s FROM e JOIN g ON g.id = e.dst GROUP BY 1)
 SELECT CAST(SUM((c * (c - 1) // 2) * (s.s - CASE WHEN e.src IS NULL THEN 0 ELSE g.degree - 1 END) - (c - 1) * dd) AS BIGINT) AS n
 FROM w JOIN s USING (x) JOIN g ON g.id = w.z LEFT JOIN e ON e.src = w.x AND e.dst = w.z WHERE c >= 2""",
    "fish": U + _T + """w AS MATERIALIZED (SELECT a.src AS x, b.dst AS z, COUNT(*) AS c FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2),
 q AS MATERIALIZED (SELECT x, SUM(c * (c - 1) // 2) AS q FROM w GROUP BY 1),
 m AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, SUM(w.c - 1) AS p FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src JOIN w ON w.x = a.src AND w.z = b.dst GROUP BY 1, 2),
 o AS MATERIALIZED (SELECT e.src AS x, e.dst AS y, w.c, m.p FROM e JOIN w ON w.x = e.src AND w.z = e.dst JOIN m ON m.x = e.src AND m.y = e.dst),
 k AS (SELECT unnest([v1, v2, v3]) AS x, unnest([v2, v1, v1]) AS y, unnest([v3, v3, v2]) AS z FROM t)
 SELECT CAST(SUM(q - a.c * (a.c - 1) // 2 - b.c * (b.c - 1) // 2 - (a.p - (b.c - 1)) - (b.p - (a.c - 1)) + (d.c - 1)) AS BIGINT) AS n
 FROM k JOIN q USING (x) JOIN o a ON a.x = k.x AND a.y = k.y JOIN o b ON b.x = k.x AND b.y = k.z JOIN o d ON d.x = k.y AND d.y = k.z""",
    "bfs_levels": D + _LEVELS.format(limit=40) + "SELECT CAST(level AS BIGINT) AS level, COUNT(*) AS n_nodes FROM l GROUP BY 1",
    "path_length": D + _LEVELS.format(limit=40) + "SELECT CAST(MAX(level) AS BIGINT) AS n FROM l",
    "path_length_4": D + _LEVELS.format(limit=4) + "SELECT CAST(MAX(level) AS BIGINT) AS n FROM l",
    "similar_nodes": U + _TOP + "m AS (SELECT dst FROM e WHERE src IN (SELECT id FROM top)) SELECT src AS id, COUNT(*) AS common FROM e WHERE dst IN (SELECT dst FROM m) GROUP BY 1 HAVING COUNT(*) > 10",
    "similar_nodes_count": U + _TOP + "m AS (SELECT dst FROM e WHERE src IN (SELECT id FROM top)), k AS (SELECT src FROM e WHERE dst IN (SELECT dst FROM m) GROUP BY 1 HAVING COUNT(*) > 10) SELECT COUNT(*) AS n FROM k",
    "reciprocity": S + _REC + 'SELECT id, out_deg, in_deg, "both", ROUND("both" / (out_deg + in_deg - "both"), 6) AS ratio FROM r',
    "symbiosity": S + _REC + 'SELECT COUNT(*) AS n FROM r WHERE "both" > 0.5 * (out_deg + in_deg - "both")',
    "symbiosity_undirected": U + _REC + 'SELECT COUNT(*) AS n FROM r WHERE "both" > 0.5 * (out_deg + in_deg - "both")',
    "degrees": U + _DEG + _ONE + "SELECT id, degree FROM g",
    "degrees_directed": D + "x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT id, CAST(SUM(o) AS BIGINT) AS out_deg, CAST(SUM(i) AS BIGINT) AS in_deg FROM x GROUP BY 1",
    "adjacency": U + _ADJ + _ONE + "SELECT id, len(nbrs) AS degree, list_max(nbrs) - list_min(nbrs) AS span, CAST(len(list_distinct(list_transform(nbrs, lambda x: x >> 4))) AS BIGINT) AS blocks, array_to_string(nbrs, ',') AS nbrs FROM adj",
    "max_degree_node": U + _DEG + _ONE + "SELECT id, degree FROM g ORDER BY degree DESC, id LIMIT 1",
    "max_degree_neighbours": U + _TOP + _ONE + "SELECT dst AS id FROM e WHERE src IN (SELECT id FROM top)",
    "pruned_edges": U + _P + _ONE + "SELECT src, dst FROM p",
    "attribute_filter": A + f"n AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25) SELECT src, dst, attr FROM e WHERE attr = {YEAR} AND src < dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)",
    "common_neighbours": _set_sizes(_COMMON),
    "neighbour_union": _set_sizes(f"len(a.nbrs) + len(b.nbrs) - {_COMMON}"),
    "neighbour_difference": _set_sizes(f"len(a.nbrs) - {_COMMON}"),
    "set_strategies": D + _ADJ + """i AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS MATERIALIZED (SELECT id, LEAD(id) OVER (ORDER BY id) AS b FROM i),
 x AS (SELECT o.id AS a, o.b, l.nbrs AS na, r.nbrs AS nb, CAST(len(list_intersect(l.nbrs, r.nbrs)) AS BIGINT) AS n FROM o JOIN adj l ON l.id = o.id JOIN adj r ON r.id = o.b)
 SELECT a, b, n AS n_array, n AS n_join, n AS n_bitmap, CAST(len(na) + len(nb) - n AS BIGINT) AS n_union, CAST(len(na) - n AS BIGINT) AS n_only_a, CAST(len(na) + len(nb) - n AS BIGINT) AS n_merged, list_max(na) >= list_min(nb) AS reaches FROM x""",
    "adjacency_blocks": U + _ONE + "SELECT src AS id, dst >> 8 AS block, COUNT(*) AS n, array_to_string(list_sort(list(dst)), ',') AS nbrs FROM e GROUP BY 1, 2",
    "row_dump": A + """n AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS node_attr FROM part), s AS (SELECT 'row' AS side, src AS id, dst AS o, attr FROM e UNION ALL SELECT 'column', dst, src, attr FROM e),
 d AS (SELECT side, id, COUNT(*) AS degree FROM s GROUP BY 1, 2), l AS (SELECT side, id, o >> 8 AS block, string_agg(o || ':' || attr, ',' ORDER BY o) AS members FROM s GROUP BY 1, 2, 3)
 SELECT side, id, node_attr, degree, block, members FROM l JOIN d USING (side, id) LEFT JOIN n USING (id)""",
    "edge_list_files": D + _ONE + "SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "edge_list_files_directed": D + _ONE + "SELECT src, dst FROM e",
    "attribute_files": A + "u AS (SELECT src, dst, attr FROM e WHERE src < dst UNION ALL SELECT dst, src, attr FROM e WHERE src < dst) SELECT src, dst, attr, CAST(p_size AS BIGINT) AS size FROM u JOIN part ON p_partkey = src",
    "attribute_files_directed": A + _ONE + "SELECT src, dst, attr, CAST(p_size AS BIGINT) AS size FROM e JOIN part ON p_partkey = src",
    "binary_files": D + _ONE + "SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "binary_files_directed": D + _ONE + "SELECT src, dst FROM e",
    "synthetic_sets": f"""WITH t AS MATERIALIZED (SELECT DISTINCT 'runs' AS name, {_drawn(1, 20_000)} + k AS value FROM range(500) r(i), range(8) s(k) UNION ALL SELECT DISTINCT 'even', {_drawn(2, 20_000)} FROM range(4000) r(i)
 UNION ALL SELECT DISTINCT 'skewed', {_drawn(3, 5000)} FROM range(1000) r(i) UNION ALL SELECT 'skewed', i FROM range(5000, 15000) r(i)), n AS (SELECT name, COUNT(*) AS n FROM t GROUP BY 1),
 b AS (SELECT x.name AS a, y.name AS b, COUNT(*) AS n FROM t x JOIN t y USING (value) WHERE x.name < y.name GROUP BY 1, 2)
 SELECT a, b, p.n AS size_a, q.n AS size_b, b.n AS n_join, b.n AS n_bitmap FROM b JOIN n p ON p.name = a JOIN n q ON q.name = b""",
    "random_graph": f"""WITH e AS (SELECT {_drawn(4, 500, 'src')} AS src, {_drawn(4, 500, 'dst')} AS dst FROM range(3000) r(i)) SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst""",
    "bitmap_overlap": D + _ONE + "SELECT e.src, e.dst, COUNT(*) AS n FROM e JOIN e a ON a.src = e.src JOIN e b ON b.src = e.dst AND b.dst = a.dst GROUP BY 1, 2",
    "edges_union": D + _ONE + "SELECT src, dst FROM e UNION SELECT dst, src FROM e",
    "edges_intersect": D + _ONE + "SELECT src, dst FROM e INTERSECT SELECT dst, src FROM e",
    "edges_difference": D + _ONE + "SELECT src, dst FROM e EXCEPT SELECT dst, src FROM e",
    "order_degree": _order(U + _DEG + "w AS (SELECT * FROM g) ", "degree DESC, id"),
    "order_rev_degree": _order(U + _DEG + "w AS (SELECT * FROM g) ", "degree, id"),
    "order_random": _order(U + _DEG + "w AS (SELECT * FROM g) ", "md5('0:' || id), id"),
    "order_strong_run": _order(U + _DEG + "k AS (SELECT id, ROW_NUMBER() OVER (ORDER BY degree DESC, id) AS r FROM g), w AS (SELECT e.dst AS id, MIN(r) AS r FROM e JOIN k ON k.id = e.src GROUP BY 1) ", "r, id"),
    "order_shingles": _order(U + "w AS (SELECT src AS id, MIN(md5('1:' || dst)) AS h1, MIN(md5('2:' || dst)) AS h2 FROM e GROUP BY 1) ", "h1, h2, id"),
    "order_bfs": U + _BFS + "SELECT id AS old, new FROM o",
    "order_game": U + _BFS + "SELECT id AS old, ROW_NUMBER() OVER (ORDER BY degree DESC, new) - 1 AS new FROM o JOIN g USING (id)",
    "relabelled_edges": D + "i AS (SELECT src AS id FROM e UNION SELECT dst FROM e), m AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS k FROM i) SELECT a.k AS src, b.k AS dst FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst",
    "matrix_vector": A + _ONE + "SELECT src AS id, CAST(SUM(attr * p_size) AS BIGINT) AS value FROM e JOIN part ON p_partkey = dst GROUP BY 1",
    "block_counts": U + _ONE + "SELECT src AS id, COUNT(DISTINCT dst >> 8) AS blocks FROM e GROUP BY 1",
    "dataset_stats": U + """s AS MATERIALIZED (SELECT src AS id, COUNT(*) AS card, MAX(dst) - MIN(dst) AS span FROM e GROUP BY 1),
 r AS MATERIALIZED (SELECT *, CASE WHEN card > 1 THEN LEAST(card / (span + 1), 1.0) ELSE 0.0 END AS density FROM s),
 f AS (SELECT COUNT(*) AS n, AVG(card) AS mc, AVG(density) AS md, AVG(span) AS ms, MAX(card) AS xc, MAX(span) AS xs, VAR_POP(card) AS vc, VAR_POP(density) AS vd,
  COUNT(*) FILTER (WHERE card > 1 AND span > 0 AND card * 256 > span) AS dense FROM r),
 q AS (SELECT list_sort(list(card))[COUNT(*) // 2 + 1] AS c, list_sort(list(density))[COUNT(*) // 2 + 1] AS d FROM r),
 mo AS (SELECT (SELECT card FROM r GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS c, (SELECT CAST(floor(density * 10000) AS BIGINT) FROM r GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) / 10000 AS d)
 SELECT n AS n_sets, ROUND(mc, 6) AS avg_card, xc AS max_card, ROUND(ms, 6) AS avg_span, xs AS max_span, ROUND(md, 6) AS avg_density, ROUND(CAST(q.c AS DOUBLE), 6) AS median_card, ROUND(q.d, 6) AS median_density,
 mo.c AS mode_card, ROUND(mo.d, 6) AS mode_density, ROUND(vc, 6) AS var_card, ROUND(vd, 6) AS var_density, ROUND(3 * (mc - mo.c) / sqrt(vc), 6) AS skew1_card, ROUND(3 * (mc - q.c) / sqrt(vc), 6) AS skew2_card,
 ROUND(3 * (md - mo.d) / sqrt(vd), 6) AS skew1_density, ROUND(3 * (md - q.d) / sqrt(vd), 6) AS skew2_density, dense AS dense_sets FROM f, q, mo""",
    "adjacency_file": D + """i AS (SELECT src AS id FROM e UNION SELECT dst FROM e), g AS (SELECT src AS id, COUNT(*) AS d FROM e GROUP BY 1),
 m AS MATERIALIZED (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS k, coalesce(d, 0) AS d, CAST(SUM(coalesce(d, 0)) OVER (ORDER BY id) AS BIGINT) - coalesce(d, 0) AS s FROM i LEFT JOIN g USING (id))
 SELECT 0 AS part, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS next, 'AdjacencyGraph' AS value UNION ALL SELECT 0, 1, 0, CAST(COUNT(*) AS VARCHAR) FROM m UNION ALL SELECT 0, 2, 0, CAST(COUNT(*) AS VARCHAR) FROM e
 UNION ALL SELECT 1, k, 0, CAST(s AS VARCHAR) FROM m UNION ALL SELECT 2, a.k, b.k, CAST(b.k AS VARCHAR) FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst""",
}
