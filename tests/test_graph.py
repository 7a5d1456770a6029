"""Patterns, orderings and files against loops over small graphs."""

import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from motifold.functions import sets
from motifold.graph import Graph
from motifold.operators import ordering, patterns, similarity, stats, traversal
from motifold.operators.components import components
from motifold.plans import lineage
from motifold.plans.orient import by_degree
from motifold.sources import files, sinks


def graph(spark, pairs, directed=False):
    return Graph.from_pairs(spark.createDataFrame(list(pairs) or [], "src bigint, dst bigint"), directed)


def complete(n):
    return list(itertools.combinations(range(n), 2))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][0]


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def loops(pairs):
    """Triangles, 4-cliques, lollipops, tadpoles, fish by enumeration."""
    n = neighbours(pairs)
    tri = sum(1 for x in n for y in n[x] for z in n[x] & n[y] if x > y > z)
    four = sum(1 for x in n for y in n[x] for z in n[x] & n[y] for w in n[x] & n[y] & n[z] if x > y > z > w)
    lolli = sum(len(n[x]) for x in n for y in n[x] for z in n[x] & n[y] if z < y)
    tad = sum(1 for x in n for y in n[x] for z in n[y] - {x} for w in n[x] & n[z] if w < y for a in n[x] - {y, w, z} for b in n[a] if b != x)
    fish = sum(1 for x in n for y in n[x] for z in n[x] & n[y] if z < y for w in n[x] - {y, z} for a in n[w] - {x, y, z} for b in n[x] & n[a] if b < w and b not in (y, z))
    return tri, four, lolli, tad, fish


def counted(g):
    return one(patterns.triangles(g)), one(patterns.cliques(g, 4)), one(patterns.lollipops(g)), one(patterns.tadpoles(g)), one(patterns.fish(g))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_on_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = [p for p in complete(9) if r.random() < 0.3 + 0.2 * seed]
    g = graph(spark, pairs)
    assert counted(g) == loops(pairs)
    assert one(patterns.triangles(g, "join")) == loops(pairs)[0]


def test_patterns_are_the_same_under_new_ids(spark):
    pairs = [p for p in complete(8) if sum(p) % 3]
    g = graph(spark, pairs)
    new = ordering.at_random(g, 5)
    assert counted(ordering.relabel(g, new)) == loops(pairs)


def test_known_graphs(spark):
    five = graph(spark, complete(5))
    assert one(patterns.triangles(five)) == 10 and one(patterns.cliques(five, 4)) == 5 and one(patterns.cliques(five, 5)) == 1
    assert one(patterns.lollipops(five)) == 120 and one(traversal.path_length(five, 0)) == 1
    path = graph(spark, [(0, 1), (1, 2), (2, 3)])
    assert one(patterns.triangles(path)) == 0 and one(traversal.path_length(path, 0)) == 3 and one(traversal.path_length(path, 0, 2)) == 2
    star = graph(spark, [(0, i) for i in range(1, 13)])
    assert [r.id for r in similarity.similar_nodes(star).collect()] == [0]
    assert counted(graph(spark, [(0, 1), (1, 2), (0, 2)])) == (1, 0, 6, 0, 0)
    assert sorted(map(tuple, patterns.clique_list(five, 4).collect()))[-1] == (4, 3, 2, 1)


def test_graphs_without_edges(spark):
    g = graph(spark, [])
    assert counted(g) == (0, 0, 0, 0, 0)
    assert one(traversal.path_length(g)) == 0 and one(similarity.symbiosity(g)) == 0
    assert stats.dataset_stats(g).first().n_sets == 0 and not ordering.by_degree(g).collect()


def test_repeats_self_loops_and_components(spark):
    g = graph(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (5, 6)])
    assert g.edges.count() == 5
    assert one(patterns.triangles(g)) == 0
    assert {r.id: r.root for r in ordering.component_roots(g).collect()} == {1: 1, 2: 1, 3: 3, 5: 5, 6: 5}
    with pytest.raises(ValueError):
        traversal.bfs_levels(g, 99)
    with pytest.raises(ValueError):
        patterns.cliques(g, 2)


def test_reciprocity(spark):
    assert one(similarity.symbiosity(graph(spark, [(1, 2), (2, 1)], True))) == 2
    assert one(similarity.symbiosity(graph(spark, [(1, 2)], True))) == 0


def test_filter_needs_both_ends(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, attr bigint")
    g = Graph.from_pairs(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint"), nodes=nodes)
    assert g.filter(node=F.col("attr") > 0).edges.count() == 2
    assert g.filter(node=F.col("attr") > 5, edge=F.col("src") < F.col("dst")).edges.count() == 0


def test_orderings_are_permutations(spark):
    pairs = [p for p in complete(9) if sum(p) % 4] + [(20, 21)]
    g = graph(spark, pairs)
    n = len(neighbours(pairs))
    for name, order in ordering.ORDERINGS.items():
        rows = order(g).collect()
        assert sorted(r.new for r in rows) == list(range(n)), name
    degree = {k: len(v) for k, v in neighbours(pairs).items()}
    assert [r.old for r in sorted(ordering.by_degree(g).collect(), key=lambda r: r.new)] == sorted(degree, key=lambda k: (-degree[k], k))
    assert [r.old for r in sorted(ordering.by_bfs(g, 20).collect(), key=lambda r: r.new)][:2] == [20, 21]


def test_set_algebra(spark):
    a, b = {0, 257, 513, 800, 1300, 1600, 1900, 2200, 2500}, {0, 257, 513, 850, 1350, 1600, 1900, 2250, 2500}
    row = spark.createDataFrame([(sorted(a), sorted(b))], "a array<bigint>, b array<bigint>")
    got = row.select(sets.intersect(F.col("a"), F.col("b")), sets.union(F.col("a"), F.col("b")), sets.difference(F.col("a"), F.col("b")), sets.prefixes(F.col("a"), 8), sets.intersection_size(F.col("a"), F.col("b"))).first()
    assert list(got) == [sorted(a & b), sorted(a | b), sorted(a - b), len({x >> 8 for x in a}), 6]
    rows = spark.createDataFrame([(1, x) for x in a | {70_000}] + [(2, x) for x in b | {70_000}], "k bigint, x bigint")
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert sets.bitmap_overlap(pairs, sets.bitmaps(rows, "k", "x"), "k").first().n == 7


def test_edge_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n2\t1\nA3A4\n5 5\nbad\n\n")
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "e.txt")).edges.collect())) == [(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)]
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "e.txt"), True).edges.collect())) == [(1, 2), (2, 1), (3, 4), (5, 5)]


def test_hubs_take_the_other_way(spark, monkeypatch):
    """Small blocks, and wedges of some or all nodes dealt out by both ends: the same sums."""
    r = random.Random(9)
    pairs = [p for p in complete(11) if r.random() < 0.5] + [(0, i) for i in range(11, 30)] + [(1, i) for i in range(15, 26)]
    want = loops(pairs)
    for block, hub in ((2, 1), (3, 6), (4096, 10)):
        monkeypatch.setattr(patterns, "BLOCK", block)
        monkeypatch.setattr(patterns, "HUB", hub)
        g = graph(spark, pairs)
        assert (one(patterns.tadpoles(g)), one(patterns.fish(g))) == want[3:]
    n = neighbours(pairs)
    rows = patterns.edge_triangles(by_degree(graph(spark, pairs).edges)).collect()
    assert {(min(x.src, x.dst), max(x.src, x.dst)): x.t for x in rows} == {p: len(n[p[0]] & n[p[1]]) for p in pairs}


def test_slow_lollipops(spark):
    """The tail written out: each triangle's corner with each of its neighbours."""
    r = random.Random(3)
    pairs = [p for p in complete(10) if r.random() < 0.5]
    g = graph(spark, pairs)
    e = g.edges
    lists = patterns.clique_list(g, 3).select(F.explode(F.array("v1", "v2", "v3")).alias("src"))
    assert one(patterns.lollipops(g)) == lists.join(e, "src").count()


def queue_order(n, starts):
    out, seen = [], set()
    for s in starts:
        if s not in seen:
            queue = [s]
            seen.add(s)
            while queue:
                x = queue.pop(0)
                out.append(x)
                for y in sorted(n[x]):
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
    return out


@pytest.mark.parametrize("root", [None, 7])
def test_breadth_first_order_is_a_queues(spark, root):
    r = random.Random(6)
    pairs = [(a + base, b + base) for base in (0, 40, 90) for a, b in complete(25) if r.random() < 0.09]
    n = neighbours(pairs)
    root = root if root in n else None
    starts = ([root] if root is not None else []) + sorted(n)
    want = queue_order(n, starts)
    got = sorted(map(tuple, ordering.by_bfs(graph(spark, pairs), root).collect()), key=lambda x: x[1])
    assert got == [(x, i) for i, x in enumerate(want)]
    game = sorted(map(tuple, ordering.by_game(graph(spark, pairs), root).collect()), key=lambda x: x[1])
    assert [x for x, _ in game] == sorted(want, key=lambda x: (-len(n[x]), want.index(x)))


def test_components_say_when_they_did_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(1, 51)}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_set_helpers(spark):
    row = spark.createDataFrame([([1, 4], [2, 9], [3])], "a array<bigint>, b array<bigint>, c array<bigint>")
    a, b, c = (F.col(x) for x in "abc")
    assert list(row.select(sets.merge(a, b, c), sets.any_member(a, lambda x: x > 3), sets.any_member(c, lambda x: x > 3)).first()) == [[1, 2, 3, 4, 9], True, False]


def test_blocks_hold_all_neighbours(spark):
    g = graph(spark, [(1, x) for x in (2, 3, 300, 70_000, 70_001)], True)
    rows = {(r.id, r.block): r.nbrs for r in g.adjacency_blocks(8).collect()}
    assert rows == {(1, 0): [2, 3], (1, 1): [300], (1, 273): [70_000, 70_001]}
    assert {(r.id, r.block): r.nbrs for r in g.adjacency_blocks(8, incoming=True).collect()} == {(x, 0): [1] for x in (2, 3, 300, 70_000, 70_001)}


@pytest.mark.parametrize("directed", [True, False])
def test_binary_files_come_back(spark, tmp_path, directed):
    r = random.Random(5)
    pairs = {(r.randrange(60) * 7, r.randrange(60) * 7) for _ in range(200)}
    g = graph(spark, pairs, directed)
    sinks.write_binary(g, str(tmp_path / "g.bin"), buffer=64)
    raw = (tmp_path / "g.bin").read_bytes()
    ids = sorted({x for p in pairs for x in p})
    assert struct.unpack_from("=Q", raw)[0] == len(ids)
    back = files.binary_adjacency(spark, str(tmp_path / "g.bin"), directed)
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_set_files(spark, tmp_path):
    sinks.write_set(spark.range(1000).select(F.col("id").alias("value")).repartition(4), str(tmp_path / "s"))
    assert sorted(r.value for r in files.set_file(spark, str(tmp_path / "s")).collect()) == list(range(1000))
    (tmp_path / "bad.txt").write_text("4\n1\n5\n9\n")
    with pytest.raises(ValueError):
        files.set_file(spark, str(tmp_path / "bad.txt"))
    runs = sorted(r.value for r in files.random_set(spark, 64, 10_000, 1, run=8).collect())
    assert len(runs) <= 64 and sum(b - a == 1 for a, b in itertools.pairwise(runs)) >= len(runs) * 3 // 4
    skewed = {r.value for r in files.skewed_set(spark, 20, 100, 50, 1).collect()}
    assert set(range(100, 150)) <= skewed and len(skewed) <= 70


def test_row_dumps_have_attributes_and_columns(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 5), (1, 300, 6), (2, 1, 7)], "src bigint, dst bigint, attr bigint")
    g = Graph(edges, spark.createDataFrame([(1, 10), (2, 20), (300, 30)], "id bigint, attr bigint"), True)
    sinks.write_rows(g, str(tmp_path / "r"))
    got = [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("side", "id", "node_attr", "degree", "block", F.transform("members", lambda x: F.concat_ws(":", x["id"], x["attr"]))).collect()]
    assert sorted(got) == [("column", 1, 10, 1, 0, ["2:7"]), ("column", 2, 20, 1, 0, ["1:5"]), ("column", 300, 30, 1, 0, ["1:6"]), ("row", 1, 10, 2, 0, ["2:5", "300:6"]), ("row", 2, 20, 1, 0, ["1:7"])]
    assert {r.side for r in sinks.row_dump(graph(spark, [(1, 2)])).collect()} == {"row"}


def test_medians_of_few_and_many(spark):
    r = random.Random(4)
    for n in (1, 2, 7, 400):
        rows = [(r.choice([1, 2, 3, 10**6]), r.random()) for _ in range(n)]
        df = spark.createDataFrame(rows, "c bigint, d double")
        for name, own in (("c", sorted(x for x, _ in rows)), ("d", sorted(y for _, y in rows))):
            assert stats._kth(df, name, n // 2, own[0], own[-1]) == own[n // 2]


def test_clusters_need_a_shared_folder(spark):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local-cluster[2,1,1024]", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Elsewhere)
    table = lineage.cut(spark.range(3))
    assert table.count() == 3
    lineage.release(table)
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(table.written_to)


def test_attribute_lists(spark, tmp_path):
    (tmp_path / "e.txt").write_text("1|2|2012-03-04\n2 1 7\n3 4 9\n")
    (tmp_path / "n.txt").write_text("1|5\n9 9\n")
    g = files.attribute_list(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt"))
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 2012), (2, 1, 2012), (3, 4, 9), (4, 3, 9)]
    assert dict(map(tuple, g.nodes.collect())) == {1: 5, 2: 0, 3: 0, 4: 0}
    (tmp_path / "d.txt").write_text("1 2 3\n1 2 4\n")
    assert files.attribute_list(spark, str(tmp_path / "d.txt"), str(tmp_path / "n.txt"), True).edges.count() == 2


def test_binary_adjacency(spark, tmp_path):
    flat = struct.pack("=Q", 2) + struct.pack("=QQI", 10, 1, 1) + struct.pack("=QQI", 20, 1, 0)
    (tmp_path / "g.bin").write_bytes(flat)
    assert sorted(map(tuple, files.binary_adjacency(spark, str(tmp_path / "g.bin")).edges.collect())) == [(10, 20), (20, 10)]
    both = struct.pack("=Q", 2) + struct.pack("=QQIQ", 10, 1, 1, 0) + struct.pack("=QQQI", 20, 0, 1, 0)
    (tmp_path / "d.bin").write_bytes(both)
    assert sorted(map(tuple, files.binary_adjacency(spark, str(tmp_path / "d.bin"), True).edges.collect())) == [(10, 20)]


def test_sinks(spark, tmp_path):
    g = graph(spark, [(1, 2), (1, 3), (7, 1)], True)
    sinks.write_parquet(g, str(tmp_path / "p"))
    assert files.parquet_graph(spark, str(tmp_path / "p"), True).edges.count() == 3
    sinks.write_ligra(g, str(tmp_path / "l"))
    lines = [x for f in sorted((tmp_path / "l").glob("part-*")) for x in f.read_text().split()]
    assert lines == ["AdjacencyGraph", "4", "3", "0", "2", "2", "2", "1", "2", "0"]
    sinks.write_rows(g, str(tmp_path / "r"))
    sinks.write_table(g.edges, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 3
    (tmp_path / "s.txt").write_text("3\n1\n5\n9\n")
    assert [r.value for r in files.set_file(spark, str(tmp_path / "s.txt")).collect()] == [1, 5, 9]


def test_products_and_statistics(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 4)], "src bigint, dst bigint, attr bigint")
    vector = spark.createDataFrame([(2, 10), (3, 100)], "id bigint, value bigint")
    assert list(map(tuple, stats.multiply(edges, vector).collect())) == [(1, 430)]
    row = stats.dataset_stats(graph(spark, [(0, 1), (0, 2), (0, 4)], True)).first()
    assert (row.n_sets, row.max_card, row.max_span, row.avg_density) == (1, 3, 3, 0.75)


def test_random_sources(spark):
    assert files.random_set(spark, 50, 10, 1).count() <= 10
    assert files.random_graph(spark, 10, 30, 2).edges.where("src = dst").isEmpty()


def test_lines_are_taken_apart_once(spark, tmp_path):
    """Each line is read by one scan, whatever its edges and nodes are asked for; fields are their leading digits."""
    (tmp_path / "e.txt").write_bytes(b"1 2 3\n\nA4\t\t5A2012-03\n x 6\n7 \xff\n8 9\n\xc3\xa4 1 2\n10 11 z\n0012 9223372036854775807 1\n2 1 8\n 5 \n5 5 5 5\n")
    (tmp_path / "n.txt").write_text("1 5\n1|6\n4\n")
    directed = files.attribute_list(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt"), True)
    lines = [(1, 2, 3), (2, 1, 8), (4, 5, 2012), (5, 5, 5), (8, 9, 0), (10, 11, 0), (12, (1 << 63) - 1, 1)]
    assert sorted(map(tuple, directed.edges.collect())) == lines
    g = files.attribute_list(spark, str(tmp_path / "e.txt"), str(tmp_path / "n.txt"))
    once = [x for x in lines if x != (2, 1, 8)]
    assert sorted(map(tuple, g.edges.collect())) == sorted(once + [(b, a, c) for a, b, c in once if a != b])
    assert dict(map(tuple, g.nodes.collect())) == {x: {1: 6}.get(x, 0) for e in once for x in e[:2]}
    for graph_ in (directed, g):
        plan = graph_.edges.join(graph_.nodes.toDF("src", "size"), "src")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("value#") and "e.txt" not in plan
        assert sum("Relation" in x and "text" in x for x in plan.splitlines()) == 1
        assert "SortAggregate" not in graph_.nodes._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "big.txt").write_text("1 9223372036854775808\n")
    with pytest.raises(Exception, match="9223372036854775808"):
        files.edge_list(spark, str(tmp_path / "big.txt")).edges.collect()


def test_the_first_and_the_last_line_count_over_splits(spark, tmp_path):
    """Of an edge the first line counts, of a node the last, by the file's name and the place in it, in files of several splits."""
    (tmp_path / "e").mkdir()
    for name, first in (("b", 500), ("a", 0)):
        (tmp_path / "e" / f"{name}.txt").write_text("".join(f"{i % 50} {i % 50 + 1} {first + i}\n" for i in range(300)))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "500b")
    try:
        g = files.attribute_list(spark, str(tmp_path / "e"), str(tmp_path / "e"))
        assert {(r.src, r.dst): r.attr for r in g.edges.where("src < dst").collect()} == {(i, i + 1): i for i in range(50)}
        assert {r.id: r.attr for r in files.node_attributes(spark, str(tmp_path / "e")).collect()} == {i: i + 1 for i in range(50)}
    finally:
        spark.conf.set(size, before)


def test_breadth_first_orders_make_edges_once(spark, tmp_path):
    """Edges that differ whenever they are made would give other degrees and levels; a marker counts the tasks that make them."""
    made = spark.sparkContext.accumulator(0)

    def watched(it):
        made.add(1)
        yield from it

    pairs = [(a, b) for a, b in complete(12) if (a * b) % 3 == 1] + [(2, 3), (0, 20), (20, 3)]
    both = sorted({p for a, b in pairs for p in ((a, b), (b, a))})
    edges = spark.createDataFrame(both, "src bigint, dst bigint").coalesce(1).mapInArrow(watched, "src bigint, dst bigint")
    n = neighbours(pairs)
    want = queue_order(n, sorted(n))
    for order, key in ((ordering.by_bfs, want.index), (ordering.by_game, lambda x: (-len(n[x]), want.index(x)))):
        got = sorted(map(tuple, order(Graph(edges)).collect()), key=lambda x: x[1])
        assert [x for x, _ in got] == sorted(want, key=key)
    assert made.value == 2


def test_row_dumps_are_read_off_one_order(spark):
    """Blocks that begin, end and go on anywhere in batches of a few rows, parallel edges and missing attributes; no table of all nodes is made."""
    r = random.Random(8)
    edges = [(r.randrange(-3, 6), r.randrange(-20, 60), r.choice([None, 1, 2])) for _ in range(300)] + [(9, x, x) for x in range(70)]
    nodes = {x: x * 10 for x in range(-3, 4)} | {5: None}
    rows = spark.createDataFrame(edges, "src bigint, dst bigint, attr bigint")
    g = Graph(rows, spark.createDataFrame(list(nodes.items()), "id bigint, attr bigint"), True, 3)
    want = []
    for side, ends in (("row", edges), ("column", [(b, a, c) for a, b, c in edges])):
        for i, k in {(a, b >> 3) for a, b, _ in ends}:
            members = sorted(((b, c) for a, b, c in ends if a == i and b >> 3 == k), key=lambda x: (x[0], x[1] or 0))
            want.append((side, i, nodes.get(i) or 0, sum(a == i for a, _, _ in ends), k, members))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (1, 7, 1000):
            spark.conf.set(size, n)
            got = [(*x[:5], [tuple(m) for m in x.members]) for x in sinks.row_dump(g, 3).collect()]
            assert sorted(got, key=lambda x: x[:5]) == sorted(want, key=lambda x: (*x[:2], x[2], x[3], x[4]))
    finally:
        spark.conf.set(size, before)
    plan = sinks.row_dump(g, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2 and "Aggregate" not in plan
    assert {x.node_attr for x in sinks.row_dump(Graph(rows.select("src", "dst"))).collect()} == {None}


def test_lines_are_joined_in_partitions_that_grow_with_the_table(spark, monkeypatch):
    from motifold.sources import projections

    monkeypatch.setattr(projections, "LINES", 500)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        data = "/root/testdata/sf0.001"
        n = -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)
        for g in (projections.parts(spark, data), projections.dated_parts(spark, data)):
            plan = g.edges._jdf.queryExecution().executedPlan().toString()
            exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
            assert exchanges and all(f", {n})" in x for x in exchanges)
    finally:
        spark.conf.set(name, before)


def test_bitmaps_are_matched_in_partitions_that_grow(spark):
    """No aggregate sorts bitmaps, joins of them run in as many partitions as told, and repeated pairs count once."""
    rows = spark.createDataFrame([(k, x) for k in range(6) for x in range(0, 100_000, 1000 * (k + 1))], "k bigint, x bigint")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)] * 2, "a bigint, b bigint")
    got = sets.bitmap_overlap(pairs, sets.bitmaps(rows, "k", "x"), "k", 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_and_agg" not in plan and plan.count(", 7)") >= 5
    of = lambda k: set(range(0, 100_000, 1000 * (k + 1)))
    assert {(r.a, r.b): r.n for r in got.collect()} == {(a, b): len(of(a) & of(b)) for a in range(6) for b in range(6)}
