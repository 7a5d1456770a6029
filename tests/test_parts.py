"""Cliques and 4-cycles by parts: the same counts however small the parts, and lists that are sent once to a part."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_graph import complete, counted, graph, loops, neighbours, one

from motifold.operators import patterns
from motifold.plans import lineage, parts


@pytest.mark.parametrize("part, bits, chunk", [(6, 0, 5), (20, 2, 50), (10**6, 8, 1)])
def test_small_parts_give_the_same(spark, monkeypatch, part, bits, chunk):
    for name, value in (("PART", part), ("BITS", bits), ("CHUNK", chunk)):
        monkeypatch.setattr(parts, name, value)
    r = random.Random(part)
    pairs = [p for p in complete(11) if r.random() < 0.8] + [(0, i) for i in range(11, 20)] + [(-3, 4), (-3, 1 << 40), (4, 1 << 40)]
    g = graph(spark, pairs)
    assert counted(g) == loops(pairs)
    assert one(patterns.triangles(g, "join")) == loops(pairs)[0]
    n = neighbours(pairs)
    five = [x for x in itertools.combinations(sorted(n), 5) if all(b in n[a] for a, b in itertools.combinations(x, 2))]
    assert one(patterns.cliques(g, 5)) == len(five) > 0
    assert sorted(tuple(r)[::-1] for r in patterns.clique_list(g, 5).collect()) == five
    assert {(min(x.src, x.dst), max(x.src, x.dst)): x.t for x in patterns.shared_neighbours(g).collect()} == {(min(p), max(p)): len(n[p[0]] & n[p[1]]) for p in pairs}


def test_lists_are_sent_to_parts_not_along_edges(spark, monkeypatch):
    """As many members as edges are in one part; in several, at most that for each; along edges it would be 40 * 39 * 38 / 6."""
    monkeypatch.setattr(parts, "BITS", 2)
    g = graph(spark, complete(40))
    for size, most in ((10**6, 1), (200, 5)):
        monkeypatch.setattr(parts, "PART", size)
        sent = parts.dealt(lineage.cut(parts.lists(g.edges)))
        assert 0 < sent.agg(F.sum(F.size("up"))).first()[0] <= 780 * most
        assert sent.where("own").agg(F.sum(F.size("up"))).first()[0] == 780
        cycles, _ = parts.dealt_below(lineage.cut(parts.lists(g.edges, whole=True)))
        assert cycles.agg(F.sum(F.size("all"))).first()[0] <= 1560 * 2 * most


def test_binary_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No row of the file goes through the driver; the pieces come in order and are gone afterwards."""
    from pyspark.sql import DataFrame

    from motifold.sources import files, sinks

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    pairs = [(i, (i * 7) % 300) for i in range(300)] + [(5, 70_000 + i) for i in range(200)]
    g = graph(spark, pairs, True)
    sinks.write_binary(g, str(tmp_path / "g.bin"), buffer=64)
    assert (tmp_path / "g.bin").stat().st_size == 8 + 24 * 500 + 8 * g.edges.count()
    assert sorted(map(tuple, files.binary_adjacency(spark, str(tmp_path / "g.bin"), True).edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_lists_of_repeated_pairs(spark):
    """Degrees, and sums of the neighbours' ones, whether ids are packed into one number or too far apart for it; pairs count once."""
    for far in (1 << 40, 1 << 61):
        pairs = [(1, 2), (2, 3), (1, 3), (3, far), (-far, 3), (7, 7), (-far, far)]
        n = {a: sorted(b - {a}) for a, b in neighbours(pairs).items() if b - {a}}
        both = spark.createDataFrame([p for p in pairs for p in (p, p[::-1])] * 3, "src bigint, dst bigint").repartition(3, "src")
        for rows in (parts.lists(None, 3, True, both), parts.lists(both.distinct(), whole=True)):
            got = {r.id: r for r in rows.collect()}
            assert {x: sorted(r.up + r.low) for x, r in got.items()} == n
            assert all((r.n, r.d, r.reach) == (len(r.up), len(n[x]), sum(len(n[y]) for y in n[x])) for x, r in got.items())
            assert all(r.up == sorted(r.up, key=lambda y: (len(n[y]), y)) and set(r.below) == {y >> parts.BITS for y in r.low} for r in got.values())


@pytest.mark.parametrize("name", ["common_neighbours", "neighbour_union", "neighbour_difference", "lollipops"])
def test_edges_are_made_once(spark, name):
    """Degrees come with the lists, so the lines aren't joined again for them."""
    from motifold.queries import QUERIES

    assert "l_orderkey" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()


def test_shares_are_summed_in_partitions_that_grow(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART", 20)
    monkeypatch.setattr(parts, "BITS", 0)
    shares = patterns.shared_neighbours(graph(spark, complete(30)))
    assert shares.parts > 8 and "hashpartitioning(src#" in (plan := shares._jdf.queryExecution().executedPlan().toString()) and f", {shares.parts})" in plan
    rows = shares.collect()
    assert len(rows) == 435 and {(r.t, r.ds, r.dd) for r in rows} == {(28, 29, 29)}


def test_tadpoles_write_nothing_but_lists(spark, monkeypatch):
    """Reach and degrees are in the lists; nothing of each edge is written or joined. Corners of many wedges go in pieces."""
    written = []
    monkeypatch.setattr(patterns, "cut", lambda df: written.append(df.columns) or lineage.cut(df))
    monkeypatch.setattr(parts, "WEDGES", 7)
    r = random.Random(8)
    pairs = [p for p in complete(12) if r.random() < 0.7]
    g = graph(spark, pairs)
    assert one(patterns.tadpoles(g)) == loops(pairs)[3] and len(written) == 1
    assert one(patterns.fish(g)) == loops(pairs)[4]


def _copies(spark, path, k):
    """The lines k times, keys shifted, in a folder."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = ("l_orderkey", "l_partkey", "l_suppkey")
    top = rows.agg(*[(F.max(c) + 1).alias(c) for c in keys]).first()
    rows = rows.crossJoin(spark.range(k).toDF("i"))
    rows.select(*[(F.col(c) + F.col("i") * top[c]).alias(c) if c in keys else c for c in rows.columns if c != "i"]).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def _most(rows, n):
    """The largest sum of n in one partition, and how often each n comes."""
    return max(r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(n).alias("n")).collect()), {r[0]: r[1] for r in rows.groupBy(n).count().collect()}


def test_a_task_of_degrees_holds_no_more_edges_of_a_larger_table(spark, tmp_path, monkeypatch):
    from motifold.queries import QUERIES
    from motifold.sources import projections

    monkeypatch.setattr(projections, "LINES", 1000, raising=False)
    (small, once), (large, often) = (_most(QUERIES["degrees"](spark, _copies(spark, tmp_path / str(k), k)), "degree") for k in (1, 6))
    assert often == {d: 6 * c for d, c in once.items()}
    assert large < 1.5 * small and large < sum(d * c for d, c in often.items()) / 18


def test_a_task_of_dataset_stats_holds_no_more_edges_of_a_larger_table(spark, tmp_path, monkeypatch):
    """The table of sets is written by tasks that hold as many edges; means, modes and medians are those of one copy."""
    from motifold.operators import stats
    from motifold.queries import QUERIES
    from motifold.sources import projections

    monkeypatch.setattr(projections, "LINES", 1000, raising=False)
    tables = []
    monkeypatch.setattr(stats, "cut", lambda df: tables.append(df) or lineage.cut(df))
    once, often = (QUERIES["dataset_stats"](spark, _copies(spark, tmp_path / str(k), k)).first().asDict() for k in (1, 6))
    assert often == once | {"n_sets": 6 * once["n_sets"], "dense_sets": 6 * once["dense_sets"]}
    (small, sizes), (large, more) = (_most(t, "card") for t in tables)
    assert more == {d: 6 * c for d, c in sizes.items()} and large < 1.5 * small
