"""Graph files: edge lists, attribute lists and binary adjacency."""

from __future__ import annotations

import struct

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..plans.lineage import cut

# What separates the fields of a line.
BETWEEN, BETWEEN_ATTRIBUTES = r"[ \tA]+", r"[ \tA|]+"


def _place() -> Column:
    """Orders the lines of files: by the file's name, the split within it, and the line within that."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def _numbers(spark: SparkSession, path: str, between: str, names: list[str], placed: bool = False) -> DataFrame:
    """The leading digits of the first fields of each line as longs, so of a date the year; null without any. placed: with `pos`, the line's place.

    One pattern takes a line apart once, as expressions would do for each use of a field. 2**63 and more is an error.
    """
    apart, other = between[:-1], f"[^{between[1:-2]}]"
    pattern = f"^{apart}*" + f"{other}*{apart}*".join(f"(?P<{x}>[0-9]*)" for x in names)

    def parse(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in it:
            found = pc.extract_regex(batch.column(0), pattern)
            digits = [pc.struct_field(found, x).cast(pa.string()) for x in names]
            numbers = [pc.if_else(pc.equal(x, ""), pa.scalar(None, pa.string()), x).cast(pa.int64()) for x in digits]
            yield pa.RecordBatch.from_arrays(numbers + batch.columns[1:], names=names + batch.schema.names[1:])

    lines = _placed(spark.read.text(path)) if placed else spark.read.text(path)
    return lines.select(F.col("value").cast("binary"), *["pos"] * placed).mapInArrow(parse, ", ".join(f"{x} bigint" for x in names) + ", pos bigint" * placed)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines of files with `pos`, the same order as _place() as one number, which hash tables can hold: the split's number, then the line within its task."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    found = sorted((r.file, r.start) for r in lines.select(*split).distinct().collect())  # a row for each split
    at = lines.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(found)], "file string, start bigint, split bigint")
    rows = lines.select("value", *split, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line")).join(F.broadcast(at), ["file", "start"], "left")
    known = F.coalesce("split", F.raise_error(F.lit("files were split anew between two readings")).cast("bigint"))
    return rows.select("value", (F.shiftleft(known, 33) + F.col("line")).alias("pos"))


def edge_list(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """Lines `src dst`. Undirected: both directions. Repeated edges count once, self-loops stay, lines without two numbers are passed over."""
    return Graph.from_pairs(_numbers(spark, path, BETWEEN, ["src", "dst"]), directed)


def node_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(id, attr) of lines `id attr`; of lines with the same id, the last counts."""
    rows = _numbers(spark, path, BETWEEN_ATTRIBUTES, ["id", "attr"], True).where("id is not null")
    return rows.groupBy("id").agg(F.max_by("attr", "pos").alias("attr"))


def attribute_list(spark: SparkSession, path: str, node_path: str, directed: bool = False) -> Graph:
    """Lines `src dst attr`, and node attributes.

    Undirected: of lines with the same two nodes, in either order, the first counts, in both directions.
    Directed: all lines count, parallel edges too. Lines are read once, and edges written. Attributes of nodes without edges are left out, those that are missing are 0.
    """
    rows = _numbers(spark, path, BETWEEN if directed else BETWEEN_ATTRIBUTES, ["src", "dst", "attr"], not directed).where("src is not null and dst is not null")
    rows = rows.withColumn("attr", F.coalesce("attr", F.lit(0).cast("bigint")))
    if directed:
        edges = rows = cut(rows)
    else:
        once = rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by("attr", "pos").alias("attr"))
        rows = cut(once.select(F.col("a").alias("src"), F.col("b").alias("dst"), "attr"))
        edges = rows.union(rows.where("src <> dst").select("dst", "src", "attr"))
    ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = ends.join(node_attributes(spark, node_path), "id", "left").select("id", F.coalesce("attr", F.lit(0)).alias("attr"))
    return Graph(edges, nodes, directed)


def binary_adjacency(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """A file of 8-byte N, then for each node its 8-byte id, and (out, and for directed graphs in) 8-byte length and 4-byte indices.

    One task parses a file, as its nodes can only be found one after the other; Parquet is the format for large graphs.
    """
    lists = 2 if directed else 1

    def parse(it):
        import numpy as np
        import pyarrow as pa

        for batch in it:
            for content in batch.column(0):
                raw = content.as_buffer()
                (n,) = struct.unpack_from("=Q", raw, 0)
                at, ids, rows = 8, np.empty(n, np.uint64), []
                for i in range(n):
                    (ids[i],) = struct.unpack_from("=Q", raw, at)
                    at += 8
                    for k in range(lists):
                        (size,) = struct.unpack_from("=Q", raw, at)
                        if k == 0:  # the in-lists say the same again
                            rows.append(np.frombuffer(raw, np.uint32, size, at + 8))
                        at += 8 + 4 * size
                if n and ids.max() >= 1 << 63:
                    raise ValueError("ids of 2**63 and more don't fit")
                names = ids.astype(np.int64)
                for i in range(0, n, 4096):
                    part = rows[i : i + 4096]
                    src = np.repeat(names[i : i + 4096], [len(x) for x in part])
                    dst = names[np.concatenate(part)] if part else src
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    edges = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "src bigint, dst bigint")
    return Graph(edges.distinct(), None, directed)


def parquet_graph(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """The edges, and the nodes if there are any, written by sinks.write_parquet()."""
    try:
        nodes = spark.read.parquet(f"{path}/nodes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        nodes = None
    return Graph(spark.read.parquet(f"{path}/edges"), nodes, directed)


def set_file(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file, or part files that are one, that has the number of values and then the values, one to a line.

    A number that isn't that of the values is an error.
    """
    rows = spark.read.text(path).withColumn("pos", _place())
    head = rows.orderBy("pos").limit(1).first()
    if head is None:
        raise ValueError(f"no number of values in {path}")
    values = rows.where((F.col("pos.file") != head.pos.file) | (F.col("pos.start") != head.pos.start) | (F.col("pos.line") != head.pos.line)).where(F.length(F.trim("value")) > 0).select(F.trim("value").cast("bigint").alias("value"))
    n = values.count()
    if n != int(head.value):
        raise ValueError(f"{path} says that it has {head.value} values, but has {n}")
    return values


def _drawn(seed: int, name: str, top: int) -> Column:
    """A number below `top` for each `id`, the same whenever a row is computed again."""
    hexes = F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col("id").cast("string")).cast("binary")), 1, 12)
    return F.conv(hexes, 16, 10).cast("bigint") % top


def random_set(spark: SparkSession, n: int, top: int, seed: int = 0, run: int = 1) -> DataFrame:
    """(value): about n distinct values from 0 on, in runs of `run` consecutive ones that begin below `top`, evenly spread."""
    starts = spark.range(-(-n // run)).select(_drawn(seed, "set", top).alias("value"))
    return starts.select(F.explode(F.sequence("value", F.col("value") + (run - 1))).alias("value")).distinct()


def skewed_set(spark: SparkSession, n: int, top: int, dense: int = 500_000, seed: int = 0) -> DataFrame:
    """(value): about n distinct values below `top`, evenly spread, and all of the `dense` ones from `top` on."""
    return random_set(spark, n, top, seed).union(spark.range(top, top + dense).toDF("value"))


def random_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> Graph:
    """An undirected graph of about `edges` edges between random nodes, without self-loops."""
    pairs = spark.range(edges).select(_drawn(seed, "src", nodes).alias("src"), _drawn(seed, "dst", nodes).alias("dst"))
    return Graph.from_pairs(pairs.where("src <> dst"))
