"""Algebra of neighbour sets: array columns, bitmaps over rows, and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("bigint")


def any_member(a: Column, test) -> Column:
    """Whether `test` holds for a member; those behind it aren't looked at."""
    return F.exists(a, test)


def merge(*sets: Column) -> Column:
    """Disjoint sorted sets, merged."""
    return F.sort_array(F.concat(*sets))


def span(a: Column) -> Column:
    """Largest member less smallest; null for an empty set."""
    return F.array_max(a) - F.array_min(a)


def prefixes(a: Column, bits: int = 16) -> Column:
    """Number of blocks of 2**bits consecutive values in which the set has members."""
    return F.size(F.array_distinct(F.transform(a, lambda x: F.shiftright(x, bits)))).cast("bigint")


def bitmaps(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bucket, bits): each key's values as bitmaps, a row for each bucket that has any. Values are not negative."""
    at = F.col(value) + 1  # the functions count from 1
    return rows.groupBy(key, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def bitmap_overlap(pairs: DataFrame, sets: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(a, b, n): common members of the sets of each pair (a, b), from bitmaps(); pairs without any are left out.

    partitions: of the joins, whose rows hold bitmaps, so that more pairs don't grow a task. The two bitmaps of a row are
    matched in Arrow batches, as an aggregate would have to sort them.
    """
    spread = lambda rows, *by: rows.repartition(*[partitions] * bool(partitions), *by)
    left = spread(pairs, "a").join(spread(sets.select(F.col(key).alias("a"), "bucket", "bits"), "a"), "a")
    right = sets.select(F.col(key).alias("b"), "bucket", F.col("bits").alias("other"))
    both = spread(left, "b", "bucket").join(spread(right, "b", "bucket"), ["b", "bucket"]).select("a", "b", "bucket", "bits", "other")
    kind = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in both.schema)}
    each = both.mapInArrow(_common, ", ".join(f"{c} {kind[c]}" for c in ("a", "b", "bucket")) + ", n bigint")
    # pairs that are repeated count once
    return spread(each, "a", "b").groupBy("a", "b", "bucket").agg(F.max("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def _common(it):
    """Members that two bitmaps, the last columns, have in common."""
    import numpy as np
    import pyarrow as pa

    def words(x):
        at = np.frombuffer(x.buffers()[1], np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
        return np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(x), -1)

    for batch in it:
        if batch.num_rows:
            n = np.bitwise_count(words(batch.column(3)) & words(batch.column(4))).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n)], names=["a", "b", "bucket", "n"])


def relation_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def relation_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def relation_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
