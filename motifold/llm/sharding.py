"""Sharding by sampled splitters, with DataFrame operations only.

1. A narrow table (key, size, checksum) is staged; texts are read once.
2. A size-weighted sample of keys is drawn. Its quantiles are the boundaries of many small ranges.
3. Rows get their range by binary search; ranges that turn out overfull are subdivided with a
   sample of their own rows, twice as dense each time.
4. A window in each range and the ranges' totals give each row its exact place in the order of
   keys, from which shards are cut.

The key is (hash of the text, doc_id, row number), so equal texts lie side by side. A hot group of
equal texts spans many ranges, since the other parts of the key tell its rows apart.

To the driver come the sample and the ranges' totals, whose sizes are bounded by parameters, and
one row for each cut.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import pick, positional, release, stage

KEY = ("h", "d", "tie")
MAX_RANGES = 16_384
SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def _longs(values: list[int]) -> Column:
    """A literal array; as one string, since a tree of thousands of literals is slow to analyse."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many bounds are at most the row's key, by binary search."""
    if not bounds:
        return F.lit(0)
    hs, ds, ts = (_longs([b[i] for b in bounds]) for i in range(3))
    h, d, tie = map(F.col, KEY)

    def step(at: Column, width: Column) -> Column:
        i = (at + width - 1).cast("int")
        bh, bd, bt = F.get(hs, i), F.get(ds, i), F.get(ts, i)
        low = (bh < h) | ((bh == h) & ((bd < d) | ((bd == d) & (bt <= tie))))
        return F.when(low, at + width).otherwise(at)  # null, past the end, counts as false

    widths = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def _sample(rows: DataFrame, weight: Column, per_unit: float, seed: int) -> list[tuple[tuple[int, int, int], float]]:
    """Keys drawn with a chance of weight * per_unit, each with the weight that it stands for."""
    u = F.abs(F.xxhash64(F.lit(seed), *KEY) / F.lit(float(1 << 63)))
    drawn = rows.where(u < weight * F.lit(per_unit)).select(*KEY, F.greatest(weight * 1.0, F.lit(1 / per_unit)).alias("w"))
    return sorted(((r.h, r.d, r.tie), r.w) for r in drawn.collect())


def _splitters(sample: list, parts: int) -> list[tuple[int, int, int]]:
    """Keys at the quantiles of the sample's weight."""
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if run >= total * (len(out) + 1) / parts and (not out or key > out[-1]) and len(out) < parts - 1:
            out.append(key)
        run += w
    return out


def range_shards(docs: DataFrame, shards: int = 16, law: str = "bytes", **tuning) -> DataFrame:
    """Deal documents into `shards` contiguous ranges of the key.

    law: `bytes`: shards' sizes differ by little; `rows`: shards' counts differ by one at most.
    size: UTF-8 bytes of the text plus 1; a null text counts as an empty one. Under `bytes`, a cut that
    falls within a group of equal texts moves to the group's edge if the group holds at most
    `whole_group` of a shard; a larger group is cut between two of its rows, as shards would differ else.
    An empty table gives an empty one. Rows that are repeated, ids that are null and ids that occur
    more than once each keep their own row and slot. Other columns are ignored. tuning: see deal().
    """
    dealt = deal(pick(docs, "doc_id", "text").withColumn("tie", F.monotonically_increasing_id()), shards, law, **tuning)
    return dealt.drop("tie")


def deal(
    numbered: DataFrame, shards: int = 16, law: str = "bytes", ranges: int = 1024, rows_a_range: int = 50_000,
    samples_a_range: int = 16, whole_group: float = 0.01, seed: int = 7,
) -> DataFrame:
    """Of (doc_id, text, tie): the columns of SCHEMA, and tie, which tells rows apart. What is read of the texts is read once."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        numbered.select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), "tie",
        )
    )
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("bigint")
    n, total = rows.agg(F.count("*"), F.sum(weight)).first()
    if not n:
        return numbered.sparkSession.createDataFrame([], SCHEMA + ", tie bigint")

    parts = min(MAX_RANGES, max(ranges, n // rows_a_range))
    bounds = _splitters(_sample(rows, weight, parts * samples_a_range / total, seed), parts)
    for again in range(1, 4):
        placed = rows.withColumn("r", _range_of(bounds))
        sums = {r.r: (r.w, r.n) for r in placed.groupBy("r").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()}
        over = {r: w for r, (w, k) in sums.items() if w > 4 * total / parts and k > 1}
        if not over or again == 3:
            break
        inner = placed.where(F.array_contains(_longs(sorted(over)), F.col("r").cast("bigint")))
        found: dict[int, list] = {r: [] for r in over}
        for key, w in _sample(inner, weight, (1 << again) * parts * samples_a_range / total, seed + again):
            found[bisect_right(bounds, key)].append((key, w))
        more = [key for r, own in found.items() for key in _splitters(own, int(over[r] * parts // total) + 1)]
        bounds = sorted({*bounds, *more})

    before, before_n, offsets = 0, 0, []
    for r in sorted(sums):
        offsets.append((r, before, before_n))
        before, before_n = before + sums[r][0], before_n + sums[r][1]
    ordered = W.partitionBy("r").orderBy(*KEY)
    near = rows.sparkSession.createDataFrame(offsets, "r int, before bigint, before_n bigint")
    exact = stage(
        placed.withColumns({
            "upto": F.sum(weight).over(ordered.rowsBetween(W.unboundedPreceding, 0)),
            "k": F.row_number().over(ordered).cast("bigint"),
        })
        .join(F.broadcast(near), "r")  # at most a row for each range
        .select("doc_id", "size", "text_crc32", "h", "tie", (F.col("before") + F.col("upto") - weight).alias("g"), (F.col("before_n") + F.col("k") - 1).alias("rank"))
    )

    cuts = _cuts(exact, weight, total, shards, whole_group if law == "bytes" else 0.0)
    shard = sum((F.when(F.col("g") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    dealt = exact.withColumn("shard", shard)
    first = {r.shard: r.k for r in dealt.groupBy("shard").agg(F.min("rank").alias("k")).collect()}
    begins = F.get(_longs([first.get(i, 0) for i in range(shards)]), F.col("shard"))
    return dealt.select(
        "doc_id", "size", F.col("text_crc32").cast("bigint").alias("text_crc32"), F.lit(law).alias("law"), "shard",
        (F.col("rank") - begins).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tie",
    )


def _cuts(exact: DataFrame, weight: Column, total: int, shards: int, whole_group: float) -> list[int]:
    """Places between two rows where a shard ends, one for each inner boundary."""
    marks = [k * total // shards for k in range(1, shards)]
    part = lambda x: F.call_function("div", x * shards, F.lit(total))
    g, end = F.col("g"), F.col("g") + weight
    crossing = exact.where(part(g - 1) != part(end + 1)).select("h", "g", end.alias("end")).collect()  # some rows around each mark
    cuts, groups = [], {}
    for m in marks:
        row = next((r for r in crossing if r.g <= m < r.end), None)
        cuts.append((m, row))
    hashes = sorted({r.h for _, r in cuts if r})
    if whole_group and hashes:
        own = exact.where(F.array_contains(_longs(hashes), F.col("h")))
        groups = {r.h: (r.a, r.b) for r in own.groupBy("h").agg(F.min("g").alias("a"), F.max(end).alias("b")).collect()}
    out = []
    for m, row in cuts:
        if row is None:
            out.append(m)
            continue
        a, b = row.g, row.end
        if row.h in groups and groups[row.h][1] - groups[row.h][0] <= whole_group * total / shards:
            a, b = groups[row.h]
        out.append(a if m - a <= b - m else b)
    assert all(x <= y for x, y in pairwise(out))
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 16, law: str = "bytes", rows_a_file: int = 100_000, **tuning) -> None:
    """Write the documents, all columns, as one folder of Parquet files for each shard (shard=0, ...), in the order of their slots.

    The rows are numbered and written to the shared folder first, then dealt, then joined by their number, so
    each one is written once, whatever its id: ids that are null or repeated and rows that are repeated, too.
    Texts that are null stay null. An empty table gives an empty folder. A column named `shard` is written as `shard_`.
    """
    plain, name = positional(docs)
    numbered = stage(plain.withColumn("tie", F.monotonically_increasing_id()))
    dealt = deal(numbered.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"), "tie"), shards, law, **tuning)
    joined = numbered.join(dealt.select("tie", "shard", "slot"), "tie")
    file = F.call_function("div", F.col("slot"), F.lit(rows_a_file))
    out = joined.repartition("shard", file).sortWithinPartitions("shard", "slot").select(*plain.columns, "shard")
    out.toDF(*(f"{c}_" if c == "shard" else c for c in docs.columns), "shard").write.partitionBy("shard").parquet(path)
    release(numbered)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return range_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
