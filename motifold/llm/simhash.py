"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits within 3 bits of each other have a half of 32 bits within 1 bit of each other.
So each half is a table, and each fingerprint looks into it at its own half and at those one bit away.
Of two halves one bit apart, the one with the bit clear finds the other, which saves half the look-ups.
All matches are verified over the complete fingerprints. Equal fingerprints are one node, so copies make
no pairs. Places in a table that hold very many fingerprints are matched by a finer key: the rest of the
bits differ by 3 at most, so one of the other half's four bytes is equal.

Components come from alternating star contractions of the links (operators/components.py).
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import components
from .common import documents, pick, positional, slices, stage

DISTANCE, SEED, WORDS = 3, 42, 3
#: Fingerprints at a place of a table from which on it is matched by the finer key.
CROWDED = 256
#: Shingles whose bits are summed at a time.
RUN = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is in over half of the hashes of the text's shingles; no words: zero."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    found = (text or "").encode().lower().split()  # of bytes, both know ASCII alone
    if not found:
        return 0
    joined = b" ".join(found)
    starts = list(accumulate((len(w) + 1 for w in found), initial=0))
    ends = starts[min(words, len(found)) :]
    n, total = len(ends), np.zeros(64, np.int64)
    for i in range(0, n, RUN):
        hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip(starts[i : i + RUN], ends[i : i + RUN])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(…, fp) for rows whose last column is the text: fp, as a signed long, in its place."""

    def batches(it):
        import pyarrow as pa

        for batch in it:
            for start, texts in slices(batch.column(batch.num_columns - 1)):
                fps = [fingerprint(t, words) for t in texts]
                fps = pa.array([x - (x >> 63 << 64) for x in fps], pa.int64())
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], fps], names=[*own.schema.names[:-1], "fp"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(batches, f"{kept}, fp bigint")


def _half(fp: Column, k: int) -> Column:
    return F.shiftright(fp, 32) if k else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _masks(bits: int, equal: int) -> list[int]:
    """Of the 32 bits of a half, all choices of `equal` pieces of `bits` bits."""
    pieces = [((1 << bits) - 1) << at for at in range(0, 32, bits)]
    return [sum(chosen) for chosen in combinations(pieces, equal)]


#: Finer and finer keys of crowded places. Three bits differ at most, so they leave 1 of 4 bytes, and 5 of 8 half-bytes, as they are.
FINER = (_masks(8, 1), _masks(4, 5))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), each once, of the distinct fingerprints `fp` within DISTANCE bits."""
    fp = F.col("fp")
    place = lambda k, v, same: F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(same).alias("same"))

    def near(k: int) -> Column:
        """The half k with each of its clear bits set in turn."""
        clear = F.filter(F.sequence(F.lit(32 * k), F.lit(32 * k + 31)), lambda i: F.getbit(fp, i) == 0)
        flip = lambda i: fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
        return F.transform(clear, lambda i: place(k, _half(flip(i), k), False))

    own = F.array(*(place(k, _half(fp, k), True) for k in (0, 1)))
    table = fps.select("fp", F.explode(own).alias("x")).select(fp.alias("b"), "x.k", "x.v")
    probes = fps.select("fp", F.explode(F.concat(own, near(0), near(1))).alias("x")).select(fp.alias("a"), "x.k", "x.v", "x.same")
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & (~F.col("same") | (F.col("a") < F.col("b")))
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    key, found = ["k", "v"], []
    for level, masks in enumerate(FINER):
        full = stage(table.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select(*key))
        if full.isEmpty():
            break
        found.append(probes.join(table.join(full, key, "left_anti"), key).where(close).select(*ends))

        def finer(x: DataFrame, name: str) -> DataFrame:
            other = F.when(F.col("k") == 0, _half(F.col(name), 1)).otherwise(_half(F.col(name), 0))
            pieces = F.array(*(F.struct(F.lit(j).alias(f"j{level}"), other.bitwiseAND(F.lit(m)).alias(f"c{level}")) for j, m in enumerate(masks)))
            return x.join(full, key, "left_semi").select("*", F.explode(pieces).alias("y")).select("*", f"y.j{level}", f"y.c{level}").drop("y")

        probes, table = finer(probes, "a"), finer(table, "b")
        key = [*key, f"j{level}", f"c{level}"]
    found.append(probes.join(table, key).where(close).select(*ends))
    return reduce(DataFrame.union, found).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, first) of rows (id, fp): first is the smallest id of the fingerprint's component. Ids can be any orderable type."""
    fps = stage(rows.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(fps.select("fp")))
    rooted = fps.join(found, fps.fp == found.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted)
    first = rooted.groupBy("root").agg(F.min("id").alias("first"))
    return rooted.join(first, "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of every row.

    Texts that are null, empty or blank have fingerprint zero and link as any other. Each row gives a row,
    repeated or not. A null id is passed over when components are named; a component without any other has
    a null name. An empty table gives an empty one; other columns are ignored.
    """
    rows = stage(fingerprints(pick(docs, "doc_id", "text")))
    found = classes(rows.withColumnRenamed("doc_id", "id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(found, "fp").select("doc_id", hexed, F.col("first").alias("component_id"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents of which each component of near-duplicates keeps one, the one with the smallest doc_id.

    All columns stay, whatever their names. Of rows with the same id, one is kept; null ids come last. Null, empty
    and blank texts are near-duplicates of each other, so one of them stays. The numbered rows are written before
    they are read twice, so a number is the same row's both times, whatever order `docs` comes in.
    """
    plain, name = positional(docs)
    numbered = stage(plain.withColumn("rid", F.monotonically_increasing_id()))
    order = F.struct(F.col(name["doc_id"]).isNull().alias("n"), F.col(name["doc_id"]).alias("d"), F.col("rid").alias("r"))
    rows = stage(fingerprints(numbered.select(order.alias("id"), F.col(name["text"]).alias("text"))))
    winners = classes(rows).select(F.col("first.r").alias("rid")).distinct()
    return numbered.join(winners, "rid", "left_semi").drop("rid").toDF(*docs.columns)
