"""What the training-data operators share: column picking, staged tables, batch walking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.lineage import cut as stage, release, sweep

#: Texts handed to Python code at a time hold about this many characters.
SLICE_CHARS = 1 << 20


__all__ = ["SLICE_CHARS", "documents", "pick", "positional", "release", "slices", "stage", "sweep"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name and position.

    Other columns can have any name, equal to one of these but for its case included.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns renamed c0, c1, ... and the new name of each old one (the first of its name)."""
    names = {}
    for i, n in enumerate(df.columns):
        names.setdefault(n, f"c{i}")
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), names


def slices(column, chars: int = SLICE_CHARS, rows: int = 4096):
    """(first row, Python values) for runs of rows of an Arrow column with about `chars` characters."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > chars or i - start >= rows):
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, column.slice(start).to_pylist()
