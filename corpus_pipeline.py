"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents, so each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motifold.llm import bpe, decontaminate, pii, quality, simhash
from motifold.llm.common import documents, release, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go, null and empty texts too."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; null, empty and blank texts are one group."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text. A null text stays null, and its n_chars becomes null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to; none for null and empty texts."""
    return bpe.encode_documents(docs, *bpe.default_vocabulary(), ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level bpe", encoding),
]

#: The classifiers and the tokenizer are beyond SQL; tests/llm compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if before is not None:
            release(before)  # what a stage has read isn't read again
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
