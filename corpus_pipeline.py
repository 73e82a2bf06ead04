"""The corpus pipeline: quality rules, near duplicates, repeated substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Packing needs a tokenizer, which SQL lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import jaccard, mixing, packing, quality, substrings
from symgraph.llm.common import materialize


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where it has that column, following the changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; clean ones stay."""
    return quality.quality_rules(docs, keep_columns=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return jaccard.keep_one(docs)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go from the texts."""
    return _sized(substrings.remove_repeats(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeated for whole epochs."""
    return _sized(mixing.mixed_rows(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens: each piece's place and its ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicates_stage),
    ("substring dedup", substrings_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
