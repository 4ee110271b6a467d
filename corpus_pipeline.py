"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
their own columns; the last returns where each piece of them is packed. What a
stage returns is written as Parquet and read back for the next one.

Every stage judges rows, not ids: null and repeated ids lose nothing. Null and
empty texts are scored by the classifier, fail the quality rules, are one group of
near copies, are never part of the mix, and are packed as their end id alone. Empty
tables give empty tables, and columns that a stage does not know are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import mil, mixing, nearcopies, packing, rules
from factlake.llm.common import staged


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the passage classifier predicts bad."""
    return mil.keep_good(docs, _labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base or the risk-controlled rules reject."""
    return rules.keep_good(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: the links of
    operator 10 and all others at a Jaccard similarity of 0.8 of five-word shingles."""
    return nearcopies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources come to their targets."""
    return mixing.repeat_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the models, random ranks and packing; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
