"""Corpus pipeline: five stages over ``documents``, each written as Parquet
and read again by the next.

Documents that the quality rules reject, near copies of a kept document and
documents that hold a benchmark item go; secrets are masked in place; the rest
is mixed to the source weights. Every stage reads all its predecessor kept and
decides on that alone. Null and empty texts, null ids and sources, ties,
repeated rows, empty tables and extra columns are as the operators define
them: empty texts fail the quality rules, of repeated rows one stays, null
ids and sources are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, mixing, quality, secrets, simhash
from riskframe.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash.simhash_dedup(docs, shingle_words=4, max_bits=4)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and ``n_chars`` brought up to date."""
    return secrets.redact_secrets(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often (``copies``)."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_free),
    ("secret_scan", secrets_masked),
    ("mix", mixed),
]

#: SQL expresses neither the fingerprints nor the estimated rule accuracies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
