"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, langid, licenses, mixing, oracle, quality, secrets, sharding, toxicity
from .decontaminate import leaks
from .neardup import TEXT_KEY, near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items: one row for each document and item."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop(TEXT_KEY)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8: one row per document with its component."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places").withColumn("score", F.round("score", 6))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart."""
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_decontaminate, op2_near_duplicates, op3_language, op4_licenses, op5_toxicity,
        op6_quality, op7_shards, op8_fingerprints, op9_secrets, op10_mix,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
