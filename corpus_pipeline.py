"""From raw documents to shards: quality, near-duplicates, benchmark leaks, mixing, sharding.

Every stage takes any of its columns null, empty and very long texts, repeated rows, empty tables and extra columns, whatever their names,
and keeps all columns. Rows whose text is null or empty score the training sample's share of good rows in the first stage; the
second and third keep them; the mix takes them as long as their source has complete epochs; each goes into a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from milldam.llm.decontaminate import without_leaks
from milldam.llm.mixing import draw
from milldam.llm.neardup import keep_one
from milldam.llm.quality import keep_good
from milldam.llm.sharding import sharded_rows
from milldam.llm.store import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line-level quality model scores them 0.5 or more; texts without lines score the share of good rows in the sample."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8); texts without words stay."""
    return keep_one(docs, k=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not overlap with a benchmark item; without items all stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each time, the last document of a source whole."""
    return draw(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of every row of the mix with its shard and slot; rows of one text share a shard where sizes allow."""
    return sharded_rows(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontaminate", no_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote, which goes once it has been read."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(docs)
    return docs
