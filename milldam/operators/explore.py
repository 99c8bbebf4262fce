"""Counts, distincts, grouped averages, top-k and partition profiles."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_summary(users: DataFrame, since: str) -> DataFrame:
    """One row: users, those whose start contains ``since``, reviews, mean reviews, distinct names."""
    return users.agg(
        F.count("*").alias("n_users"),
        F.count_if(F.contains("since", F.lit(since))).alias("n_since"),
        F.sum("review_count").alias("n_reviews"),
        F.avg("review_count").alias("avg_reviews"),
        F.countDistinct("name").alias("n_names"),
    )


def top_names(users: DataFrame, k: int = 10) -> DataFrame:
    return users.groupBy("name").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "name").limit(k)


def top_reviewers(users: DataFrame, k: int = 10) -> DataFrame:
    return users.select("user_id", "review_count").orderBy(F.desc("review_count"), "user_id").limit(k)


def state_averages(businesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """Mean stars by state, best first. Reviews are averaged per business before the join, which then
    moves one row per business."""
    partial = reviews.groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("n"))
    joined = businesses.join(partial, "business_id").groupBy("state").agg((F.sum("s") / F.sum("n")).alias("stars"))
    return joined.orderBy(F.desc("stars"), "state")


def partition_profile(df: DataFrame) -> DataFrame:
    """(partition, n_items) of every partition as it lies, empty ones included."""
    n = df.rdd.getNumPartitions()
    have = df.groupBy(F.spark_partition_id().alias("partition")).count()
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(have, "partition", "left").select("partition", F.coalesce("count", F.lit(0)).cast("long").alias("n_items"))


def custom_profile(df: DataFrame, key: str, n: int) -> DataFrame:
    """The profile after dealing rows by hash of a key."""
    return partition_profile(df.repartition(n, key))


def round_robin_profile(df: DataFrame, n: int) -> DataFrame:
    """The profile after dealing rows in turn, whatever their keys: sizes differ by the number of input partitions at most."""
    return partition_profile(df.repartition(n))


def collect_or_take(df: DataFrame, k: int = 5) -> DataFrame:
    """Seconds for fetching all rows and cutting them, against fetching ``k``; both give the same rows."""
    start = time.time()
    whole = df.collect()[:k]
    middle = time.time()
    some = df.limit(k).collect()
    end = time.time()
    data = [("collect", middle - start, len(whole), whole == some), ("take", end - middle, len(some), whole == some)]
    return df.sparkSession.createDataFrame(data, "method string, seconds double, n_rows int, same boolean")
