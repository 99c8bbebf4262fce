"""Programs over streams of any source that carry tables from batch to batch.

What a batch leaves lies in the state folder under its number, and the next batch reads it there. A
restarted program gets its unfinished batch again under the same number, reads what the one before
left and overwrites its own results, so nothing is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import sketches

POST = "id long, entities struct<hashtags: array<struct<text:string>>>"
Step = Callable[[DataFrame, int], None]


class Carried:
    """One table that every batch replaces."""

    def __init__(self, spark: SparkSession, base: str, schema: str):
        self.spark, self.base, self.schema = spark, base, schema

    def _path(self, number: int) -> str:
        return f"{self.base}/{number:09d}"

    def before(self, number: int) -> DataFrame:
        """What the batch before ``number`` left; nothing before the first."""
        if number == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(number - 1))

    def keep(self, number: int, df: DataFrame) -> DataFrame:
        """Leaves ``df`` to the next batch, and removes what no restart can ask for any more."""
        df.write.mode("overwrite").parquet(self._path(number))
        if number > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(number - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(self.schema).parquet(self._path(number))


def _run(stream: DataFrame, step: Step, state: str, trigger: dict[str, object]) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", f"{state}/offsets").foreachBatch(step).trigger(**trigger).start()


def _report(df: DataFrame, target: str, number: int) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{target}/{number:09d}")


def bloom(stream: DataFrame, target: str, state: str, **trigger: object) -> StreamingQuery:
    """Over a stream with ``state``: the filter's false-positive rate so far, a CSV row per batch. Null states are left out."""
    seen = Carried(stream.sparkSession, f"{state}/seen", "state string, ord long, batch long")

    def step(batch: DataFrame, number: int) -> None:
        at = F.lit(number).cast("long")
        new = batch.where("state is not null").select("state", (at * (1 << 40) + F.monotonically_increasing_id()).alias("ord"), at.alias("batch"))
        rates = sketches.bloom_rates(seen.keep(number, sketches.first_arrivals(seen.before(number).unionByName(new))))
        last = rates.orderBy(F.desc("batch")).limit(1)
        _report(last.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("fpr").alias("FPR")), target, number)

    return _run(stream, step, state, trigger)


def posts(stream: DataFrame) -> DataFrame:
    """(id, tags) of a stream of POST objects: those that carry at least one tag."""
    tags = F.filter(F.transform("entities.hashtags", lambda x: x["text"]), lambda x: x.isNotNull())
    return stream.select("id", tags.alias("tags")).where(F.size("tags") > 0)


def sampled_tags(stream: DataFrame, target: str, state: str, n: int = sketches.SAMPLE, **trigger: object) -> StreamingQuery:
    """Over a stream (id, tags): a uniform sample of ``n`` posts so far and counters of its tags.

    A post that a batch adds to the sample raises its tags' counters, one that it replaces lowers them,
    and a counter of zero goes. Each batch reports the most frequent tags. Posts without an id or tags
    are left out; a post that comes twice counts twice.
    """
    spark = stream.sparkSession
    sample = Carried(spark, f"{state}/sample", "rank long, id long, tags array<string>")
    counts = Carried(spark, f"{state}/counts", "tag string, n long")

    def step(batch: DataFrame, number: int) -> None:
        new = batch.where("id is not null and size(tags) > 0").select(sketches.order_of(F.col("id")).alias("rank"), "id", "tags")
        held = sample.before(number)
        kept = sample.keep(number, held.unionByName(new).orderBy("rank", "id", "tags").limit(n))
        moved = [df.select(F.explode("tags").alias("tag"), F.lit(by).cast("long").alias("n")) for df, by in ((kept.exceptAll(held), 1), (held.exceptAll(kept), -1))]
        sums = counts.before(number).unionByName(moved[0]).unionByName(moved[1]).groupBy("tag").agg(F.sum("n").alias("n"))
        _report(sketches.top_counts(counts.keep(number, sums.where("n > 0"))).orderBy(F.desc("n"), "tag"), target, number)

    return _run(stream, step, state, trigger)


def distinct(stream: DataFrame, target: str, state: str, length: str = "30 seconds", slide: str = "10 seconds", **trigger: object) -> StreamingQuery:
    """Over a stream (ts, key): distinct keys of every sliding window that closed, counted and estimated. Null keys are left out."""
    keys = sketches.window_keys(stream.where("key is not null").withWatermark("ts", length), length, slide)

    def step(batch: DataFrame, number: int) -> None:
        out = sketches.window_estimates(batch)
        named = out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation"))
        _report(named, target, number)

    return _run(keys, step, state, trigger)
