"""Bloom filter, distinct counting and fixed-size samples, for tables and streams alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import bytes_residue, linear, lowest_bit

#: Filter size and its two hashes, then the residues of the distinct counter.
BITS = 200
BLOOM = ((533, 131), (373, 87))
MODULI = (17, 83, 29, 253, 97, 173, 53, 12, 37, 317, 79, 11)
SAMPLE = 150


def first_arrivals(stream: DataFrame) -> DataFrame:
    """(state, ord, batch): when each state came first. As a stream the state store holds one row per state."""
    return stream.groupBy("state").agg(F.min("ord").alias("ord"), F.min_by("batch", "ord").alias("batch"))


def bloom_rates(arrivals: DataFrame) -> DataFrame:
    """(batch, fp, tn, fpr) of first arrivals, cumulative.

    A new state is a false positive if both its bits were set before it came, that is by earlier
    states; repeats count for nothing, and a false positive sets no new bit.
    """
    x = bytes_residue(F.col("state"), BITS)
    bits = F.array(*(linear(x, a, b, BITS) for a, b in BLOOM))
    rows = arrivals.select("batch", "ord", bits.alias("bits"))
    first = rows.select("ord", F.explode("bits").alias("bit")).groupBy("bit").agg(F.min("ord").alias("first"))
    met = rows.select("batch", "ord", F.explode("bits").alias("bit")).join(F.broadcast(first), "bit")  # at most BITS rows
    judged = met.groupBy("batch", "ord").agg((F.max("first") < F.col("ord")).alias("false"))
    each = judged.groupBy("batch").agg(F.count_if("false").alias("f"), F.count_if(~F.col("false")).alias("t"))
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = each.select("batch", F.sum("f").over(so_far).alias("fp"), F.sum("t").over(so_far).alias("tn"))
    return out.select("batch", "fp", "tn", (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr"))


def _estimate(tops: list[Column]) -> Column:
    """The upper median of the means of neighbouring pairs."""
    means = [F.floor((a + b) / 2).cast("long") for a, b in zip(tops[::2], tops[1::2])]
    return F.element_at(F.sort_array(F.array(*means)), len(means) // 2 + 1)


#: Products of neighbouring moduli, small enough to be residues themselves: a key's bytes are folded once for each.
GROUPS = (MODULI[:6], MODULI[6:])


def _residues(key: Column) -> list[Column]:
    """The residues of ``key`` by MODULI, in order."""
    return [F.pmod(bytes_residue(key, math.prod(group)), F.lit(m).cast("long")) for group in GROUPS for m in group]


def window_keys(rows: DataFrame, length: str, slide: str) -> DataFrame:
    """(start, key, n): the distinct ``key`` values in sliding windows over ``ts``. As a stream the state holds a row for each."""
    grouped = rows.groupBy(F.window("ts", length, slide).alias("w"), "key").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "key", "n")


def window_estimates(keys: DataFrame) -> DataFrame:
    """(start, truth, estimate) of each window of window_keys.

    Each residue keeps the largest power of two that divides one of its values; zero residues count
    for nothing, as do null keys. A window without rows gives none.
    """
    hashed = keys.withColumn("r", F.array(*(lowest_bit(r) for r in _residues(F.col("key")))))
    tops = [F.max(F.col("r")[j]).alias(f"r{j}") for j in range(len(MODULI))]
    grouped = hashed.groupBy("start").agg(F.count("key").alias("truth"), *tops)
    powers = [F.greatest(F.col(f"r{j}"), F.lit(1).cast("long")) for j in range(len(MODULI))]
    return grouped.select("start", "truth", _estimate(powers).alias("estimate"))


def window_distinct(rows: DataFrame, length: str, slide: str) -> DataFrame:
    """(start, truth, estimate) of the distinct ``key`` values in sliding windows over ``ts``; see window_estimates."""
    return window_estimates(window_keys(rows, length, slide))


def order_of(event_id: Column) -> Column:
    """A fixed pseudo-random order of ids; of large ones only the lowest 31 bits count, so that no product overflows."""
    modulus = F.lit(2147483648).cast("long")
    return F.pmod(F.pmod(event_id, modulus) * F.lit(1103515245).cast("long") + F.lit(12345).cast("long"), modulus)


def fixed_sample(rows: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The ``n`` rows (id, tag) that come first in the fixed order: a uniform sample without replacement."""
    return rows.where("tag is not null").withColumn("rank", order_of(F.col("id"))).orderBy("rank", "id").limit(n).select("id", "tag")


def top_tags(sample: DataFrame, ranks: int = 5) -> DataFrame:
    """The most frequent tags of a sample (id, tag); see top_counts."""
    return top_counts(sample.groupBy("tag").agg(F.count("*").alias("n")), ranks)


def top_counts(counts: DataFrame, ranks: int = 5) -> DataFrame:
    """(tag, n): all tags of the highest counts, and of the last rank only the first tag by name."""
    by_count = Window.orderBy(F.desc("n"))
    in_rank = Window.partitionBy("n").orderBy("tag")
    ranked = counts.withColumn("rank", F.dense_rank().over(by_count)).withColumn("k", F.row_number().over(in_rank))
    return ranked.where((F.col("rank") < ranks) | ((F.col("rank") == ranks) & (F.col("k") == 1))).select("tag", "n")


def stream_sample(rows: DataFrame, n: int = SAMPLE, shards: int = 8) -> DataFrame:
    """Of a stream (id, tag), each shard's first ``n`` rows so far, after every batch; the latest batch's
    rows of all shards hold the sample. The state of a shard is ``n`` rows whatever the stream's length."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ranks, ids, tags = state.get if state.exists else ([], [], [])
        held = pd.DataFrame({"rank": list(ranks), "id": list(ids), "tag": list(tags)})
        for batch in batches:
            new = batch[["rank", "id", "tag"]]
            held = (pd.concat([held, new]) if len(held) else new).sort_values(["rank", "id"]).head(n)
        state.update((held["rank"].astype("int64").tolist(), held["id"].astype("int64").tolist(), held["tag"].tolist()))
        yield held.assign(shard=key[0])[["shard", "rank", "id", "tag"]]

    dealt = rows.where("tag is not null").withColumn("rank", order_of(F.col("id"))).withColumn("shard", F.pmod("id", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandasWithState(
        keep, "shard int, rank long, id long, tag string", "ranks array<long>, ids array<long>, tags array<string>", "update", GroupStateTimeout.NoTimeout
    )
