"""Sketches against sequential models, and streams against tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from milldam.streaming import sketches


def number(text):
    return int.from_bytes(text.encode(), "big")


def test_bloom_against_sequence(spark):
    r = random.Random(1)
    states = [r.choice("abcdefghijklmnop") * r.randint(1, 9) for _ in range(150)]
    bits, seen, fp, tn, want = set(), set(), 0, 0, {}
    for k, s in enumerate(states):
        own = {(a * number(s) + b) % sketches.BITS for a, b in sketches.BLOOM}
        if s not in seen:
            if own <= bits:
                fp += 1
            else:
                tn += 1
            seen.add(s)
            want[k // 30] = (fp, tn)
        bits |= own
    rows = spark.createDataFrame([(s, k, k // 30) for k, s in enumerate(states)], "state string, ord long, batch long")
    got = {r["batch"]: (r["fp"], r["tn"]) for r in sketches.bloom_rates(sketches.first_arrivals(rows)).collect()}
    assert got == want


def test_distinct_counter(spark):
    start = dt.datetime(2024, 1, 1)
    keys = [f"town{k}" for k in range(40)]
    rows = spark.createDataFrame([(start + dt.timedelta(hours=k), s) for k, s in enumerate(keys)], "ts timestamp, key string")
    got = sketches.window_distinct(rows, "10 days", "10 days").collect()
    assert sum(r["truth"] for r in got) == 40
    for row in got:
        tops = []
        own = [s for k, s in enumerate(keys) if row["start"] <= start + dt.timedelta(hours=k) < row["start"] + dt.timedelta(days=10)]
        for m in sketches.MODULI:
            found = [number(s) % m for s in own]
            tops.append(max([x & -x for x in found if x], default=1))
        means = sorted((a + b) // 2 for a, b in zip(tops[::2], tops[1::2]))
        assert row["estimate"] == means[3]


def test_top_tags_golden(spark):
    rows = [(i, t) for i, t in enumerate("aaaaabbbbccccdddeefg")]
    got = sketches.top_tags(spark.createDataFrame(rows, "id long, tag string")).collect()
    assert sorted(r["tag"] for r in got) == ["a", "b", "c", "d", "e", "f"]


def test_sample_size(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as tag")
    assert sketches.fixed_sample(rows).count() == sketches.SAMPLE
    assert sketches.fixed_sample(rows.limit(20)).count() == 20


def test_stream_sample_over_batches(spark, tmp_path):
    rows = spark.range(600).selectExpr("id", "cast(id % 7 as string) as tag")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    run = sketches.stream_sample(stream, 50).writeStream.outputMode("update").format("memory").queryName("held").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("held").select("rank", "id", "tag").distinct().orderBy("rank", "id").limit(50)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in sketches.fixed_sample(rows, 50).collect()}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    rows = spark.createDataFrame([("x", 1, 0)] * n, "state string, ord long, batch long")
    got = sketches.bloom_rates(sketches.first_arrivals(rows)).collect()
    assert [(r["fp"], r["tn"]) for r in got] == [(0, 1)] * n
