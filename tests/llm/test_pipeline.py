"""Every stage of the pipeline against its own operator, and the rows that come out."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from milldam.llm import registry
from milldam.llm.decontaminate import leaks
from milldam.llm.mixing import mix
from milldam.llm.neardup import near_duplicates
from milldam.llm.store import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps, scratch = docs.columns, {}, Scratch(spark, "stages")
    for name, stage in pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        steps[name] = (before, docs)
        assert name == "shard" or docs.columns == columns
        assert 0 < docs.count()
    before, after = steps["near_duplicates"]
    marks = near_duplicates(before, 5, 80).where("kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in marks) == sorted(r["doc_id"] for r in after.select("doc_id").collect())
    before, after = steps["decontaminate"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = {r["doc_id"] for r in leaks(before, bench).collect()}
    assert {r["doc_id"] for r in before.collect()} - gone == {r["doc_id"] for r in after.collect()}
    before, after = steps["mix"]
    times = Counter(r["doc_id"] for r in after.collect())
    for r in mix(before).collect():
        if r["size"]:
            assert times[r["doc_id"]] == -(-r["taken"] // r["size"])
    before, after = steps["shard"]
    counts = Counter(r["shard"] for r in after.collect())
    assert sum(counts.values()) == before.count() and max(counts.values()) - min(counts.values()) <= 1


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_registry_names():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
