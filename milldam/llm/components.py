"""Connected components of an edge table, wholly in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for every vertex of ``edges`` (a, b): label is the smallest id it reaches.

    Each round takes the smallest label around a vertex and then that label's own label, so
    paths halve. Self-loops, repeated and null edges are allowed; no edges give no rows.
    """
    known = edges.where("a is not null and b is not null")
    both = known.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        known.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    both = scratch.save(both.distinct(), "edges")
    labels = scratch.save(
        both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        new = step.join(jump, "to", "left").select("id", F.coalesce("beyond", "to").alias("label"), "old")
        saved = scratch.save(new.select("id", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = saved
        if saved.where("moved").isEmpty():
            scratch.drop(both)
            return labels.select("id", "label")
