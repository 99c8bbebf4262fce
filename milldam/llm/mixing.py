"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws an exponential key scaled by its quality weight; in each source, ascending keys
are a weighted random order without replacement. Complete epochs of a source come first, then the
prefix of that order whose sizes fill the rest of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows that the prefix sums of one bucket of keys hold, and the most buckets that there are; beyond
#: them buckets grow. Keys are counted in STEPS steps to a bucket first, which cut even buckets.
BUCKET_ROWS = 2_000
BUCKETS = 4_096
STEPS = 64
#: Steps (a bucket and a sum each) that may be broadcast to the documents.
BROADCAST_STEPS = 1_000_000
#: Sources whose rows of totals may be broadcast to the documents.
BROADCAST_SOURCES = 10_000
SYMBOLS = "#$%&*|!"


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; splitting between them is much faster than counting matches."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain text, down to 0.1 as #$%&*|! reach a quarter of the characters or lines repeat each other."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    lines = F.array_remove(F.split(text, "\n"), "")
    fresh = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    fresh = F.when(F.size(lines) > 0, fresh).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.1), (1.0 - 4.0 * symbols / F.greatest(F.length(text), F.lit(1))) * fresh)


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the id (of the text, if that is null); the same in every run."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _order(weight: Column | None) -> Column:
    """What the documents of a source are sorted by: the key, then all that tells rows apart."""
    text = F.col("text")
    weight = quality_weight(text) if weight is None else weight
    key = -F.log(uniform(F.col("doc_id"), text)) / weight
    return F.struct(key.alias("key"), F.col("doc_id").alias("id"), n_words(text).alias("size"), F.xxhash64("text").alias("text"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, nr, source_size, target from (source, source_size); one row per source.

    Sources in code-point order (null last) have weights 3, 1, 2, 3, ...; together they get SHARE of
    all sizes. A target stops at MOST_EPOCHS times its source's size and the excess goes to the
    others by weight: sources are filled up in order of cap per weight until the rest all stay below.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "nr")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*(F.lit(w) for w in SOURCE_WEIGHTS))
    t = sizes.withColumn("nr", F.row_number().over(by_name))
    t = t.withColumn("w", F.get(weights, (F.col("nr") - 1) % len(SOURCE_WEIGHTS)))
    t = t.withColumn("ratio", MOST_EPOCHS * F.col("source_size") / F.col("w"))
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("all", F.sum("source_size").over(everything))
    t = t.withColumn("capped", F.coalesce(F.sum(MOST_EPOCHS * F.col("source_size")).over(before), F.lit(0)))
    t = t.withColumn("level", (SHARE * F.col("all") - F.col("capped")) / F.sum("w").over(after))
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "nr", "level"))).over(everything)["level"])
    target = F.least(F.col("level") * F.col("w"), MOST_EPOCHS * F.col("source_size").cast("double"))
    return t.select("source", "nr", "source_size", target.alias("target"))


def _light(sources: DataFrame) -> DataFrame:
    """A row per source, to be broadcast if there are few sources; else a hot source is left to the skew join."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def _taken(docs: DataFrame, weight: Column | None) -> tuple[DataFrame, DataFrame]:
    """The rows with what is taken of them, and each source's row."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select("doc_id", "source", _order(weight).alias("order")), "rows")
    sizes = rows.groupBy("source").agg(F.sum("order.size").alias("source_size"), F.count("*").alias("rows"))
    sizes = scratch.save(sizes, "sizes")
    sources = targets(sizes.drop("rows")).join(sizes.select(F.col("source").alias("__s"), "rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("epochs", epochs)
    sources = sources.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    per = max(BUCKET_ROWS, -(-total // BUCKETS))
    # A key's step is even enough for every weight: no step holds over 6 / steps of a source's rows.
    sources = scratch.save(sources.withColumn("steps", STEPS * F.ceil(F.col("rows") / per)), "sources")
    s = _light(sources).alias("s")
    key = F.col("order.key")
    step = F.floor(key / (1 + key) * F.col("s.steps")).alias("step")
    placed = rows.join(s, rows["source"].eqNullSafe(F.col("s.source"))).select(rows["*"], "s.nr", "s.source_size", "s.target", "s.epochs", "s.rest", step)
    counted = placed.groupBy("nr", "step").agg(F.count("*").alias("n"), F.sum("order.size").alias("held"))
    ahead = Window.partitionBy("nr").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(
        "nr", "step", F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / per).alias("bucket"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before")
    )
    steps = counted.withColumn("base", F.min("before").over(Window.partitionBy("nr", "bucket"))).drop("before")
    steps = scratch.save(steps, "steps")
    steps = F.broadcast(steps) if steps.count() <= BROADCAST_STEPS else steps
    inside = Window.partitionBy("nr", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("base") + F.coalesce(F.sum("order.size").over(inside), F.lit(0))
    size = F.col("order.size")
    part = F.least(F.greatest(F.col("rest") - prefix, F.lit(0)), size)
    out = placed.join(steps, ["nr", "step"]).select(
        "doc_id", "source", "order", size.alias("size"), "source_size", "target", "epochs", part.alias("part"), "nr"
    )
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")), sources


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    size counts words (null text: none). A source takes ``epochs`` whole passes and then its first
    documents by key up to the rest of its target, the last of them in part, so its taken words are
    the target rounded down. Null sources form one source; rows that agree in everything share a key
    and their place among each other does not matter. An empty table gives no rows.
    """
    return _taken(docs, weight)[0].select("doc_id", "source", "size", "source_size", "target", "taken")


def draw(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: once for each epoch, and once more up to
    the document that ends the source's target. Texts do not move: each source sends out only the
    order of that last document."""
    taken, sources = _taken(docs, weight)
    ends = taken.where("part > 0").groupBy("nr").agg(F.max("order").alias("end"))
    cuts = Scratch(docs.sparkSession, "draw").save(sources.join(ends, "nr", "left").select(F.col("source").alias("__source"), "epochs", "end"), "cuts")
    rows = docs.withColumn("__order", _order(weight))
    rows = rows.join(_light(cuts), rows["source"].eqNullSafe(F.col("__source")))
    more = F.when(F.col("__order") <= F.col("end"), 1).otherwise(0)
    times = (F.col("epochs") + F.coalesce(more, F.lit(0))).cast("int")
    rows = rows.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return rows.select(*(rows[c] for c in docs.columns))
