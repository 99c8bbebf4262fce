"""Sharding by balanced label propagation.

Documents are linked when their texts are equal. Rows start in hashed shards; what is linked is
carried as *cells*, the rows of one text that started in one shard. In each round a text that lies
in several shards looks at its own rows' shards and wants to gather in the fullest of them that can
take the rest, and joins bring that wish to its cells; they move if the quota of the shard allows.
Only linked rows count against the quota, since rows without links can fill up any shard at last.
So cut links go down while no shard grows beyond its final size, and the last step evens row counts
out until they differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch, parallelism

SHARDS = 24
#: Rounds end earlier when every text lies whole or no shard that is asked for has room.
ROUNDS = 24
#: How far above its final size a shard may grow once nothing moves without it: whole texts only,
#: whose surplus the last step hands on in runs.
SLACK = 0.05
#: Parts that the rows of one text and starting shard are dealt to, so that a hot text moves in parts
#: and is no hot key: a text has at most SHARDS * PARTS cells.
PARTS = 64
#: Cells that may be broadcast to the documents (about 40 bytes each); beyond it both are shuffled.
BROADCAST_CELLS = 500_000
#: Rows that one ranking task holds on average; groups above it are ranked in several parts.
BUCKET_ROWS = 5_000
#: Bytes of text that a task of the last step holds on average, if texts go with their rows.
PART_BYTES = 16 << 20
CELL = ["team", "start", "part"]


def _fraction(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def _rows_of(cells: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: as many numbers as there are shards."""
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(j, 0) for j in range(shards)]


def quotas(sizes: list[int], wanted: dict[tuple[int, int], int], capacity: int) -> list[float]:
    """The share of those who want to enter each shard that may: room left plus room made by leavers."""
    n = len(sizes)
    asked = [sum(c for (_, j), c in wanted.items() if j == k) for k in range(n)]
    share = [0.0] * n
    for _ in range(50):
        leaving = [sum(c * share[j] for (i, j), c in wanted.items() if i == k) for k in range(n)]
        share = [min(1.0, max(0.0, capacity - sizes[k] + leaving[k]) / asked[k]) if asked[k] else 0.0 for k in range(n)]
    return share


def _pick(values: list, index: Column) -> Column:
    """values[index] for a short list."""
    return F.get(F.array(*(F.lit(v) for v in values)), index)


def _keyed(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with size, text_crc32 and the cell of each row; the prefix keeps its columns from clashing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "*",
        (F.octet_length(text) + 8).cast("long").alias("__size"),
        F.crc32(text).alias("__crc"),
        F.xxhash64(text, F.crc32(text), F.octet_length(text)).alias("__team"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("start")), F.lit(shards)).cast("int").alias("__start"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(PARTS)).cast("int").alias("__part"),
    )


def _targets(cells: DataFrame, free: list[int], turn: int) -> DataFrame:
    """(team, at, target, fits) of the texts in several shards that want to gather.

    Of a text's own shards the fullest comes first, those that can take all its other rows before
    those that cannot, full ones never; if none can take all, an open shard that can comes before
    them. Texts that fit nowhere whole gather what the chosen shard takes.
    """
    votes = cells.groupBy("team", "shard").agg(F.sum("n").alias("v"))
    # At most as many entries as there are shards.
    teams = votes.groupBy("team").agg(F.sum("v").alias("all"), F.collect_list(F.struct("v", "shard")).alias("at")).where(F.size("at") > 1)
    tie = lambda shard: F.xxhash64(F.col("team"), shard)

    def rated(x: Column) -> Column:
        room = _pick(free, x["shard"])
        return F.struct((room >= F.col("all") - x["v"]).alias("fits"), x["v"].alias("v"), tie(x["shard"]).alias("tie"), x["shard"].alias("shard"), (room > 0).alias("open"))

    best = F.array_max(F.filter(F.transform("at", rated), lambda x: x["open"]))
    roomy = [j for j, room in enumerate(free) if room > 0]
    other = _pick(roomy, F.pmod(F.xxhash64("team", F.lit(turn)), F.lit(len(roomy))).cast("int")) if roomy else F.lit(None).cast("int")
    teams = teams.withColumn("best", best).withColumn("other", other)
    to_other = F.coalesce(_pick(free, F.col("other")) >= F.col("all"), F.lit(False)) & ~F.coalesce(F.col("best.fits"), F.lit(False))
    target = F.when(to_other, F.col("other")).otherwise(F.col("best.shard"))
    return teams.select("team", "at", target.alias("target"), (to_other | F.col("best.fits")).alias("fits")).where("target is not null")


def _round(cells: DataFrame, free: list[int], turn: int, partly: bool) -> DataFrame:
    """The cells with the shard that each asks for (null: none) and the number that its quota is compared with."""
    teams = _targets(cells, free, turn)
    met = cells.join(teams, "team", "left")
    # Rows of a text that fits nowhere move towards its fuller shards only, so gathering never turns back.
    votes = lambda shard: F.filter("at", lambda x: x["shard"] == shard)[0]["v"]
    rank = lambda shard: F.struct(votes(shard), F.xxhash64("team", shard))
    upwards = F.lit(partly) & (rank(F.col("shard")) < rank(F.col("target")))
    asks = F.when((F.col("target") != F.col("shard")) & (F.col("fits") | upwards), F.col("target"))
    draw = F.when(F.col("fits"), _fraction(F.col("team"), F.lit(turn))).otherwise(_fraction(*map(F.col, CELL), F.lit(turn)))
    return met.select(*CELL, "members", "n", "shard", asks.alias("asks"), draw.alias("draw"))


def _propagated(cells: DataFrame, shards: int, rounds: int, capacity: int, scratch: Scratch) -> DataFrame:
    """(team, members, start, part, n, shard) of all linked cells after the last round."""
    settled, held, strict = [], [0] * shards, True
    for turn in range(1, rounds + 1):
        # Texts that lie whole in one shard have nothing more to ask for and leave the rounds.
        ends = cells.groupBy("team").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"))
        marked = scratch.save(cells.join(ends, "team").withColumn("done", F.col("lo") == F.col("hi")).drop("lo", "hi"), f"cells{turn}")
        done = marked.where("done").drop("done")
        settled.append(done)
        held = [a + b for a, b in zip(held, _rows_of(done, shards))]
        cells = marked.where("not done").drop("done")
        sizes = [a + b for a, b in zip(held, _rows_of(cells, shards))]
        if sizes == held:
            break
        while True:
            most = capacity if strict else int(capacity * (1 + SLACK)) + 1
            wishes = scratch.save(_round(cells, [most - n for n in sizes], turn, strict), f"wishes{turn}")
            asked = wishes.where("asks is not null").groupBy("shard", "asks").agg(F.sum("n").alias("n")).collect()
            share = quotas(sizes, {(r["shard"], r["asks"]): r["n"] for r in asked}, most)
            stuck = sum(r["n"] * share[r["asks"]] for r in asked) < 1
            if not (stuck and strict):
                break
            strict = False
        if stuck:
            break
        moved = F.when(F.col("draw") < _pick(share, F.col("asks")), F.col("asks")).otherwise(F.col("shard"))
        cells = wishes.select(*CELL, "members", "n", moved.alias("shard"))
    out = cells
    for done in settled:
        out = out.unionByName(done)
    return out


def placed(docs: DataFrame, shards: int, rounds: int, texts: bool) -> DataFrame:
    """``docs`` (without the text, unless ``texts``) with __size, __crc, __shard and __slot; see balanced_shards."""
    scratch = Scratch(docs.sparkSession, "shards")
    keyed = _keyed(docs, shards)
    # All rounds read this narrow table; texts are read once more at the end, if they are wanted.
    narrow = scratch.save(keyed.drop("text") if not texts else keyed.select("__size", *(f"__{c}" for c in CELL)), "rows")
    # Counted by cell first, so the rows of a hot text meet nowhere.
    cells = narrow.groupBy(*(F.col(f"__{c}").alias(c) for c in CELL)).agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"))
    cells = scratch.save(cells, "all")
    total, volume = (x or 0 for x in cells.agg(F.sum("n"), F.sum("bytes")).first())
    cells = cells.drop("bytes")
    linked = cells.groupBy("team").agg(F.sum("n").alias("members")).where("members > 1")
    cells = scratch.save(cells.join(linked, "team").withColumn("shard", F.col("start")), "linked")
    cells = _propagated(cells, shards, rounds, total // shards, scratch)
    big = (F.col("members") > BUCKET_ROWS).alias("__big")
    homes = scratch.save(cells.select(*(F.col(c).alias(f"__{c}") for c in CELL), F.col("shard").alias("__home"), big), "homes")
    scratch.keep(narrow, homes)
    if homes.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        homes = F.broadcast(homes)
    buckets = max(1, total // (shards * BUCKET_ROWS))

    def homed(rows: DataFrame) -> DataFrame:
        """Rows with their shard so far and a bucket of it: linked rows come first."""
        rows = rows.join(homes, [f"__{c}" for c in CELL], "left")
        linked = F.col("__home").isNotNull()
        own = F.pmod(F.xxhash64("__team", F.when(F.col("__big"), F.col("__part")).otherwise(F.lit(0))), F.lit(buckets))
        rows = rows.withColumn("__bucket", F.when(linked, 0).otherwise(buckets) + own)
        return rows.withColumn("__shard", F.coalesce("__home", "__start")).drop("__home", "__big")

    held = homed(narrow).groupBy("__shard", "__bucket").count()
    if not texts:
        return _evened(homed(narrow), held, shards, total, scratch)
    parts = max(parallelism(docs.sparkSession), 1 + volume // PART_BYTES)
    return _evened(homed(keyed).repartition(parts, "__shard", "__bucket"), held, shards, total, scratch)


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text, source).

    law is ``rows``: shards' row counts differ by one at most. size is the text's UTF-8 bytes plus 8
    (null: 8), text_crc32 unsigned (null as the empty text). slot numbers a shard's rows from 0.
    grown_shard is null under this law. Rows with equal texts are linked; null texts are linked with
    each other and with empty ones. Repeated rows are rows like any others. Extra columns are
    ignored. An empty table gives no rows.
    """
    return _named(placed(docs.select("doc_id", "source", "text"), shards, rounds, texts=False))


def sharded_rows(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """All columns of ``docs`` and those of balanced_shards, texts too: what a shard's writer needs.

    A column of ``docs`` that has the name of a new one gives way to it.
    """
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    kept = [c for c in docs.columns if c not in new]
    return _named(placed(docs.select(*(docs[c] for c in kept)), shards, rounds, texts=True))


def _named(rows: DataFrame) -> DataFrame:
    mine = [c for c in rows.columns if not c.startswith("__")]
    return rows.select(
        *mine, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _evened(rows: DataFrame, held: DataFrame, shards: int, total: int, scratch: Scratch) -> DataFrame:
    """Final shard and slot: the last rows of shards above their target, unlinked ones first, fill those below."""
    goal = [total // shards + (j < total % shards) for j in range(shards)]
    before = F.sum("count").over(Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    held = scratch.save(held.select("__shard", "__bucket", "count", F.coalesce(before, F.lit(0)).alias("__base")), "held")
    found = {r["__shard"]: r["n"] for r in held.groupBy("__shard").agg(F.sum("count").alias("n")).collect()}
    sizes = [found.get(j, 0) for j in range(shards)]
    inside = Window.partitionBy("__shard", "__bucket").orderBy("__team", "doc_id", "__size")
    # Joined by the keys of the window, so rows move once for both.
    ranked = rows.join(held.drop("count"), ["__shard", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.row_number().over(inside) - 1)
    spare, room, out, to = 0, 0, [], []
    for j in range(shards):
        out.append(spare - goal[j])
        spare += max(0, sizes[j] - goal[j])
    number = F.col("__rank") + _pick(out, F.col("__shard"))
    goes = F.col("__rank") >= _pick(goal, F.col("__shard"))
    shard, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for j in range(shards):
        if (gap := goal[j] - sizes[j]) > 0:
            to.append((j, room, room + gap))
            room += gap
    for j, lo, hi in reversed(to):
        here = (number >= lo) & (number < hi)
        shard = F.when(here, F.lit(j)).otherwise(shard)
        slot = F.when(here, number - lo + sizes[j]).otherwise(slot)
    ranked = ranked.withColumn("__to", F.when(goes, shard).otherwise(F.col("__shard")))
    ranked = ranked.withColumn("__slot", F.when(goes, slot).otherwise(F.col("__rank")).cast("long"))
    return ranked.withColumn("__shard", F.col("__to")).drop("__to", "__rank", "__base", "__bucket", "__team", "__start", "__part")
