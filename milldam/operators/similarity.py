"""MinHash signatures, banded candidate pairs and exact Jaccard similarity."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import linear
from ..session import released, saved
from . import cells, neighbours

#: Bytes of an item's sketch.
SKETCH = 128
#: Bands whose rows are shuffled at a time, and prefix rows.
BANDS_AT_ONCE, PREFIX_ROWS = 5, 5_000_000
#: Places in which members are counted to tell the rare ones.
PLACES = 1 << 21
#: Bytes of members that a block of pairs is verified with, about.
BLOCK_BYTES = 16 << 20
#: Pairs of a cell that stay together when they are verified.
CELL_PAIRS = 200_000

#: A prime above the number of members keeps the linear hashes permutations; a * x stays below 2**63.
PRIME = 2_147_483_647


def coefficients(n: int, seed: int = 7) -> list[tuple[int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, 1 << 30), r.randrange(0, 1 << 30)) for _ in range(n)]


def signatures(members: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(item, h0..): the smallest hash of an item's members (item, member bigint), per function."""
    family = coefficients(n, seed)
    return members.groupBy("item").agg(*(F.min(linear(F.col("member"), a, b, PRIME)).alias(f"h{j}") for j, (a, b) in enumerate(family)))


def _banded_rows(hashed: DataFrame, bands: range, rows: int, *more: str) -> DataFrame:
    """(band, cell, item, h, ..): a row of (item, h, ..) for each band."""
    keys = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("h", i * rows + 1, rows)).alias("cell")) for i in bands]
    return hashed.select("item", "h", *more, F.explode(F.array(*keys)).alias("k")).select("k.*", "item", "h", *more)


def candidate_pairs(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b), a < b: items that agree in a whole band; each pair comes from the first band that it agrees in.

    Items without members have no hashes and agree with none.
    """
    every = F.array(*(F.col(f"h{j}").cast("int") for j in range(bands * rows))).alias("h")  # below PRIME, so an int holds them
    return cells.pairs(_banded_rows(signed.where("h0 is not null").select("item", every), range(bands), rows), cells.first_band(rows)).select("a", "b")


def _lists(members: DataFrame) -> DataFrame:
    """(item, low, high): each item's distinct members as neighbours.halved has them; from rows (item, member) or (item, members)."""
    if "members" in members.columns:
        flat = F.flatten(F.collect_list(F.array_compact(F.col("members").cast("array<long>"))))
        lists = members.where("item is not null").groupBy("item").agg(F.array_distinct(flat).alias("members"))
    else:
        lists = members.where("item is not null").groupBy("item").agg(F.collect_set(F.col("member").cast("long")).alias("members"))
    out = saved(neighbours.halved(lists.where(F.size("members") > 0)), "lists")
    released(out.sparkSession)
    return out


def _sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each list of values SKETCH bytes, with a bit for each value."""
    bits = np.zeros((len(bounds) - 1, 8 * SKETCH), dtype=bool)
    place = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(8 * SKETCH)
    bits[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), place.astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    to = (np.arange(len(rows) + 1) * SKETCH).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(rows))])


def _hashed(lists: DataFrame, n: int) -> DataFrame:
    """(item, n, h, s): the number of members, their smallest hashes and their sketch."""
    family = coefficients(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole)):
            values, bounds = neighbours.wholes(batch.column(1), batch.column(2))
            h = np.empty((len(batch), n), dtype=np.int32)
            for j, (a, b) in enumerate(family):
                h[:, j] = np.minimum.reduceat((values * a + b) % PRIME, bounds[:-1])
            to = pa.array(np.arange(len(batch) + 1) * n, type=pa.int32())
            columns = [batch.column(0), pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(to, pa.array(h.reshape(-1))), _binary(_sketches(values, bounds))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "h", "s"])

    return saved(lists.mapInArrow(run, f"item {dict(lists.dtypes)['item']}, n int, h array<int>, s binary"), "hashed")


def _pieces(batch: pa.RecordBatch, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, rows) for k in range(0, len(batch), rows))


def jaccard(pairs: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, cell) that reach ``least``: shared members over all members.

    Pairs of a cell are verified together, since they have items in common; those of a large one are dealt by a.
    """
    kind = dict(pairs.dtypes)["a"]
    large = saved(pairs.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > CELL_PAIRS), "large")
    some = pairs.join(F.broadcast(large) if large.limit(cells.BROADCAST_CELLS + 1).count() <= cells.BROADCAST_CELLS else large, "cell", "left")
    at = F.xxhash64("cell", F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("m") / CELL_PAIRS), F.lit(1))))
    pairs = some.select(F.col("a").alias("u"), F.col("b").alias("i"), at.alias("at"))
    own = pairs.unionByName(pairs.select("u", F.col("u").alias("i"), "at").distinct()).select("u", "i", F.lit(0.0).alias("r"), F.lit(False).alias("held"), "at")
    size = lists.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    blocks = -(-4 * size // BLOCK_BYTES)
    return neighbours.worked(own, lists.withColumnRenamed("item", "i"), neighbours.jaccard(least), f"a {kind}, b {kind}, similarity double", "alike", (), blocks)


def similar_items(members: DataFrame, bands: int, rows: int, least: float, method: str = "jaccard") -> DataFrame:
    """The pairs found by banding that reach ``least``; ``jaccard`` is the one method there is."""
    if method == "cosine":
        raise NotImplementedError("cosine similarity is not available")
    if method != "jaccard":
        raise ValueError("method must be jaccard")
    lists = _lists(members)
    hashed, met = _hashed(lists, bands * rows), None
    for lo in range(0, bands, BANDS_AT_ONCE):
        some = _banded_rows(hashed, range(lo, min(bands, lo + BANDS_AT_ONCE)), rows, "n", "s")
        part = saved(cells.pairs(some, cells.both(cells.may_reach(least), cells.first_band(rows))), "met")
        met = part if met is None else met.unionByName(part)
        released(lists.sparkSession)
    return jaccard(met, lists, least)


def _rarity(lists: DataFrame) -> np.ndarray:
    """How many items have a member of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_place(neighbours.wholes(batch.column(1), batch.column(2))[0]), minlength=PLACES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    counted = lists.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PLACES, dtype=np.int32)
    out[counted.column("place").to_numpy()] = np.minimum(counted.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def _place(values: np.ndarray) -> np.ndarray:
    return (((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(PLACES)).astype(np.int64)


def _prefixes(lists: DataFrame, least: float) -> DataFrame:
    """(item, n, s, first): the number of members, their sketch, and the n - ceil(least * n) + 1 rarest of them."""
    rarity = _rarity(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole)):
            values, bounds = neighbours.wholes(batch.column(1), batch.column(2))
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, rarity[_place(values)], row))
            wanted = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            first = order[np.arange(len(order)) - bounds[row] < wanted[row]]
            to = pa.array(np.concatenate([[0], np.cumsum(np.minimum(wanted, n))]), type=pa.int32())
            columns = [batch.column(0), pa.array(n.astype(np.int32)), _binary(_sketches(values, bounds)), pa.ListArray.from_arrays(to, pa.array(values[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "s", "first"])

    return saved(lists.mapInArrow(run, f"item {dict(lists.dtypes)['item']}, n int, s binary, first array<long>"), "prefixes")


def all_similar_items(members: DataFrame, least: float) -> DataFrame:
    """All pairs that reach ``least``, without banding, by an exact prefix join.

    Members are ranked by rarity, told by counts in PLACES; any order would do. A pair that reaches the bound shares
    a member among the first n - ceil(least * n) + 1 of each item, so only these few rare ones meet. They do so
    in slices, and pairs whose sizes and sketches forbid the similarity go at once.
    """
    lists = _lists(members)
    prefixes, met = _prefixes(lists, least), None
    slices = max(-(-(prefixes.agg(F.sum(F.size("first"))).first()[0] or 0) // PREFIX_ROWS), 1)
    for k in range(slices):
        rows = prefixes.select(F.lit(0).alias("band"), F.explode("first").alias("cell"), "item", "n", "s")
        found = cells.pairs(rows.where(F.pmod(F.xxhash64("cell"), F.lit(slices)) == k), cells.may_reach(least))
        part = saved(found.groupBy("a", "b").agg(F.min("cell").alias("cell")), "met")
        met = part if met is None else met.unionByName(part)
        released(lists.sparkSession)
    return jaccard(saved(met.groupBy("a", "b").agg(F.min("cell").alias("cell")), "pairs"), lists, least)
