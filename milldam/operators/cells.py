"""Pairs of rows that share a cell, made in memory instead of by a join, and told by a test of their columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from . import neighbours

#: Rows of a cell beyond which it is dealt into blocks; each goes to a task with the rows of the blocks after it.
CELL_ROWS = 4_096
#: Cells of more rows that are broadcast.
BROADCAST_CELLS = 100_000
#: Pairs that are made at a time, and those of a task.
PAIRS, TASK_PAIRS = 1 << 17, 20_000_000

#: Gets the columns of a task's rows; tells for places i, j and their band which of these pairs are kept.
Test = Callable[[dict[str, pa.Array]], Callable[[np.ndarray, np.ndarray, int], np.ndarray]]


def pairs(rows: DataFrame, test: Test) -> DataFrame:
    """(a, b, cell), a < b: items of ``rows`` (band, cell, item, ..) that share a band and cell and pass the test.

    An item has one row at most in a cell; a pair comes once for every cell in which it passes.
    """
    kind = dict(rows.dtypes)["item"]
    counts = rows.groupBy("band", "cell").agg(F.count("*").alias("rows_"))
    counts = saved(counts.where("rows_ > 1"), "cells")
    total = counts.agg(F.sum(F.col("rows_") * (F.col("rows_") - 1.0) / 2)).first()[0] or 0
    large = counts.where(F.col("rows_") > CELL_ROWS)
    few = large.limit(BROADCAST_CELLS + 1).count()
    dealt = rows.withColumn("unit", F.lit(0)).withColumn("first", F.lit(True))
    if few:
        known = rows.join(F.broadcast(large) if few <= BROADCAST_CELLS else large, ["band", "cell"], "left")
        block = F.pmod(F.xxhash64("item"), F.coalesce(F.ceil(F.col("rows_") / CELL_ROWS), F.lit(1)).cast("long")).cast("int")
        dealt = known.withColumn("block", block).drop("rows_").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("block")))).withColumn("first", F.col("block") == F.col("unit")).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = list(batches)
        if not sum(map(len, there)):
            return
        table = pa.Table.from_batches(there).combine_chunks()
        place = {c: table.column(c).to_numpy() for c in ("band", "cell", "unit", "first")}
        rank = np.empty(len(table), dtype=np.int64)
        rank[pc.sort_indices(table.column("item")).to_numpy()] = np.arange(len(table))
        order = np.lexsort((rank, ~place["first"], place["unit"], place["cell"], place["band"]))
        place, rank = {c: x[order] for c, x in place.items()}, rank[order]
        table = table.take(pa.array(order)).combine_chunks()
        items, keep = table.column("item").chunk(0), test({c: table.column(c).chunk(0) for c in table.column_names})
        new = np.concatenate([[True], np.any([place[c][1:] != place[c][:-1] for c in ("band", "cell", "unit")], axis=0), [True]])
        edge = np.flatnonzero(new)
        ends = np.repeat(edge[1:], np.diff(edge))
        at = np.arange(len(order))
        n = np.where(place["first"], ends - at - 1, 0)
        part = np.cumsum(n) // PAIRS
        cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (place["band"][1:] != place["band"][:-1])) + 1), len(at)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            many = n[lo:hi]
            to = np.cumsum(many)
            if not to[-1]:
                continue
            i = np.repeat(at[lo:hi], many)
            j = np.arange(to[-1]) + np.repeat(at[lo:hi] + 1 - (to - many), many)
            some = np.flatnonzero(keep(i, j, int(place["band"][lo])))
            i, j = i[some], j[some]
            turned = rank[i] > rank[j]
            a, b = np.where(turned, j, i), np.where(turned, i, j)
            yield pa.RecordBatch.from_arrays([items.take(pa.array(a)), items.take(pa.array(b)), pa.array(place["cell"][i])], names=["a", "b", "cell"])

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-total // TASK_PAIRS)))
    return dealt.repartition(tasks, "band", "cell", "unit").mapInArrow(run, f"a {kind}, b {kind}, cell long")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Arrays of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def first_band(rows: int) -> Test:
    """Pairs whose column h (whole numbers of 31 bits) agrees in the ``rows`` places of their band, and of none before it."""

    def prepare(columns: dict[str, pa.Array]) -> Callable:
        h = matrix(columns["h"], np.int64)
        codes = []
        for k in range(0, h.shape[1], rows):
            code = h[:, k]
            for j in range(1, rows):
                code = (np.unique(code, return_inverse=True)[1] if j > 1 else code) << 32 | h[:, k + j]
            codes.append(np.ascontiguousarray(code))

        def keep(i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
            out = codes[band][i] == codes[band][j]
            for code in codes[:band]:
                out &= code[i] != code[j]
            return out

        return keep

    return prepare


def may_reach(least: float) -> Test:
    """Pairs whose sizes n and sketches s allow the similarity: bits that differ are members that only one of them has."""

    def prepare(columns: dict[str, pa.Array]) -> Callable:
        n, s = columns["n"].to_numpy().astype(float), neighbours.values(columns["s"], "u8")[0].reshape(len(columns["s"]), -1)
        words = [np.ascontiguousarray(s[:, k : k + 4]) for k in range(0, s.shape[1], 4)]

        def keep(i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
            out = np.zeros(len(i), dtype=bool)
            some = np.flatnonzero(np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * least - 1e-9)
            x, y = i[some], j[some]
            left = (n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-9
            for w in words:
                left = left - np.bitwise_count(w[x] ^ w[y]).sum(axis=1)
                good = left >= 0
                some, x, y, left = some[good], x[good], y[good], left[good]
            out[some] = True
            return out

        return keep

    return prepare


def both(one: Test, two: Test) -> Test:
    """Pairs that pass both tests, the second of which sees only those that pass the first."""

    def prepare(columns: dict[str, pa.Array]) -> Callable:
        f, g = one(columns), two(columns)

        def keep(i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
            out = f(i, j, band)
            some = np.flatnonzero(out)
            out[some] = g(i[some], j[some], band)
            return out

        return keep

    return prepare
