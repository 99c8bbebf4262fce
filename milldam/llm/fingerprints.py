"""Document fingerprints from locally consistent parsing.

A text's symbols are parsed into short phrases whose ends depend only on what stands close by:
deterministic coin tossing turns neighbouring names into a few labels, and a phrase begins at every
local maximum. Phrases get names (hashes of their parts) and are parsed again, level by level, so
equal substrings share all phrases in their interior, at whatever offset they stand. A fingerprint is
a bottom-k sample of a text's phrase names, and two of them estimate how alike the phrases are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .textops import blocks, mix, powers

#: The first level whose phrases count (the last is where a text is one phrase), and the sample's size.
FIRST = 2
SAMPLE = 64
#: Bytes of text in a range of ids, and in what is parsed at once (always whole texts).
PART_BYTES = 16 << 20
SLICE_BYTES = 1 << 20


def _toss_table(n: int) -> np.ndarray:
    """For labels below ``n``: twice the lowest bit in which a label differs from its left neighbour, plus that bit."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    d = a ^ b
    low = np.bitwise_count((d & -d) - 1).astype(np.int64)
    low[d == 0] = 0
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


_TABLES = [(128, _toss_table(128)), (16, _toss_table(16)), (8, _toss_table(8))]


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, different for neighbours, that depend on a few names to the left. ``first`` marks texts' starts."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]
    d = x ^ left
    low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1))
    lab = (2 * low + ((x >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for n, table in _TABLES:
        left = np.empty_like(lab)
        left[1:] = lab[:-1]
        left[first] = lab[first] ^ 1
        lab = table[lab.astype(np.int32) * n + left]
    return lab


def _level(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names of one more level, and each text's first phrase."""
    n = len(x)
    if not n:
        return x, at
    starts = at[:-1][at[1:] > at[:-1]]
    run = np.ones(n, dtype=bool)
    run[1:] = x[1:] != x[:-1]
    run[starts] = True
    heads = np.flatnonzero(run)
    if len(heads) < n:
        long_ = np.diff(np.append(heads, n)).astype(np.uint64)
        x = x[heads]
        more = long_ > 1
        x[more] = mix(x[more] + long_[more] * np.uint64(0xA0761D6478BD642F))
        at = np.searchsorted(heads, at)
        starts = np.searchsorted(heads, starts)
        n = len(x)
    lab = _labels(x, starts)
    begin = np.zeros(n, dtype=bool)
    begin[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    ends = at[1:][at[1:] > at[:-1]]
    begin[ends - 1] = False  # a phrase is never a text's last symbol alone
    begin[starts] = True
    cut = np.flatnonzero(begin)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(x) * up[:n], out=sums[1:])
    stop = np.append(cut[1:], n)
    return mix((sums[stop] - sums[cut]) * down[cut] + (stop - cut).astype(np.uint64)), np.searchsorted(cut, at)


def phrase_samples(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of each text the SAMPLE smallest distinct names (32 bits) of its phrases from level FIRST on, sorted.

    A text is parsed until it is one phrase; if it is so below level FIRST, it counts with that
    phrase. An empty text has none.
    """
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
    x, kept, level = cps.astype(np.uint64) + np.uint64(1), [], 0
    while level < FIRST or (at[1:] - at[:-1] > 1).any():
        level += 1
        open_ = (at[1:] - at[:-1] > 1) | (level <= FIRST)  # texts that were more than one phrase
        x, at = _level(x, at)
        if level >= FIRST:
            kept.append((mix(x + np.uint64(level)) >> np.uint64(32), at, open_))
    n, keys = len(ends) - 1, []
    for names, a, open_ in kept:
        have = a[1:] - a[:-1]
        own = np.repeat(open_, have)
        keys.append(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), have)[own] | names[own])
    flat = np.sort(np.concatenate(keys))  # by text, then name
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = flat[1:] != flat[:-1]
    flat = flat[fresh]
    first = np.searchsorted(flat, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    return [flat[lo : min(hi, lo + SAMPLE)].astype(np.uint32) for lo, hi in zip(first[:-1], first[1:])]


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """The share of common names among the smallest SAMPLE of both; 1 for two empty samples."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    fresh = np.concatenate([[True], ~twice])
    shared = np.concatenate([twice, [False]])[fresh][:SAMPLE]
    return float(shared.mean())


def _encoded(x: np.ndarray) -> bytes:
    return x.astype(">u4").tobytes()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def _samples(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, ends in blocks(pa.array(texts, pa.large_string())):
        out += phrase_samples(data, ends)
    return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of about SLICE_BYTES of text."""
    for lo, hi, _, _ in blocks(batch.column(column), SLICE_BYTES):
        yield batch.slice(lo, hi - lo)


def _edit(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


#: Digests stay bytes until the end, which halves the written ranges.
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def _results(ids: list, texts: list[str], samples: list[np.ndarray], nexts: list[str], next_samples: list[np.ndarray]) -> list[pa.Array]:
    edited = [_edit(t, u) for t, u in zip(texts, nexts)]
    after = _samples(edited)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        pa.array([_encoded(x) for x in samples], pa.binary()),
        pa.array([_encoded(x) for x in after], pa.binary()),
        pa.array([likeness(x, y) for x, y in zip(samples, after)], pa.float64()),
        pa.array([likeness(x, y) for x, y in zip(samples, next_samples)], pa.float64()),
    ]


HEAD, TAIL = 1, 2


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns part, doc_id, text of one range in order: the result of every row but the last, and the
    first and last row themselves (end HEAD or TAIL), which meet the neighbouring ranges later."""

    def border(end: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        empty = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([end], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string()), *empty], names=names)

    names, held, part = ["end", "part", "text", *_NAMES], None, 0
    for batch in (some for whole in batches if whole.num_rows for some in _slices(whole, 2)):
        ids, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
        samples = _samples(texts)
        if held is None:
            part = batch.column(0)[0].as_py()
            yield border(HEAD, part, ids[0], texts[0])
        else:
            ids, texts, samples = ([a, *b] for a, b in zip(held, (ids, texts, samples)))
        held = (ids[-1], texts[-1], samples[-1])
        n = len(ids) - 1
        if n:
            columns = _results(ids[:n], texts[:n], samples[:n], texts[1:], samples[1:])
            flags = [pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*flags, *columns], names=names)
    if held is not None:
        yield border(TAIL, part, held[0], held[1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, after: the result of each row."""
    for batch in (some for whole in batches for some in _slices(whole, 1)):
        ids, texts, nexts = (batch.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays(_results(ids, texts, _samples(texts), nexts, _samples(nexts)), names=_NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs`` (doc_id, text).

    The next document is the one after it by descending id (rows of one id by a hash of their text,
    null ids last), the first after the last; so a lone document is its own next. The edited text
    gives up its last third to the beginning of the next. A null text counts as empty, and an empty
    text has an empty fingerprint. Equal texts have equal fingerprints. An empty table gives no rows.

    Rows are dealt to ranges of that order, as many as the texts have PART_BYTES. Only the first and
    last row of a range meet their neighbours in a join.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.repartitionByRange(1 + size // PART_BYTES, *order).sortWithinPartitions(*order)
    flags = "end int, part int, text string, "
    done = scratch.save(ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_range, flags + RESULT), "ranges")
    heads = done.where(F.col("end") == HEAD).select("part", F.col("text").alias("after"))
    tails = done.where(F.col("end") == TAIL).select("part", "doc_id", "text")
    # A row per range: the range that comes after it, the first after the last.
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(everything))
    turns = heads.select("part").select("part", following.alias("next"))
    pairs = tails.join(turns, "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")
    out = done.where(F.col("end") == 0).select(*_NAMES).unionByName(pairs.mapInArrow(_pairs, RESULT))
    digests = {"edited_sha256", "fingerprint", "edited_fingerprint"}
    return out.select(*(F.lower(F.hex(c)).alias(c) if c in digests else c for c in _NAMES))
