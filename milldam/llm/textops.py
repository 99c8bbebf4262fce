"""Whole-batch text primitives on the UTF-8 buffers of Arrow string columns (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words made of ASCII letters, digits and all beyond ASCII.
WORDY = np.zeros(256, dtype=bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = True
WORDY[128:] = True

_B = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n; kept up to 64 blocks' length."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, BLOCK_BYTES * 2)
        ups = []
        for base in (_B, pow(_B, -1, 2**64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            ups.append(np.cumprod(steps, dtype=np.uint64))
        if size > 64 * BLOCK_BYTES:
            return ups[0], ups[1]
        _powers["up"], _powers["down"] = ups
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (always whole texts): first row, end row, bytes, offsets from 0."""
    data, ends = utf8(column)
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def spans(mask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` that do not cross texts."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[ends] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | cut[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes at any place.

    Spans come by start and do not overlap. They are worked through in pieces, so that besides the
    result memory is bounded by the longest span, not by the longest text.
    """
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, side="right")))
        piece, a, b = data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo
        up, down = powers(len(piece))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def row_bounds(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For spans by start, where each text's first span lies (one more than there are texts)."""
    return np.searchsorted(starts, ends, side="left")


def words(data: np.ndarray, ends: np.ndarray, keep: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words: their hashes, each text's first word (and the end), their starts."""
    low = LOWER[data]
    a, b = spans(keep[low], ends)
    return hash_spans(low, a, b), row_bounds(a, ends), a
