"""Secret scans: fixed patterns, and values in credential context judged by their guess cost.

A value's cost is the cheapest way to write it as words, dates, repeats, keyboard walks or sequences
and brute-force spans, in bits; dynamic programming over its prefixes finds it. Placeholders and
words stay cheap, random keys do not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import with_scores
from .textops import LOWER, blocks, spans

KINDS = ("assign", "access", "hex", "guess")
#: Bits from which a value in credential context is a span of kind ``guess``.
LEAST_BITS = 40.0

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_KEY_WORD = re.compile(
    rb"(?i)pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|signing|encryption)[_-]?key|auth(?:orization)?|credentials?|cred|login|bearer"
)
_KEY_CHARS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_AFTER = re.compile(rb"[=>]?[\x20\t]*(?:(?i:bearer|basic)[\x20\t]+)?[\"'`]?([^\x00-\x20\"'`,;<>()\[\]{}\x7F-\xFF]{6,})")

#: Words that rank first, commonest first; a word's cost is the logarithm of its place. The corpus' own follow.
WORDS = (
    "password pass word admin secret login welcome letmein monkey dragon master hello freedom shadow sunshine princess football "
    "baseball superman batman michael jordan charlie test testing example sample default changeme change me user guest root system "
    "server service token key api access private public auth value string your my the and for with none null true false "
    "placeholder xxx foo bar baz qux demo dummy temp temporary internal local localhost database data mysql postgres redis mongo "
    "oracle client session cookie bearer basic credential credentials please insert here enter replace todo fixme unknown redacted "
    "hidden removed love summer winter spring autumn monday friday january december google facebook github config setting settings "
    "production staging develop development env environment variable name file path url http https www com org net"
).split()
#: Documents that a word must stand in to enter the dictionary, its length, and the words that enter.
LEAST_DOCUMENTS, WORD_LENGTH, DICTIONARY = 20, (3, 20), 5_000


class Dictionary:
    """Ranks of the fixed words and, after them, of ``learned`` words, commonest first."""

    def __init__(self, learned: list[str] = ()):
        self.rank: dict[str, int] = {}
        for w in [*WORDS, *learned]:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


_FIXED = Dictionary()
_PLAIN = str.maketrans("@4301$5!7", "aaeoissit")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {}
for _r, _row in enumerate(_ROWS):
    for _i, _ch in enumerate(_row):
        _NEXT[_ch] = {_row[j] for j in (_i - 1, _i + 1) if 0 <= j < len(_row)}
        for _q in (_r - 1, _r + 1):
            if 0 <= _q < len(_ROWS):
                _NEXT[_ch] |= {_ROWS[_q][j] for j in (_i - 1, _i, _i + 1) if 0 <= j < len(_ROWS[_q])}
_DATE = re.compile(
    r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
)


def _class_bits(value: str) -> float:
    """Bits of one brute-force character among the classes that the value uses."""
    size = 0
    if re.search("[a-z]", value):
        size += 6 if not re.search("[g-zA-Z]", value) and re.search("[0-9]", value) else 26
    size += 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[^A-Za-z0-9]", value))
    return math.log2(max(size, 2))


def _fixed(value: str, words: Dictionary) -> Iterator[tuple[int, int, float]]:
    """Start, end and bits, by start, of every cheap span but keyboard walks: a bounded number at each place."""
    low, n = value.lower(), len(value)
    plain = low.translate(_PLAIN)
    again = []  # by period: how far each place's characters come again after it
    for size in range(1, min(8, n // 2) + 1):
        far = [0] * (n + 1)
        for i in range(n - size - 1, -1, -1):
            far[i] = far[i + 1] + 1 if value[i] == value[i + size] else 0
        again.append(far)
    stairs = [0] * (n + 1)  # how many steps like the one that begins here follow each other
    for i in range(n - 2, -1, -1):
        if abs(step := ord(low[i + 1]) - ord(low[i])) == 1:
            stairs[i] = stairs[i + 1] + 1 if i + 2 < n and ord(low[i + 2]) - ord(low[i + 1]) == ord(low[i + 1]) - ord(low[i]) else 1
    for i in range(n):
        if value[i] in "_-. /":
            yield i, i + 1, 2.0
        for j in range(i + 2, min(n, i + words.longest) + 1):
            for text, more in ((low, 0.0), (plain, 2.0)):
                if (rank := words.rank.get(text[i:j])) is not None:
                    own = value[i:j]
                    case = 0.0 if own == own.lower() else 1.0 if own == own.upper() or own == own.capitalize() else float(j - i)
                    yield i, j, math.log2(rank) + 1 + more + case
                    break
        if m := _DATE.match(value, i):
            year = int((re.search(r"(?:19|20)\d\d", m[0]) or [m[0][:4]])[0])
            bits = math.log2(abs(year - 2020) + 20) + (math.log2(366) + 2 if len(m[0]) > 4 else 0)
            yield i, m.end(), bits
        for size, far in enumerate(again, 1):
            times = far[i] // size + 1
            if times >= (3 if size == 1 else 2):
                yield i, i + times * size, size * _class_bits(value[i : i + size]) + math.log2(times)
        if stairs[i] >= 2:
            yield i, i + stairs[i] + 1, math.log2(36) + math.log2(stairs[i] + 1) + 1.0


class _Walks:
    """Keyboard walks: key to neighbouring key, held keys in between, from 4 characters on, ending anywhere."""

    def __init__(self, value: str):
        low = value.lower()
        codes, n = [ord(c) for c in low], len(low)
        self.begins = [t + 1 < n and low[t + 1] in _NEXT.get(low[t], ()) for t in range(n)]
        goes = [b or (t + 1 < n and low[t + 1] == low[t] and low[t] in _NEXT) for t, b in enumerate(self.begins)]
        self.stop = [0] * n  # where the run of a place ends
        self.turns = [0] * n  # turns up to a place
        for t in range(n - 1, -1, -1):
            self.stop[t] = self.stop[t + 1] if goes[t] else t + 1
        for t in range(1, n):
            self.turns[t] = self.turns[t - 1] + (t + 1 < n and codes[t + 1] - codes[t] != codes[t] - codes[t - 1])
        #: Starts, the best for the next ends last, each up to the end from which the one before it is better.
        self.kept: list[tuple[int, int]] = []

    def bits(self, i: int, end: int) -> float:
        return math.log2(47) + math.log2(end - i) + 1.0 + 1.1 * (self.turns[end - 2] - self.turns[i])

    def cheapest(self, end: int, best: list[float]) -> float:
        """The least cost of a segmentation up to ``end`` whose last piece is a walk; ends come in order.

        A longer walk's logarithm grows slower, so once an earlier start is better it stays so, and a
        stack with the places of change holds all starts that can still win.
        """
        kept, i = self.kept, end - 4
        if i < 0:
            return math.inf
        if kept and self.stop[kept[-1][0]] < end:
            kept.clear()

        def cost(start: int, at: int) -> float:
            return best[start] + self.bits(start, at) + (1.0 if start else 0.0)

        if self.begins[i] and self.stop[i] >= end:
            while kept and kept[-1][1] < end:
                kept.pop()
            if not kept or cost(i, end) < cost(kept[-1][0], end):
                while kept and cost(i, kept[-1][1]) < cost(*kept[-1]):
                    kept.pop()
                until = self.stop[i]
                if kept:
                    lo, hi = end, kept[-1][1]  # better at lo, not at hi
                    while hi - lo > 1:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if cost(i, mid) < cost(kept[-1][0], mid) else (lo, mid)
                    until = lo
                kept.append((i, until))
        while kept and kept[-1][1] < end:
            kept.pop()
        return cost(kept[-1][0], end) if kept else math.inf


def _pieces(value: str, words: Dictionary = _FIXED) -> list[tuple[int, int, float]]:
    """Start, end and bits of every span that is cheaper than brute force."""
    walks = _Walks(value)
    return [*_fixed(value, words), *((i, j, walks.bits(i, j)) for i, b in enumerate(walks.begins) if b for j in range(i + 4, walks.stop[i] + 1))]


def guess_bits(value: str, words: Dictionary = _FIXED) -> float:
    """The cheapest segmentation of ``value``, in bits; each piece after the first costs one bit more.

    Time grows with the length (and the logarithm of the longest walk).
    """
    char, walks, fixed = _class_bits(value), _Walks(value), _fixed(value, words)
    ahead: dict[int, float] = {}  # the least cost of fixed pieces that end there
    best, brute = [0.0], [math.inf]  # any last piece; a brute-force last piece
    piece = next(fixed, None)
    for j in range(1, len(value) + 1):
        while piece and piece[0] < j:
            i, end, bits = piece
            ahead[end] = min(ahead.get(end, math.inf), best[i] + bits + (1.0 if i else 0.0))
            piece = next(fixed, None)
        open_ = min(brute[j - 1] + char, best[j - 1] + char + (1.0 if j > 1 else 0.0))
        brute.append(open_)
        best.append(min(open_, ahead.pop(j, math.inf), walks.cheapest(j, best)))
    return best[-1]


def _credential(raw: bytes, at: int) -> bool:
    """Whether the name before the mark at ``at`` holds a key word, wherever in it and however far off.

    Names and the blanks after them belong to one mark each, so all marks of a text take one pass.
    """
    i = at - 1 if at and raw[at - 1] == 58 else at
    while i and raw[i - 1] in b" \t":
        i -= 1
    for closing in (b"]", b"\"'"):
        if i and raw[i - 1] in closing:
            i -= 1
    j = i
    while j and raw[j - 1] in _KEY_CHARS:
        j -= 1
    return _KEY_WORD.search(raw, j, i) is not None


def find_spans(raw: bytes, hexes: list[tuple[int, int]], marks: list[int], words: Dictionary = _FIXED) -> tuple[list[tuple[int, int, int]], float | None]:
    """(start, kind, end) in bytes, in order, and the highest cost of a value in credential context.

    ``hexes`` are the runs of kind hex, ``marks`` the places of ``:`` and ``=``.
    """
    out = [(a, 2, b) for a, b in hexes]
    out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    top, judged = None, -1
    for at in marks:
        if at < judged or not _credential(raw, at) or not (m := _AFTER.match(raw, at + 1)):
            continue
        judged = m.end()
        bits = guess_bits(m[1].decode("ascii"), words)
        top = bits if top is None else max(top, bits)
        if bits >= LEAST_BITS:
            out.append((m.start(1), 3, m.end(1)))
    return sorted(out), top


def _all(low: bytes, key: bytes) -> list[int]:
    found, at = [], low.find(key)
    while at >= 0:
        found.append(at)
        at = low.find(key, at + 1)
    return found


def _text(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan_batch(column: pa.Array, words: Dictionary = _FIXED) -> dict[str, list]:
    n = len(column)
    counts = np.zeros((n, 3), dtype=np.int64)
    sha, text, top = [_EMPTY] * n, [""] * n, [None] * n
    for lo, _, data, ends in blocks(column):
        low = LOWER[data].tobytes()
        marks = np.flatnonzero((data == 58) | (data == 61))
        a, b = spans(_HEX[data], ends)
        long_ = b - a >= 24
        a, b = a[long_], b[long_]
        hits = [at for key in _ASSIGN_KEYS for at in _all(low, key)] + _all(data.tobytes(), b"AKIA")
        places = np.concatenate([marks, a, np.array(hits, dtype=np.int64)])
        for i in np.unique(np.searchsorted(ends, places, side="right") - 1).tolist():
            s, e = int(ends[i]), int(ends[i + 1])
            mine = slice(*np.searchsorted(a, [s, e]))
            own = [(x - s, y - s) for x, y in zip(a[mine].tolist(), b[mine].tolist())]
            found, bits = find_spans(data[s:e].tobytes(), own, (marks[slice(*np.searchsorted(marks, [s, e]))] - s).tolist(), words)
            if found:
                points = np.concatenate([[0], np.cumsum((data[s:e] & 0xC0) != 0x80)])
                found = [(int(points[x]), k, int(points[y])) for x, k, y in found]
                base = [f for f in found if f[1] < 3]
                counts[lo + i] = np.bincount([f[1] for f in base], minlength=3)
                sha[lo + i] = hashlib.sha256(_text(base).encode()).hexdigest()
                text[lo + i] = _text(found)
            top[lo + i] = bits
    return {"n_assign": counts[:, 0], "n_access": counts[:, 1], "n_hex": counts[:, 2], "base_sha256": sha, "spans": text, "guess_bits": pa.array(top, pa.float64())}


def dictionary(docs: DataFrame) -> Dictionary:
    """The DICTIONARY words that stand in most documents of the whole corpus, in LEAST_DOCUMENTS or more."""
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    words = F.filter(words, lambda w: F.length(w).between(*WORD_LENGTH))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_DOCUMENTS)
    return Dictionary([r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(DICTIONARY).collect()])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, guess_bits for every row of ``docs`` (doc_id, text).

    spans lists kind:start:end (code points, end exclusive) by start, then kind; base_sha256 is the
    digest of that list without the kind ``guess``, which has the values in credential context that
    take LEAST_BITS bits or more to guess, with the corpus' commonest words in the dictionary. guess_bits is the highest cost of such a value (null:
    none). Null and empty texts have no spans. Rows are scanned one by one, so repeats and null ids
    need no care; an empty table gives no rows.
    """
    types = {n: T.LongType() for n in ("n_assign", "n_access", "n_hex")}
    types |= {"base_sha256": T.StringType(), "spans": T.StringType(), "guess_bits": T.DoubleType()}
    words = dictionary(docs)
    return with_scores(docs.select("doc_id", "text"), lambda column: scan_batch(column, words), types).drop("text")
