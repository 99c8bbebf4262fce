"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A text is parsed
greedily into the longest phrases that occur in the sample; phrases times the bits that point into
the sample is the cost, and the cheapest language wins. Automata are stored as dense tables whose
entries already contain the restart after a phrase, so a step is one lookup, taken for many blocks
of text and all languages at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import fold, with_scores
from .textops import blocks

MODULUS, HELD = 4, 2
#: Sample rows of a language (in expectation), characters taken of each, symbols per language and over all.
SAMPLE_ROWS = 150
SAMPLE_CHARS = 16_000
SYMBOLS = 20_000
SYMBOLS_ALL = 400_000
#: Languages whose sampling rates may be broadcast to the texts.
BROADCAST_LANGUAGES = 10_000
#: The frequent letters with symbols of their own; 0 pads, 1 is all that is no letter, 2 letters of no sample.
LETTERS = 60
#: Each other letter of the samples is a row of digits to this base; the first digits have symbols apart.
DIGITS = 16
#: A text is parsed in stretches of so many symbols, which bounds the lanes whatever its length.
STRETCH = 512
#: The first stretch of every text is parsed from so many starts and counts with their mean, which settles ties.
STARTS = 8
UNKNOWN = "und"


def _automaton(s: list[int]) -> tuple[list[dict[int, int]], int]:
    """The suffix automaton of ``s``: transitions by state, root first."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go, len(go)


class LanguageModel:
    """Symbols, and one table for all languages' automata."""

    def __init__(self, samples: dict[str, list[str]]):
        samples = {name: texts for name, texts in samples.items() if any(ch.isalpha() for text in texts for ch in text)}
        self.languages = sorted(samples)
        letters: dict[str, int] = {}
        for texts in samples.values():
            for text in texts:
                for ch in text.lower():
                    if ch.isalpha():
                        letters[ch] = letters.get(ch, 0) + 1
        common = sorted(letters, key=lambda ch: (-letters[ch], ch))[:LETTERS]
        number = {ch: i + 3 for i, ch in enumerate(common)}
        self.width = 3 + len(common)
        rare = sorted(letters.keys() - number.keys(), key=lambda ch: (-letters[ch], ch))
        places = 1
        while DIGITS**places < len(rare):
            places += 1
        more = {}  # a rare letter's digits after the first
        for i, ch in enumerate(rare):
            first, *rest = (i // DIGITS**k % DIGITS for k in range(places - 1, -1, -1))
            number[ch] = self.width + first
            more[ch] = [self.width + DIGITS + digit for digit in rest]
        if rare:
            self.width += 2 * DIGITS
        #: The (first) symbol of each code point, which ones have more, and those.
        self.symbol = np.ones(0x110000, dtype=np.uint8)
        self.long = np.zeros(0x110000, dtype=bool)
        self.more = np.zeros((0x110000 if places > 1 else 0, places - 1), dtype=np.uint8)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()[0]
                self.symbol[cp] = number.get(low, 2)
                if more.get(low):
                    self.long[cp] = True
                    self.more[cp] = more[low]
        budget = min(SYMBOLS, SYMBOLS_ALL // max(1, len(self.languages)))
        tables, self.bits, self.base, at = [], [], [], 0
        for name in self.languages:
            s: list[int] = []
            for text in samples[name]:
                cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                sym = self._collapsed(self._symbols(cps)[0])
                s += sym[: budget - len(s)].tolist() + [1]
                if len(s) >= budget:
                    break
            go, n = _automaton(s)
            table = np.zeros((n, self.width), dtype=np.int64)
            start = np.array([go[0].get(c, 0) for c in range(self.width)])
            table[:] = (start * self.width + at) * 2 + 1
            for state, edges in enumerate(go):
                for c, to in edges.items():
                    table[state, c] = (to * self.width + at) * 2
            table[:, 0] = (np.arange(n) * self.width + at) * 2
            tables.append(table.ravel())
            self.base.append(at)
            self.bits.append(len(s) + 2)
            at += n * self.width
        # All pointers cost as in the largest sample: cheap pointers into a tiny one would win every text.
        self.bits = [float(np.log2(max(self.bits, default=2)))] * len(self.bits)
        self.table = np.concatenate(tables).astype(np.int32 if at < 2**30 else np.int64) if tables else np.zeros(0, np.int32)

    def _symbols(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of code points, and where each begins (and the end)."""
        first, long_ = self.symbol[cps], self.long[cps]
        extra = self.more.shape[1]
        if not extra or not long_.any():
            return first, np.arange(len(cps) + 1)
        at = np.concatenate([[0], np.cumsum(1 + extra * long_)])
        sym = np.empty(at[-1], dtype=np.uint8)
        sym[at[:-1]] = first
        sym[at[:-1][long_][:, None] + np.arange(1, extra + 1)] = self.more[cps[long_]]
        return sym, at

    @staticmethod
    def _collapsed(sym: np.ndarray) -> np.ndarray:
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1)
        return sym[keep]

    def _parse(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane (columns of symbols, padded with 0) for each language."""
        n = lanes.shape[1]
        cur = np.repeat(np.array(self.base, dtype=self.table.dtype)[:, None], n, axis=1)
        count = np.ones((len(self.languages), n), dtype=np.int32)
        first = True
        for row in lanes:
            v = self.table.take(cur + row)
            if first:  # the phrase that begins a lane is counted already
                first = False
            else:
                count += v & 1
            cur = v >> 1
        return count

    def costs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per text and language, and each text's letters."""
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[ends]
        letters = np.concatenate([[0], np.cumsum(self.symbol[cps] != 1)])
        letters = letters[at[1:]] - letters[at[:-1]]
        sym, begin = self._symbols(cps)
        at = begin[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1)
        keep[at[:-1][at[:-1] < len(sym)]] = True
        place = np.concatenate([[0], np.cumsum(keep)])[at]
        sym = sym[keep]
        n = place[1:] - place[:-1]
        starts, parts = np.minimum(n, STARTS), -(-n // STRETCH)
        lanes_of = starts + np.maximum(parts - 1, 0)
        owner = np.repeat(np.arange(len(n)), lanes_of)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        own, some = place[owner], starts[owner]
        first_ = nth < some  # the first stretch from one of its starts; else a later stretch
        start = own + np.where(first_, nth, (nth - some + 1) * STRETCH)
        stop = np.minimum(place[owner + 1], np.where(first_, own, start) + STRETCH)
        share = np.where(first_, 1.0 / np.maximum(some, 1), 1.0)
        total = np.zeros((len(self.languages), len(n)))
        order = np.argsort(start - stop, kind="stable")
        padded = np.concatenate([sym, np.zeros(STRETCH, dtype=np.uint8)])
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            length = (stop - start)[some]
            steps = np.arange(length.max())[:, None]
            lanes = padded[start[some] + steps]
            lanes[steps >= length] = 0
            phrases = self._parse(lanes)
            for k in range(len(self.languages)):
                total[k] += np.bincount(owner[some], weights=phrases[k] * share[some], minlength=len(n))
        return (total * np.array(self.bits)[:, None]).T, letters

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1: no letter, or nothing learned) and the confidence."""
        best, score = np.full(len(column), -1), np.zeros(len(column))
        if self.languages:
            for lo, hi, data, ends in blocks(column):
                cost, letters = self.costs(data, ends)
                win = cost.argmin(axis=1)
                p = np.exp(-(cost - cost.min(axis=1, keepdims=True)) * np.log(2) / 4)
                some = letters > 0
                best[lo:hi] = np.where(some, win, -1)
                score[lo:hi] = np.where(some, 1 / p.sum(axis=1), 0.0)
        return best, score

    def __call__(self, column: pa.Array) -> dict[str, np.ndarray]:
        best, score = self.predict(column)
        return {"lang_pred": np.array([*self.languages, UNKNOWN], dtype=object)[best], "score": score}


def learned(docs: DataFrame, modulus: int = MODULUS, held: int = HELD) -> LanguageModel:
    """A model of every non-null ``lang`` outside the held-out fold, from a hashed sample of its rows with letters.

    A text gives its first SAMPLE_CHARS characters from its first letter on. The row drawn first is
    always in the sample, so a language is left out only if none of its rows has a letter.
    """
    rows = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), modulus) != held) & F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.struct(draw.alias("draw"), F.xxhash64("text").alias("key")).alias("draw"))
    counts = rows.groupBy("lang").agg((F.lit(SAMPLE_ROWS) / F.count("*")).alias("rate"), F.min("draw").alias("first"))
    counts = counts.withColumnRenamed("lang", "name")
    rates = counts.collect()  # a row per language
    if len(rates) <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    some = rows.join(counts, F.col("lang") == F.col("name")).where((F.col("draw.draw") < F.col("rate")) | (F.col("draw") == F.col("first")))
    cut = F.substring(F.regexp_replace("text", r"^[^\p{L}]+", ""), 1, SAMPLE_CHARS)
    some = some.select("lang", cut.alias("text"), F.col("draw.draw").alias("draw")).distinct()
    samples: dict[str, list[str]] = {r["name"]: [] for r in rates}
    seen = set()
    for r in sorted(some.collect(), key=lambda r: (r["draw"], r["text"])):
        if r["text"] and (r["lang"], r["text"]) not in seen:
            seen.add((r["lang"], r["text"]))
            samples[r["lang"]].append(r["text"])
    return LanguageModel(samples)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    lang_pred is a learned value of lang, or ``und`` (score 0) if the text is null or has no letter, or
    nothing was learned. Of equal costs the first language by name wins. Rows are parsed one by one,
    so repeats and null ids need no care; an empty table gives no rows.
    """
    out = with_scores(docs.select("doc_id", "text"), learned(docs), {"lang_pred": T.StringType(), "score": T.DoubleType()})
    return out.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "lang_pred", "score")
