"""Toxicity from a convolutional text classifier in numpy.

Hashed embeddings of words and of their beginnings, added up, pass through filters of several widths; the largest response of each filter
over the whole text feeds a logistic layer. When scoring, embedding times filter is a table, so a
filter costs one lookup for each word and place. Each language (told from the text) has a threshold
of its own, moved to a score of 0.5.

Every labelled row outside the held-out fold teaches with its whole text: four of five the weights,
the fifth the thresholds. Rows are dealt into shards; each shard's worker goes on from the common
model, and the workers' models are joined after every pass. Languages are told by word counts of
all rows with a language outside the fold.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import PARTS, Adam, fold, labelled_rows, sigmoid, sliced, summed, with_scores
from .store import Scratch
from .textops import LOWER, WORDY, blocks, hash_spans, mix, row_bounds, spans

MODULUS, HELD = 5, 0
BUCKETS = 1 << 15
SIZE, FILTERS, WIDTHS = 12, 16, (1, 2, 3)
STEPS, BATCH = 500, 32
#: One of so many labelled rows sets the thresholds, the others the weights.
HOLD_OUT = 5
#: Rows and bytes of text of a shard, in expectation.
SHARD_ROWS, SHARD_BYTES = 8_000, 32 << 20
#: How many times as often the first shard's worker at most goes over its rows before the others begin.
WARM = 2
#: Calibration rows of either label that a language needs for a threshold of its own.
LEAST = 15
#: Bytes of a word whose embedding is shared by all words that begin so.
BEGINNING = 4
PAD = max(WIDTHS) - 1
#: Places whose responses are held at a time; the largest of each text is carried on from piece to piece.
PLACES = 1 << 16
#: Cells of log-odds in which the rows that set the thresholds are counted, to the unit.
CELLS = 256
#: Weight of all languages' words in each language's.
COMMON = 0.1


def word_ids(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their first BEGINNING bytes (two rows), with PAD paddings (bucket 0)
    after each text, and each text's first place."""
    low = LOWER[data]
    a, b = spans(WORDY[low], ends)
    n = np.diff(row_bounds(a, ends))
    to = np.concatenate([[0], np.cumsum(n + PAD)])
    out = np.zeros((2, to[-1]), dtype=np.int32)
    place = np.arange(len(a)) + np.repeat(np.arange(len(n)) * PAD, n)
    for row, stop in enumerate((b, np.minimum(b, a + BEGINNING))):
        h = mix(hash_spans(low, a, stop) + np.uint64(row))
        out[row, place] = (h >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1) + 1
    return out, to


def texts_ids(column: pa.Array) -> list[np.ndarray]:
    """word_ids of each text."""
    out = []
    for _, _, data, ends in blocks(column):
        ids, at = word_ids(data, ends)
        out += np.split(ids, at[1:-1], axis=1)
    return out


def pieces(at: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Ranges of PLACES places: first and end place, first and end text, and where those texts begin in the range."""
    for lo in range(0, at[-1], PLACES):
        hi = min(lo + PLACES, at[-1])
        first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi)
        yield lo, hi, first, last, np.maximum(at[first:last], lo) - lo


class LanguageWords:
    """Tells languages by the frequencies of their words and words' beginnings; unseen words favour none."""

    def __init__(self, languages: list[str | None], counts: np.ndarray):
        self.languages = languages
        counts = counts.astype(np.float64)
        counts[:, 0] = 0
        common = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
        own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.table = np.log((1 - COMMON) * own + COMMON * common).T.copy()
        self.table[0] = 0

    def tell(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index of each text's language, -1 of a text without words."""
        fit = np.zeros((len(at) - 1, len(self.languages)))
        for lo, hi, first, last, inside in pieces(at):
            for row in ids:
                fit[first:last] += np.add.reduceat(self.table.take(row[lo:hi], axis=0), inside, axis=0)
        return np.where(np.diff(at) > PAD, fit.argmax(axis=1), -1)


class ToxicityModel:
    def __init__(self, languages: LanguageWords | None = None):
        rng = np.random.default_rng(5)
        self.languages = languages
        self.embed = rng.normal(0, 0.3, (BUCKETS, SIZE)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (SIZE * w) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        self.const = np.zeros(1, dtype=np.float32)
        self.dense = Adam([*self.filters, self.bias, self.out, self.const], 0.01)
        self.seen = np.full(BUCKETS, 1e-6, dtype=np.float32)
        #: Thresholds by language, and that of all other texts.
        self.cuts = np.zeros(1)
        self.prior = 0.5
        self.ready = False

    def _responses(self, tables: list[np.ndarray], ids: np.ndarray) -> list[np.ndarray]:
        """Each width's filter responses at every place but the last PAD; 0 at paddings, whose windows reach into the next text."""
        out, n = [], ids.shape[1] - PAD
        padding = np.flatnonzero(ids[0, :n] == 0)
        for w, table in zip(WIDTHS, tables):
            r = table[0].take(ids[0, :n], axis=0)
            for row in range(2):
                for j in range(1 - row, w):
                    r += table[j].take(ids[row, j : n + j], axis=0)
            r[padding] = 0
            out.append(r)
        return out

    def _tables(self, embed: np.ndarray) -> list[np.ndarray]:
        return [np.einsum("vs,wsf->wvf", embed, f, optimize=True) for f in self.filters]

    def train(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, passes: int, seed: int) -> None:
        """Goes over all texts ``passes`` times, in batches of another order each time."""
        rng = np.random.default_rng([6, seed])
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                self._step([docs[i] for i in some], y[some], weight[some])

    def _step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        flat = np.concatenate([*docs, np.zeros((2, PAD), dtype=np.int32)], axis=1)
        at = np.concatenate([[0], np.cumsum([d.shape[1] for d in docs])])
        used = np.flatnonzero(np.bincount(flat[0], minlength=BUCKETS) + np.bincount(flat[1], minlength=BUCKETS))
        place = np.zeros(BUCKETS, dtype=np.int32)
        place[used] = np.arange(len(used))
        code = place[flat]
        embed = self.embed[used]
        tables = self._tables(embed)
        top = np.full((len(docs), len(self.bias)), -np.inf, dtype=np.float32)
        best = np.zeros(top.shape, dtype=np.int64)
        for lo, hi, first, last, inside in pieces(at):
            r = np.concatenate(self._responses(tables, code[:, lo : hi + PAD]), axis=1)
            for i, a, b in zip(range(first, last), inside, [*inside[1:], hi - lo]):
                k = r[a:b].argmax(axis=0)
                v = r[a + k, np.arange(r.shape[1])]
                more = v > top[i]
                top[i, more], best[i, more] = v[more], (lo + a + k)[more]
        top += self.bias
        live = top > 0
        pooled = top * live
        g = ((sigmoid(pooled @ self.out + self.const) - y) * weight / len(y)).astype(np.float32)
        back = g[:, None] * self.out * live
        g_embed = np.zeros_like(embed)
        g_filters = []
        for k, w in enumerate(WIDTHS):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            gk = back[:, mine] * (code[0, best[:, mine]] != 0)
            gf = np.zeros_like(self.filters[k])
            for j in range(w):
                for word in code[:, best[:, mine] + j]:
                    gf[j] += np.einsum("dfs,df->sf", embed[word], gk)
                    np.add.at(g_embed, word.ravel(), (gk[:, :, None] * self.filters[k][j].T[None]).reshape(-1, SIZE))
            g_filters.append(gf + 1e-5 * self.filters[k])
        self.dense.step([*g_filters, back.sum(axis=0), pooled.T @ g + 1e-4 * self.out, g.sum(keepdims=True)])
        self.seen[used] += (g_embed**2).mean(axis=1)
        change = 0.1 * g_embed / np.sqrt(self.seen[used])[:, None]
        change[used == 0] = 0
        self.embed[used] -= change

    def _shared(self) -> list[np.ndarray]:
        return [*self.dense.params, *self.dense.m, *self.dense.v]

    def changes(self, start: ToxicityModel, rows: int) -> dict[str, np.ndarray]:
        """What a worker that began at ``start`` and saw so many rows gives to ``join``."""
        gained = self.seen - start.seen
        dense = np.concatenate([*(x.ravel() for x in self._shared()), [self.dense.t, 1.0]])
        return {"dense": dense * rows, "gained": gained, "moved": (self.embed - start.embed) * gained[:, None]}

    def join(self, total: dict[str, np.ndarray]) -> None:
        """Goes on from the sums of all workers' changes: filters weigh by rows, each embedding by its gradients' squares,
        so that a word of one shard only moves as far as there."""
        dense = total["dense"] / total["dense"][-1]
        for x in self._shared():
            x[...] = dense[: x.size].reshape(x.shape)
            dense = dense[x.size :]
        self.dense.t = int(dense[0])
        gained = total["gained"][:, None]
        self.embed += np.divide(total["moved"].reshape(BUCKETS, SIZE), gained, out=np.zeros((BUCKETS, SIZE)), where=gained > 0).astype(np.float32)
        self.seen += total["gained"].astype(np.float32)

    def _raw(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log-odds of each text before its language's threshold is taken off."""
        flat = np.concatenate([*docs, np.zeros((2, PAD), dtype=np.int32)], axis=1)
        at = np.concatenate([[0], np.cumsum([d.shape[1] for d in docs])])
        if not hasattr(self, "_cached"):
            self._cached = self._tables(self.embed)
        top = np.full((len(docs), len(self.bias)), -np.inf, dtype=np.float32)
        for lo, hi, first, last, inside in pieces(at):
            here = [np.maximum.reduceat(x, inside, axis=0) for x in self._responses(self._cached, flat[:, lo : hi + PAD])]
            np.maximum(top[first:last], np.concatenate(here, axis=1), out=top[first:last])
        top += self.bias
        return (np.maximum(top, 0) * self.out).sum(axis=1, dtype=float) + float(self.const[0])  # the same in any batch

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cached"}

    def judged(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log-odds, and the index of its threshold."""
        raw, kind = np.zeros(len(column)), np.full(len(column), -1)
        for lo, hi, data, ends in blocks(column):
            ids, at = word_ids(data, ends)
            raw[lo:hi] = self._raw(np.split(ids, at[1:-1], axis=1))
            if self.languages and self.languages.languages:
                kind[lo:hi] = self.languages.tell(ids, at)
        return raw, kind

    def __call__(self, column: pa.Array) -> dict[str, np.ndarray]:
        if not self.ready:
            return {"score": np.full(len(column), self.prior)}
        raw, kind = self.judged(column)
        return {"score": sigmoid(raw - self.cuts[kind])}


def _cut(cells: dict[int, tuple[int, int]]) -> float:
    """The log-odds between the labels with the least sum of both labels' error shares; of equals the middle.

    ``cells`` has the rows of label 0 and of label 1 in each cell of log-odds.
    """
    v = np.array(sorted(cells), dtype=float) / CELLS
    n = np.array([cells[k] for k in sorted(cells)], dtype=float).reshape(-1, 2)
    if not n.sum(axis=0).all():
        return 0.0
    below = np.concatenate([np.zeros((1, 2)), np.cumsum(n, axis=0)]) / n.sum(axis=0)
    cost = below[:, 1] + 1 - below[:, 0]
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    edge = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    return float(edge[best[len(best) // 2]])


def _language_words(docs: DataFrame, names: list[str]) -> LanguageWords:
    """Word counts of ``names`` and of all other languages together, over all rows outside the held-out fold."""
    index, width = {name: i for i, name in enumerate(names)}, len(names) + 1
    rows = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), MODULUS) != HELD)).select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * BUCKETS)
        for batch in batches:
            kind = np.array([index.get(x, width - 1) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for lo, hi, data, ends in blocks(batch.column(1)):
                ids, at = word_ids(data, ends)
                base = np.repeat(kind[lo:hi] * BUCKETS, np.diff(at))
                for row in ids:
                    np.add.at(total, base + row, 1.0)
        yield from sliced({"words": total}, TaskContext.get().partitionId()).to_batches()

    total = summed(rows.mapInArrow(count, PARTS)).get("words", np.zeros(width * BUCKETS))
    return LanguageWords([*names, None], total.reshape(width, BUCKETS))


def _trained(rows: DataFrame, model: ToxicityModel, weights: tuple[float, float], passes: int) -> None:
    """One worker for each shard of ``rows``, all from ``model``, which then is what they join to."""

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending"), ("text", "ascending")])
        mine, y = copy.deepcopy(model), table["y"].to_numpy()
        mine.train(texts_ids(table["text"]), y.astype(np.float32), np.array(weights)[y], passes, key[0].as_py())
        return sliced(mine.changes(model, len(y)), key[0].as_py())

    model.join(summed(rows.select("shard", "deal", "y", "text").groupBy("shard").applyInArrow(learn, PARTS)))


def _set_thresholds(rows: DataFrame, model: ToxicityModel) -> None:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, kind = model.judged(batch.column(1))
            cell = np.rint(raw * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(cell), batch.column(0)], names=["kind", "cell", "y"])

    found = rows.select("y", "text").mapInArrow(judge, "kind long, cell long, y int").groupBy("kind", "cell").agg(F.sum(1 - F.col("y")).alias("n"), F.sum("y").alias("p"))
    cells: dict[int, dict[int, tuple[int, int]]] = {}
    everywhere: dict[int, tuple[int, int]] = {}
    for kind, cell, n, p in found.collect():
        cells.setdefault(kind, {})[cell] = (n, p)
        n0, p0 = everywhere.get(cell, (0, 0))
        everywhere[cell] = (n0 + n, p0 + p)
    languages = model.languages.languages if model.languages else []
    model.cuts = np.full(len(languages) + 1, _cut(everywhere))
    for k in range(len(languages)):
        if k in cells and min(sum(x) for x in zip(*cells[k].values())) >= LEAST:
            model.cuts[k] = _cut(cells[k])


def fitted(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on all labelled rows; without both labels every score is the share of label 1 (or 0.5)."""
    scratch, model = Scratch(docs.sparkSession, "toxicity"), ToxicityModel()
    rows = labelled_rows(docs, labels, "toxic", MODULUS, HELD)
    sets = F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(HOLD_OUT)) == 0
    rows = scratch.save(rows.select("y", "lang", "text", sets.alias("sets"), F.xxhash64("id", "text").alias("deal")), "labelled")
    counts = rows.groupBy("sets", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    n = np.array([sum(r["n"] for r in counts if r["y"] == y) for y in (0, 1)])
    train = np.array([sum(r["n"] for r in counts if r["y"] == y and not r["sets"]) for y in (0, 1)])
    if n.sum():
        model.prior = float(n[1] / n.sum())
    if n.all() and n.sum() >= 10 and train.sum():
        share = train / train.sum()
        weights = (0.5 / max(share[0], 1e-3), 0.5 / max(share[1], 1e-3))
        own = rows.where("sets and lang is not null").groupBy("lang").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        names = sorted(r["lang"] for r in own.where(f"p >= {LEAST} and n >= {LEAST}").collect())
        if names:
            model.languages = _language_words(docs, names)
        shards = int(max(-(-train.sum() // SHARD_ROWS), -(-sum(r["bytes"] for r in counts if not r["sets"]) // SHARD_BYTES), 1))
        passes = int(-(-STEPS * BATCH // train.sum()))
        dealt = rows.where("not sets").withColumn("shard", F.pmod("deal", F.lit(shards)))
        if shards > 1:
            _trained(dealt.where("shard = 0"), model, weights, min(passes * WARM, -(-STEPS * BATCH * shards // int(train.sum()))))
        for _ in range(passes if shards > 1 else 1):
            _trained(dealt, model, weights, passes if shards == 1 else 1)
        _set_thresholds(rows.where("sets"), model)
        model.ready = True
    scratch.keep()
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, lang).

    The score (0 to 1, higher: more likely toxic) sees the whole text and nothing else; ``lang`` only
    teaches the word counts that tell languages apart, outside the held-out fold. Null and empty texts are
    scored as texts without words. With fewer than ten labelled rows, or one label only, every score
    is the share of label 1 in the labelled rows, or 0.5. Rows are scored one by one, so repeats and null
    ids need no care; an empty table gives no rows.
    """
    out = with_scores(docs.select("doc_id", "text"), fitted(docs, labels), {"score": T.DoubleType()})
    return out.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
