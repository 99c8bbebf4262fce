"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score is linear in features of the line and of its neighbours, and
neighbouring states are coupled. Lines are never labelled, so training starts from the document's
label on all its lines and then lets the model itself clear lines of bad documents. A document's
quality comes from its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import Adam, fold, labelled_sample, logistic_fit, sigmoid, with_scores
from .textops import LOWER, NOT_BLANK, blocks, hash_spans, mix, spans

MODULUS, HELD = 3, 1
#: Lines that a training document gives from its start; all lines are scored.
SAMPLE_LINES = 120
ROUNDS, STEPS = 3, 80

_CLASSES = {
    "upper": bytes(range(65, 91)), "letter": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), "digit": b"0123456789",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_`", "pipe": b"|", "bang": b"!?", "stop": b".,;:'\"()-", "lead": bytes(range(128, 192)),
}
_PACKED = []
for _a, _b in zip(*[iter(_CLASSES.values())] * 2):
    _t = np.zeros(256, dtype=np.uint64)
    _t[list(_a)] += np.uint64(1)
    _t[list(_b)] += np.uint64(1 << 32)
    _PACKED.append(_t)
FEATURES = 13


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-empty lines (with their neighbours'), their lengths, each text's first line."""
    a, b = spans(data != 10, ends)
    at = np.searchsorted(a, ends, side="left")
    n = (b - a).astype(float)
    counts = []
    for table in _PACKED:
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data], out=sums[1:])
        both = sums[b] - sums[a]
        counts += [(both & np.uint64(0xFFFFFFFF)).astype(float), (both >> np.uint64(32)).astype(float)]
    upper, letter, digit, symbol, pipe, bang, stop, lead = counts
    letter = letter - lead  # code points
    n = n - lead
    inner = NOT_BLANK[data]
    starts, stops = spans(inner, ends)
    low = LOWER[data]
    h = hash_spans(low, starts, stops)
    w_at = np.searchsorted(starts, np.append(a, len(data)))
    line = np.repeat(np.arange(len(a)), np.diff(w_at)) if len(a) else np.zeros(0, dtype=int)
    word = np.diff(w_at)
    twice = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(a)) if len(h) else 0 * word
    _, one = np.unique(h + mix(line.astype(np.uint64)), return_index=True)
    kinds = np.bincount(line[one], minlength=len(a)) if len(h) else 0 * word
    word = np.maximum(word, 1).astype(float)
    again = np.zeros(len(a))
    if len(a):
        h = hash_spans(low, a, b)
        doc = np.repeat(np.arange(len(ends) - 1), at[1:] - at[:-1])
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again[order[1:][same]] = 1
        again[order[:-1][same]] = 1
    x = np.stack(
        [np.log1p(n) / 5, upper / (letter + 1), np.minimum(symbol / word, 4), np.minimum(pipe / word, 2), np.minimum(bang / word, 3), digit / np.maximum(n, 1),
         np.minimum(stop / word, 3), np.minimum(n / word, 40) / 10, letter / np.maximum(n, 1), again, np.log1p(word) / 4, twice / word, kinds / word], axis=1,
    )
    full = np.zeros((len(a), 3 * FEATURES + 3))
    full[:, :FEATURES] = x
    if len(a):
        first, last = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
        some = at[1:] > at[:-1]
        first[at[:-1][some]] = True
        last[at[1:][some] - 1] = True
        full[1:, FEATURES : 2 * FEATURES] = x[:-1] * ~first[1:, None]
        full[:-1, 2 * FEATURES : 3 * FEATURES] = x[1:] * ~last[:-1, None]
        full[:, -3], full[:, -2] = first, last
    full[:, -1] = 1
    return full, n, at


def _over(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log-odds after one transition: t is [to bad, to good] from bad, then from good."""
    return np.logaddexp(r + t[1, 1], t[0, 1]) - np.logaddexp(r + t[1, 0], t[0, 0])


def chains(u: np.ndarray, at: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with the line's own score) and backward log-odds of state good, for all lines.

    Documents are lanes; those with more lines come first, so lanes only end as a step goes on.
    """
    n = at[1:] - at[:-1]
    order = np.argsort(-n, kind="stable")
    n, first = n[order], at[:-1][order]
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # lanes with more lines than that
    fwd, bwd = u.copy(), np.zeros_like(u)
    for k in range(1, len(live)):
        i = first[: live[k]] + k
        fwd[i] += _over(fwd[i - 1], t)
    back = t.T
    for k in range(len(live) - 2, -1, -1):
        i = first[: live[k + 1]] + k
        bwd[i] = _over(u[i + 1] + bwd[i + 1], back)
    return fwd, bwd


def _summary(good: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: the length-weighted share of good lines, its weakest form, the constant."""
    w = np.concatenate([[0], np.cumsum(n)])
    g = np.concatenate([[0], np.cumsum(n * good)])
    total = w[at[1:]] - w[at[:-1]]
    share = np.divide(g[at[1:]] - g[at[:-1]], total, out=np.full(len(total), 0.5), where=total > 0)
    return np.stack([share, (share > 0.9).astype(float), np.minimum(np.log1p(total) / 10, 1.5), np.ones(len(share))], axis=1)


class QualityModel:
    """Line weights, transitions, and the weights of a document's summary."""

    def __init__(self):
        self.w = np.zeros(3 * FEATURES + 3)
        self.t = np.zeros((2, 2))
        self.doc: np.ndarray | None = None
        self.prior = 0.5

    def fit(self, sample: list[tuple[str, int]]) -> QualityModel:
        """Fits on (text, label); without both labels every score is the share of label 1 (or 0.5)."""
        if sample:
            self.prior = float(np.mean([y for _, y in sample]))
        parts, labels = [], []
        for text, y in sample:
            raw = text.encode()
            x, n, at = line_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if len(x):
                parts.append((x[:SAMPLE_LINES], n[:SAMPLE_LINES]))
                labels.append(y)
        y = np.array(labels, dtype=float)
        if not len(y) or y.min() == y.max():
            return self
        x = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        doc = np.repeat(np.arange(len(y)), np.diff(at))
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[doc] / len(x)
        inner = np.ones(len(x), dtype=bool)
        inner[at[:-1]] = False
        pair = np.flatnonzero(inner)  # lines with one before them
        z = y[doc].copy()
        for turn in range(ROUNDS):
            adam = Adam([self.w, self.t], 0.2 if turn == 0 else 0.1)
            for _ in range(STEPS):
                u = x @ self.w
                fwd, bwd = chains(u, at, self.t)
                p = sigmoid(fwd + bwd)
                gw = -x.T @ (weight * (z - p)) + 1e-4 * self.w
                r, s = fwd[pair - 1], u[pair] + bwd[pair]
                joint = np.stack([np.full(len(pair), self.t[0, 0]), s + self.t[0, 1], r + self.t[1, 0], r + s + self.t[1, 1]])
                joint = np.exp(joint - joint.max(axis=0))
                joint /= joint.sum(axis=0)
                zp, zc = z[pair - 1], z[pair]
                seen = np.stack([(1 - zp) * (1 - zc), (1 - zp) * zc, zp * (1 - zc), zp * zc])
                gt = -((seen - joint) * weight[pair]).sum(axis=1).reshape(2, 2) + 1e-4 * self.t
                adam.step([gw, gt])
            good = sigmoid(np.add(*chains(x @ self.w, at, self.t)))
            # Lines of bad documents that look good are cleared, but for each document's worst.
            worst = np.minimum.reduceat(good, at[:-1])[doc]
            z = np.where(y[doc] == 1, 1.0, ((good > 0.5) & (good > worst)).astype(float))
        self.doc = logistic_fit(_summary(good, n, at), y)
        return self

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if self.doc is not None:
            for lo, hi, data, ends in blocks(column):
                x, n, at = line_features(data, ends)
                good = sigmoid(np.add(*chains(x @ self.w, at, self.t)))
                score = sigmoid(_summary(good, n, at) @ self.doc)
                out[lo:hi] = np.where(at[1:] > at[:-1], score, self.prior)
        return out


def fitted(docs: DataFrame, labels: DataFrame) -> QualityModel:
    return QualityModel().fit(labelled_sample(docs, labels, "quality", MODULUS, HELD))


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1, higher: better) in column ``name``, from the whole text alone.

    Texts without lines (null, empty, line feeds only) get the share of good rows in the training
    sample. Rows are scored one by one, so repeats and null ids need no care; without labels of both
    kinds every score is that share, or 0.5 without any. An empty table gives no rows.
    """
    model = fitted(docs, labels)
    return with_scores(docs, lambda column: {name: model(column)}, {name: T.DoubleType()})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns, repeats and null ids too.

    Null and empty texts score the training sample's share of good rows; an empty table gives no rows.
    """
    return scored(docs, labels, "__quality").where("__quality >= 0.5").drop("__quality")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); see scored for awkward rows."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
