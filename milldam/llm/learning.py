"""What the trained operators share: labelled rows (all, or a bounded sample), sums over workers and scoring in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each class that a classifier is fitted on, and the characters that each gives from its start.
SAMPLE_PER_CLASS = 2_000
SAMPLE_CHARS = 16_000
#: Labelled ids that may be broadcast to the documents.
BROADCAST_LABELS = 1_000_000
#: Numbers of an array that are summed over all workers in one place.
SLICE = 1 << 15
PARTS = "name string, slice int, worker long, part binary"


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def _known(labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """(id, y) of the ids outside the held-out fold; labels other than 0 and 1, and ids labelled both ways, are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id")
    known = known.agg(F.min(column).alias("y"), F.max(column).alias("z")).where("y = z").select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))
    return known.where(fold(F.col("id"), modulus) != held)


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int) -> DataFrame:
    """(id, y, lang, text) of every labelled row outside the held-out fold, with its whole text; a null one counts as empty.

    Rows that agree in all of these count once. See _known for the labels.
    """
    known = _known(labels, column, modulus, held)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.where(fold(F.col("doc_id"), modulus) != held)
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(known, F.col("doc_id") == F.col("id")).select("id", "y", "lang", "text").distinct()


def sliced(arrays: dict[str, np.ndarray], worker: int) -> pa.Table:
    """The arrays of one worker as rows of PARTS."""
    rows = [(k, i // SLICE, x.ravel()[i : i + SLICE]) for k, x in arrays.items() for i in range(0, x.size, SLICE)]
    columns = [pa.array([k for k, *_ in rows], pa.string()), pa.array([i for _, i, _ in rows], pa.int32())]
    columns += [pa.array([worker] * len(rows), pa.int64()), pa.array([x.astype(np.float64).tobytes() for *_, x in rows], pa.binary())]
    return pa.Table.from_arrays(columns, names=["name", "slice", "worker", "part"])


def summed(parts: DataFrame) -> dict[str, np.ndarray]:
    """The sums of all workers' arrays by name, added in the order of the workers."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("worker")
        total = np.zeros(len(table["part"][0].as_py()) // 8)
        for part in table["part"]:
            total += np.frombuffer(part.as_buffer(), np.float64)
        return pa.table({"name": table["name"][:1], "slice": table["slice"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    found: dict[str, list[np.ndarray]] = {}
    for r in sorted(parts.groupBy("name", "slice").applyInArrow(add, "name string, slice int, part binary").collect(), key=lambda r: r["slice"]):
        found.setdefault(r["name"], []).append(np.frombuffer(r["part"], np.float64))
    return {k: np.concatenate(x) for k, x in found.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows of each label outside the held-out fold.

    Rows come in the order of a hash of their id, so the sample is the same in every run. No row is
    left out for its length: a long text gives its first SAMPLE_CHARS characters, a null one counts as
    empty. Labels other than 0 and 1, and ids labelled both ways, are left out.
    """
    known = _known(labels, column, modulus, held)
    order = F.xxhash64("id", F.lit(column))
    some = [known.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    some = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows of two numbers
    text = F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")
    rows = docs.select("doc_id", text).join(some, F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.first("y").alias("y")).orderBy(order, "id").limit(2 * per_class)
    return [(r["text"], int(r["y"])) for r in rows.collect()]


def with_scores(docs: DataFrame, scorer: Callable[[pa.Array], dict[str, np.ndarray]], types: dict[str, T.DataType]) -> DataFrame:
    """``docs`` with columns that ``scorer`` computes from whole texts, batch by batch, in place."""
    at = docs.columns.index("text")
    names = list(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = scorer(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(new[n]) for n in names)], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in types.items())])
    return docs.mapInArrow(run, schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Adam:
    """Steps of the Adam rule on arrays that are changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
