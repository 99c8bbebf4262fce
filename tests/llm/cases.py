"""Tables of awkward rows, and helpers that the tests of this folder share."""

from __future__ import annotations

import random
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves must not disturb them.
CLASHES = ("score", "node", "cls", "label", "size", "shard", "taken", "words", "h", "at", "seed", "order", "predicted")


def prose(r: random.Random, n: int, stem: str = "") -> str:
    return " ".join(stem + "".join(r.choice("abcdeilnorstu") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, copies, an emoji, blank lines."""
    r = random.Random(seed)
    body = prose(r, 60)
    return [
        (1, body, "en", "a", 1),
        (2, body, "en", "b", 1),
        (2, body, "en", "b", 1),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, "   \n\t ", "en", "a", 3),
        (6, "word", "de", "b", 4),
        (7, body + " tail", "en", "a", 1),
        (8, prose(r, 30_000), "en", "c", 1),
        (9, "\U0001f600 naïve café ÀÉ", "fr", "c", 1),
        (None, prose(r, 12), "en", None, 1),
        (None, None, None, None, None),
        (10, body.upper(), None, "c", 1),
    ]


def frame(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def crc(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def auc(good: list[float], bad: list[float]) -> float:
    pairs = [(g > b) + 0.5 * (g == b) for g in good for b in bad]
    return sum(pairs) / len(pairs)
