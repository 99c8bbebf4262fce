"""Every query of this subpackage that has SQL gives the rows that DuckDB gives, on the given and on awkward tables."""

from __future__ import annotations

import random

import duckdb
import pytest

from milldam.llm.registry import oracle_sql, queries
from milldam.session import TABLES

from ..test_queries import rows_of
from .cases import awkward, frame, labels, prose


def compared(name, spark, folder, files):
    con = duckdb.connect()
    for t in files:
        con.execute(f"create view {t} as select * from '{folder}/{files[t]}'")
    df = queries()[name](spark, folder)
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, found.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    return want


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_given_tables(name, spark, sf_dir):
    assert compared(name, spark, sf_dir, {t: f"{t}.parquet" for t in TABLES})


def items(r):
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 13, 15, 16, 30, 59, 120]
    return [(i, prose(r, n)) for i, n in enumerate(sizes)] + [(90, None), (91, ""), (None, prose(r, 20)), (1, prose(r, 9)), (92, "word")]


def near(r, text):
    """The text with some words replaced, cut at the ends, or as it is."""
    words = text.split()
    for _ in range(r.choice([0, 0, 1, len(words) // 6, len(words) // 4])):
        words[r.randrange(len(words))] = prose(r, 1)
    lo = r.choice([0, 0, len(words) // 3])
    return " ".join(words[lo : len(words) - r.choice([0, 0, len(words) // 4])])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward rows, benchmark items whole, changed, cut and alone, licence phrases, near copies; ids tell rows apart."""
    r, out = random.Random(12), str(tmp_path_factory.mktemp("awkward"))
    some = items(r)
    rows = [(i, *x[1:]) for i, x in enumerate(x for x in awkward())]
    for j in range(160):
        _, text = some[j % 14]
        rows.append((100 + j, " ".join([prose(r, r.choice([0, 5])), near(r, text), prose(r, r.choice([0, 5]))]), "en", r.choice(["a", "b", None]), 1))
    rows += [(300 + j, f"{prose(r, 3)} all rights reserved. licensed under CC BY-NC 4.0 {prose(r, 2)} GNU General Public License", None, "é", 1) for j in range(5)]
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(some, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    labels(spark, [(1, 1, 0)]).write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_awkward_tables(name, spark, folder):
    # Spark writes folders; DuckDB reads their files.
    assert len(compared(name, spark, folder, {t: f"{t}.parquet/*.parquet" for t in ("documents", "benchmark", "labels")})) > 20
