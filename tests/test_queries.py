"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from milldam.plans.oracle import oracle_sql
from milldam.plans.queries import queries
from milldam.session import TABLES

SKIP_SMALL: set[str] = set()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, duck, sf_dir):
    assert os.path.exists(sf_dir)
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, found.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_bench_times_whole_similarity():
    """The headline has the confirmed pairs, not only their candidates."""
    import bench

    assert {"lsh_candidate_pairs", "lsh_similar_pairs"} <= set(bench.HEADLINE)
