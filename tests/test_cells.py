"""Pairs of a cell are made in tasks of bounded size."""

from __future__ import annotations

import random

import pytest

from milldam.operators import cells, similarity


def signed(spark, rows, kind="long"):
    n = len(rows[0]) - 1
    return spark.createDataFrame(rows, f"item {kind}, " + ", ".join(f"h{j} long" for j in range(n)))


@pytest.mark.parametrize("rows", [1, 2, 3])
@pytest.mark.parametrize("cell_rows", [3, 4_096])
def test_pairs_equal_brute_force(spark, monkeypatch, rows, cell_rows):
    """Also where cells are dealt into blocks; each pair once, whatever number of bands it agrees in."""
    monkeypatch.setattr(cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(cells, "PAIRS", 7)
    r = random.Random(rows)
    data = [(k, *(r.choice([0, 1, 2_147_483_646]) for _ in range(3 * rows))) for k in r.sample(range(1000), 40)]
    same = lambda x, y: any(x[1 + i * rows : 1 + (i + 1) * rows] == y[1 + i * rows : 1 + (i + 1) * rows] for i in range(3))
    want = sorted((x[0], y[0]) for x in data for y in data if x[0] < y[0] and same(x, y))
    assert sorted(tuple(x) for x in similarity.candidate_pairs(signed(spark, data), 3, rows).collect()) == want


def test_pairs_need_no_join(spark):
    """A join of a bucket of copies makes its square of wide rows before any pair is dropped."""
    found = similarity.candidate_pairs(signed(spark, [("x", 1, 2), ("y", 1, 3), ("z", None, None), ("zz", None, None)], "string"), 2, 1)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert [tuple(x) for x in found.collect()] == [("x", "y")]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_exact_pairs_in_slices(spark, monkeypatch, least):
    """Members meet in several slices, and hold whole numbers of any sign and size; no pair comes twice."""
    monkeypatch.setattr(similarity, "PREFIX_ROWS", 50)
    monkeypatch.setattr(similarity, "CELL_PAIRS", 2)
    r = random.Random(2)
    words = [r.choice([k, -k - 1, k + (1 << 40), k + (1 << 31)]) for k in range(60)]
    sets = {k: set(r.sample(words, r.randint(1, 12))) for k in range(40)}
    sets |= {k + 100: set(list(s)[1:]) | {5} for k, s in sets.items()} | {500: sets[0], 501: sets[0]}
    m = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "item long, member long")
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = sorted((a, b, s) for (a, b), s in alike.items() if s >= least)
    assert sorted(tuple(x) for x in similarity.all_similar_items(m, least).collect()) == want
    lists = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "item long, members array<long>")
    assert sorted(tuple(x) for x in similarity.all_similar_items(lists, least).collect()) == want


def test_members_lie_in_lists_once(spark, monkeypatch):
    """Rows of members take several times the disk of their lists; a pair's members are met with the cell that it comes from."""
    seen, worked = [], similarity.neighbours.worked
    monkeypatch.setattr(similarity.neighbours, "worked", lambda own, items, *a: seen.append((own.columns, items.columns)) or worked(own, items, *a))
    m = spark.createDataFrame([(k, x) for k in range(4) for x in range(6)], "item long, member long")
    assert similarity.similar_items(m, 13, 2, 0.5).count() == 6
    assert seen == [(["u", "i", "r", "held", "at"], ["i", "low", "high"])]
