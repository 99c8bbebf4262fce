"""Pairs of a band are told by sketches and verified in blocks, not by joins of their members."""

from __future__ import annotations

import random

from milldam.operators import similarity


def test_pairs_equal_those_of_all_bands(spark):
    r = random.Random(6)
    sets = {k: set(r.sample(range(400), r.randint(1, 60))) for k in range(40)}
    sets |= {k + 100: set(list(s)[: max(1, len(s) * 2 // 3)]) | {999} for k, s in sets.items()}
    m = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "item long, member long")
    met = [tuple(x) for x in similarity.candidate_pairs(similarity.signatures(m, 26), 13, 2).collect()]
    assert len(met) == len(set(met))
    want = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in met}
    found = similarity.similar_items(m, 13, 2, 0.5)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {(x["a"], x["b"]): x["similarity"] for x in found.collect()} == {p: s for p, s in want.items() if s >= 0.5}
