"""Golden fixtures and differential tests of the mining operators."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from milldam.functions import hashing, scalar, text
from milldam.operators import explore, graph, itemsets, recommend, similarity
from milldam.sources import readers, sinks
from pyspark.sql import functions as F

G1 = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("d", "f"), ("e", "f"), ("c", "d")]


def sets(spark, data):
    return spark.createDataFrame(list(enumerate(data)), "key long, items array<string>")


def as_dict(df):
    return {tuple(r["items"]): r["n"] for r in df.collect()}


def test_itemsets_golden(spark):
    got = as_dict(itemsets.frequent(sets(spark, [["1", "2", "3"], ["1", "2"], ["1", "3"], ["1", "2", "3"]]), 2))
    assert got == {("1",): 4, ("2",): 3, ("3",): 3, ("1", "2"): 3, ("1", "3"): 3, ("2", "3"): 2, ("1", "2", "3"): 2}


def test_itemset_report(spark):
    found = itemsets.frequent(sets(spark, [["1", "2", "3"], ["1", "2"], ["1", "3"], ["1", "2", "3"]]), 2)
    lines = [r["line"] for r in sinks.itemset_lines(found).collect()]
    assert lines == ["('1'), ('2'), ('3')", "('1', '2'), ('1', '3'), ('2', '3')", "('1', '2', '3')"]


def brute_itemsets(data, support):
    out = {}
    for k in range(1, 5):
        for c in itertools.combinations(sorted({x for b in data for x in b}), k):
            n = sum(set(c) <= set(b) for b in data)
            if n >= support:
                out[c] = n
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_two_phases_equal_brute_force(spark, shards):
    r = random.Random(3)
    data = [sorted(r.sample("abcde", r.randint(1, 4))) for _ in range(24)]
    own = sets(spark, data)
    candidates = itemsets.local_candidates(own, 6, shards)
    assert as_dict(itemsets.confirmed(own, candidates, 6)) == brute_itemsets(data, 6) == as_dict(itemsets.frequent(own, 6))


def test_itemsets_empty(spark):
    none = spark.createDataFrame([], "key long, items array<string>")
    assert itemsets.local_candidates(none, 2).count() == 0


def test_jaccard_golden(spark):
    m = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 2), ("y", 3), ("y", 4)], "item string, member long")
    assert [tuple(r) for r in similarity.all_similar_items(m, 0.5).collect()] == [("x", "y", 0.5)]
    assert similarity.all_similar_items(m, 0.51).count() == 0


def test_lsh_pairs_are_exact_pairs(spark):
    r = random.Random(5)
    base = [r.sample(range(60), 20) for _ in range(6)]
    rows = [(3 * i + j, x) for i, b in enumerate(base) for j in range(3) for x in b[j:]]
    m = spark.createDataFrame(rows, "item long, member long")
    exact = {(x["a"], x["b"]) for x in similarity.all_similar_items(m, 0.5).collect()}
    near = {(x["a"], x["b"]) for x in similarity.similar_items(m, 13, 2, 0.5).collect()}
    own = {k: {x for i, x in rows if i == k} for k, _ in rows}
    assert exact == {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.5}
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_similarity_methods(spark):
    m = spark.createDataFrame([("x", 1)], "item string, member long")
    with pytest.raises(NotImplementedError):
        similarity.similar_items(m, 2, 1, 0.5, "cosine")
    with pytest.raises(ValueError):
        similarity.similar_items(m, 2, 1, 0.5, "other")


def test_pearson_golden(spark):
    train = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 1), (2, 1, 4), (2, 2, 2), (2, 3, 3), (2, 9, 5)], "u long, i long, r int")
    test = spark.createDataFrame([(1, 9, 4)], "u long, i long, r int")
    assert [tuple(r) for r in recommend.user_similarity(train, test).collect()] == [(1, 2, pytest.approx(0.5))]
    got = recommend.user_predictions(train, test).collect()[0]["prediction"]
    assert got == pytest.approx(min(5.0, 3 + (5 - 3)))


def test_pearson_guards(spark):
    same = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (2, 1, 4), (2, 2, 2), (2, 9, 1)], "u long, i long, r int")
    test = spark.createDataFrame([(1, 9, 4)], "u long, i long, r int")
    assert recommend.user_similarity(same, test).collect()[0]["sim"] is None
    assert recommend.user_predictions(same, test).collect()[0]["prediction"] == 3.0


def test_unknown_user_gets_default(spark):
    train = spark.createDataFrame([(1, 1, 5)], "u long, i long, r int")
    test = spark.createDataFrame([(7, 1, 4), (1, 8, 2)], "u long, i long, r int")
    got = {r["u"]: r["prediction"] for r in recommend.user_predictions(train, test).collect()}
    assert got == {7: 3.0, 1: 5.0}
    assert {tuple(r) for r in recommend.cold_pairs(train, test).collect()} == {(7, 1), (1, 8)}
    got = {r["u"]: r["prediction"] for r in recommend.als_predictions(train, test).collect()}
    assert got[7] == 3.0


def test_fit_blend(spark):
    rows = [(u, i, float(u + i % 3), float(u * i % 5)) for u in range(6) for i in range(6)]
    one = spark.createDataFrame([(u, i, a) for u, i, a, _ in rows], "u long, i long, prediction double")
    two = spark.createDataFrame([(u, i, b) for u, i, _, b in rows], "u long, i long, prediction double")
    actual = spark.createDataFrame([(u, i, 0.7 * a + 0.2 * b - 0.1) for u, i, a, b in rows], "u long, i long, r double")
    weights, constant = recommend.fit_blend({"one": one, "two": two}, actual)
    assert weights == pytest.approx({"one": 0.7, "two": 0.2}) and constant == pytest.approx(-0.1)


def test_factors_recover_ratings_of_rank_two(spark):
    """Factors beat the mean by far on held-out pairs of a matrix that has them, and stay in [1, 5]."""
    r = random.Random(2)
    users = [(r.random(), r.random()) for _ in range(60)]
    goods = [(r.random() * 2, r.random() * 2) for _ in range(40)]
    cells = [(u, i, 1 + a * x + b * y) for u, (a, b) in enumerate(users) for i, (x, y) in enumerate(goods)]
    asked = [c for c in cells if (c[0] * 7 + c[1] * 3) % 10 == 0]
    train = spark.createDataFrame([c for c in cells if c not in asked], "u long, i long, r double")
    test = spark.createDataFrame([*asked, (999, 0, 3.0), (0, 999, 3.0), asked[0]], "u long, i long, r double")
    got = recommend.als_predictions(train, test, rank=3, penalty=0.02).collect()
    by = {(x["u"], x["i"]): x["prediction"] for x in got}
    assert len(got) == len(asked) + 3 and all(1 <= p <= 5 for p in by.values())
    assert by[(999, 0)] == by[(0, 999)] == recommend.UNKNOWN
    mean = sum(c[2] for c in cells) / len(cells)
    error = lambda f: (sum((f(u, i) - x) ** 2 for u, i, x in asked) / len(asked)) ** 0.5
    assert error(lambda u, i: by[(u, i)]) < 0.25 * error(lambda u, i: mean)


def test_rated_neighbours_golden(spark):
    """Of the three items that user 9 rated, the nearer half of three is one: the item that moves with item 1."""
    rows = [(u, 1, r) for u, r in enumerate((1, 2, 4, 5))] + [(u, 2, r) for u, r in enumerate((1, 3, 4, 5))]
    rows += [(u, 3, r) for u, r in enumerate((5, 4, 2, 1))] + [(u, 4, r) for u, r in enumerate((3, 5, 1, 3))] + [(9, 2, 4), (9, 3, 1), (9, 4, 2)]
    train = spark.createDataFrame(rows, "u long, i long, r int")
    test = spark.createDataFrame([(9, 1, 4), (8, 1, 4)], "u long, i long, r int")
    got = {x["u"]: x["prediction"] for x in recommend.rated_item_predictions(train, test).collect()}
    assert got == {9: pytest.approx(4.0), 8: 3.0}


def test_clamp(spark):
    df = spark.createDataFrame([(5.7,), (0.2,), (3.3,)], "x double")
    assert [r[0] for r in df.select(scalar.clamp(F.col("x"))).collect()] == [5.0, 1.0, 3.3]
    assert [r[0] for r in df.select(scalar.clamp(F.col("x"), 0.0, 5.0)).collect()] == [5.0, 0.2, 3.3]


def test_betweenness_golden(spark):
    e = spark.createDataFrame(G1, readers.EDGE)
    want = {("c", "d"): 9.0, ("a", "c"): 4.0, ("b", "c"): 4.0, ("d", "e"): 4.0, ("d", "f"): 4.0, ("a", "b"): 1.0, ("e", "f"): 1.0}
    for limit in (100, 0):
        got = {(r["src"], r["dst"]): round(r["betweenness"], 9) for r in graph.edge_betweenness(e, limit).collect()}
        assert got == want
    assert sinks.betweenness_lines(graph.edge_betweenness(e)).first()["line"] == "('c', 'd'), 9.0"


def test_betweenness_forms_agree(spark):
    r = random.Random(9)
    pairs = {tuple(sorted(r.sample(range(14), 2))) for _ in range(24)}
    e = spark.createDataFrame(list(pairs), "src long, dst long")
    local, wide = ({(x["src"], x["dst"]): round(x["betweenness"], 6) for x in graph.edge_betweenness(e, n).collect()} for n in (100, 0))
    assert local == wide


def test_girvan_newman_golden(spark):
    e = spark.createDataFrame(G1 + [("a", "a"), ("b", "a")], readers.EDGE)
    found = graph.communities(graph.girvan_newman(e), "community")
    assert [r["line"] for r in sinks.community_lines(found).collect()] == ["'a', 'b', 'c'", "'d', 'e', 'f'"]
    q = graph.modularity(e, graph.girvan_newman(e), "community").first()["q"]
    assert q == pytest.approx(0.357142857142857)
    one = graph.girvan_newman(e).withColumn("community", F.lit("all"))
    assert graph.modularity(e, one, "community").first()["q"] == pytest.approx(0)


def paths(near, a, b):
    """All shortest paths from a to b, by trying."""
    front = [[a]]
    while front and not any(p[-1] == b for p in front):
        front = [[*p, y] for p in front for y in sorted(near[p[-1]]) if y not in p]
    return [p for p in front if p[-1] == b]


def divided(pairs):
    """The best split by removing edges, with betweenness from enumerated paths."""
    near = {x: set() for p in pairs for x in p}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    degree, m, left = {x: len(y) for x, y in near.items()}, len(pairs), sorted(pairs)

    def split():
        of = {}
        for x in sorted(near):
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in of:
                    of[y] = x
                    todo += near[y]
        return of

    def quality(of):
        same = sum(of[a] == of[b] for a, b in pairs) / m
        return same - sum((sum(degree[x] for x in of if of[x] == c) / (2 * m)) ** 2 for c in set(of.values()))

    whole = dict.fromkeys(near, min(near))
    best, best_q, n = whole, quality(whole), len(set(split().values()))
    while left:
        weight = dict.fromkeys(left, 0.0)
        for a, b in itertools.combinations(sorted(near), 2):
            found = paths(near, a, b)
            for p in found:
                for x, y in zip(p, p[1:]):
                    weight[min(x, y), max(x, y)] += 1 / len(found)
        a, b = min(left, key=lambda e: (-round(weight[e], 9), e))
        left.remove((a, b))
        near[a].discard(b)
        near[b].discard(a)
        of = split()
        if len(set(of.values())) > n:
            n = len(set(of.values()))
            if quality(of) > best_q + 1e-12:
                best, best_q = of, quality(of)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_girvan_newman_against_enumerated_paths(spark, seed):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(9), 2))) for _ in range(13)})
    got = {x["node"]: x["community"] for x in graph.girvan_newman(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == divided(pairs)


def test_empty_graph(spark):
    none = spark.createDataFrame([], readers.EDGE)
    for out in (graph.components(none), graph.label_propagation(none), graph.edge_betweenness(none), graph.girvan_newman(none)):
        assert out.count() == 0


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40}


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=12), st.sampled_from([17, 200, 2_147_483_629]))
def test_residue(spark, value, modulus):
    raw = value.encode("utf-8", "ignore")
    value = raw.decode()
    got = spark.createDataFrame([(value,)], "s string").select(hashing.bytes_residue(F.col("s"), modulus)).first()[0]
    assert got == int.from_bytes(raw, "big") % modulus


def test_hash_helpers(spark):
    df = spark.createDataFrame([("hello", 12)], "s string, x long")
    row = df.select(hashing.chars_residue(F.col("s")), hashing.lowest_bit(F.col("x")), hashing.linear(F.col("x"), -5, 1, 7)).first()
    assert tuple(row) == (99162322, 4, (-59) % 7)


def test_attribute_words(spark):
    df = spark.createDataFrame([({"wifi": "free", "patio": "True", "tv": "no", "x": "{'a': 1}"}, "Bars & Grill, Pizza"), (None, None)], "a map<string,string>, c string")
    got = [sorted(r[0]) for r in df.select(text.attribute_words(F.col("a"), F.col("c"))).collect()]
    assert got == [["bars", "grill", "patio", "pizza", "wifi_free"], []]


def test_profiles(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    assert sum(r["n_items"] for r in explore.custom_profile(df, "k", 16).collect()) == 100
    assert explore.custom_profile(df, "k", 16).count() == 16
    assert all(r["same"] for r in explore.collect_or_take(df.orderBy("id")).collect())


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('user_id,business_id,stars\nu1,b1,4.0\n"u,2",b2,3.5\n')
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path / "r.csv")).collect()] == [("u1", "b1", 4.0), ("u,2", "b2", 3.5)]
    (tmp_path / "e.txt").write_text("a b\nb c\n")
    assert readers.edges(spark, str(tmp_path / "e.txt")).count() == 2
    (tmp_path / "s.csv").write_text('"DATE","CUST","A","B","C","ITEM"\n"2000-11-01","7","x","y","z","0042"\n"2000-11-01","7","x","y","z","bad"\n')
    assert [tuple(r) for r in readers.retail_baskets(spark, str(tmp_path / "s.csv")).collect()] == [("2000-11-01-7", 42)]
    (tmp_path / "u.json").write_text('{"business_id": "b", "state": "x", "more": 1}\n')
    assert readers.json_lines(spark, str(tmp_path / "u.json"), readers.BUSINESS).first()["state"] == "x"
    out = readers.rows(spark, [("a", 1.0)], "state string, stars double")
    sinks.write_csv(out, str(tmp_path / "o.csv"))
    sinks.write_json(out, str(tmp_path / "o.json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).first()["state"] == "a"
    assert sinks.json_object(out).first()["json"] == '{"state":"a","stars":1.0}'
