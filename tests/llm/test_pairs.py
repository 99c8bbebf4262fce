"""Near-duplicates, components and benchmark overlaps against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from milldam.llm import decontaminate, neardup
from milldam.llm.components import components
from milldam.llm.decontaminate import leaks, without_leaks
from milldam.llm.neardup import keep_one, near_duplicates
from milldam.llm.store import Scratch

from .cases import awkward, frame, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = BLANK.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """Sorted (doc_id, n, component, kept) of every row."""
    own = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(own)), 2):
        a, b = own[x][1], own[y][1]
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            root[find(x)] = find(y)
    out = []
    for x, (i, s) in enumerate(own):
        ids = [own[y][0] for y in range(len(own)) if find(y) == find(x) and own[y][0] is not None]
        c = min(ids) if ids else None
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [2, 5])
def test_awkward_rows(spark, k):
    rows = awkward()
    assert found(near_duplicates(frame(spark, rows, clash=True), k, 80)) == brute(rows, k, 80)


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies_without_ids(spark, k):
    """Null ids on either side of a link, between ids, and alone; repeated ids with other texts."""
    r = random.Random(9)
    body, other, lone = prose(r, 80), prose(r, 70), prose(r, 90)
    rows = [(5, body), (None, body + " tail"), (None, body + " tail end"), (9, body + " tail end of it"), (9, other), (3, other + " x"), (None, other)]
    rows += [(None, lone), (None, lone), (None, lone + " y"), (None, lone + " y z"), (None, ""), (None, "")]
    rows = [(i, t, None, None, None) for i, t in rows]
    assert found(near_duplicates(frame(spark, rows), k, 80)) == brute(rows, k, 80)
    out = sorted(((x["doc_id"], x["text"]) for x in keep_one(frame(spark, rows), k, 80).collect()), key=repr)
    kept = [x for x in out if x[1]]
    assert [x for x in out if not x[1]] == [(None, "")] * 2
    assert [x for x in kept if x[0] is not None] == [(3, other + " x"), (5, body)]
    assert len(kept) == 3 and kept[-1][1].startswith(lone)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = prose(r, 1)
    return " ".join(words)


def corpus(seed, groups, copies, edits):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = prose(r, 80).split()
        out += [edited(r, base, r.randint(0, edits)) for _ in range(copies)]
    r.shuffle(out)
    return [(i * 3, t, None, None, None) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed,groups,copies,edits", [(1, 12, 12, 8), (2, 2, 110, 10)])
def test_groups_of_near_copies(spark, seed, groups, copies, edits):
    rows = corpus(seed, groups, copies, edits)
    assert found(near_duplicates(frame(spark, rows), 2, 80)) == brute(rows, 2, 80)


def test_deep_trees_and_blocks(spark, monkeypatch):
    """Tiny limits send the same rows through branching and through blocks of large nodes."""
    rows = corpus(5, 3, 50, 9)
    want = brute(rows, 2, 80)
    for name, value in (("SMALL", 4), ("OUTSIDE", 6), ("WIDE", 30), ("HOT_PARTS", 400), ("BLOCK_OUTSIDE", 7), ("BLOCK_ALL", 11), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(neardup, name, value)
    assert found(near_duplicates(frame(spark, rows), 2, 80)) == want


def test_empty_table(spark):
    assert near_duplicates(frame(spark, []), 2, 80).count() == 0
    assert keep_one(frame(spark, [])).count() == 0


def test_keep_one(spark):
    rows = awkward()
    df = frame(spark, rows, clash=True)
    out = keep_one(df, 5, 80)
    assert out.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    assert ids == sorted(["1", "3", "4", "5", "6", "8", "9", "None", "None"])


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(3, 3), (3, 3), (None, 1)]
    got = {x["id"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    near = {}
    for a, b in edges[:-1]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    assert got == {x: reach(x) for x in near}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# -- benchmark -----------------------------------------------------------------------------------


def benchmark_rows(r):
    return [(i, prose(r, 30)) for i in range(6)] + [(6, None), (7, "too short to count"), (None, prose(r, 20)), (1, prose(r, 9))]


def planted(r, items):
    rows = awkward()
    for j, (_, text) in enumerate(items):
        if text is None:
            continue
        words = text.split()
        changed = [prose(r, 1) if k % 7 == 3 else w for k, w in enumerate(words)]
        rows.append((100 + j, prose(r, 40) + " " + " ".join(words).upper() + " " + prose(r, 40), None, None, None))
        rows.append((200 + j, prose(r, 40) + " " + " ".join(changed) + "! " + prose(r, 40), None, None, None))
        rows.append((300 + j, " ".join(r.sample(words, len(words))), None, None, None))
        rows.append((400 + j, " ".join(words[: len(words) // 4]) + " " + prose(r, 30), None, None, None))
    return rows


def test_leaks(spark):
    r = random.Random(11)
    items = benchmark_rows(r)
    rows = planted(r, items)
    df, bench = frame(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["n_matched"]) for x in leaks(df, bench).collect() if x["item_id"] is not None)
    whole = {(x[0], x[1]) for x in got}
    long_ = [j for j, (i, t) in enumerate(items) if t and len(t.split()) >= 20 and i is not None]
    assert {(100 + j, items[j][0]) for j in long_} <= whole
    assert {(200 + j, items[j][0]) for j in long_} <= whole
    assert all(d < 300 for d, _, _ in got)
    assert not any(d < 100 for d, _, _ in got)
    wide = {(x["doc_id"], x["item_id"], x["n_words"], x["n_matched"], x["first_word"]) for x in leaks(df, bench, 0).collect()}
    assert wide == {(x["doc_id"], x["item_id"], x["n_words"], x["n_matched"], x["first_word"]) for x in leaks(df, bench).collect()}
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns
    flagged = {x["doc_id"] for x in leaks(df, bench).collect()}
    assert kept.count() == sum(i not in flagged for i, *_ in rows)


def plain_leaks(rows, items):
    """Every diagonal with a long and equal enough stretch, its best stretch word by word, the best one of each pair."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOW))
    out = {}
    for i, t, *_ in rows:
        w = split(t)
        for item, text in items:
            g = split(text)
            for d in range(-len(g) + 1, len(w)):
                same = [0 <= d + k < len(w) and w[d + k] == x for k, x in enumerate(g)]
                if not enough(same) or (len(g) < decontaminate.SHORTEST and w != g):
                    continue
                run = begin = matched = top = 0
                best = (0, 0, 0)
                for k, hit in enumerate(same):
                    if run <= 0:
                        run, begin, matched = 0, k, 0
                    run, matched = run + (1 if hit else -2), matched + hit
                    if run > top:
                        top, best = run, (matched, begin - k - 1, -(d + begin))
                out[i, t, item] = max(out.get((i, t, item), best), best)
    return sorted(((i, item, -w, m, -f) for (i, _, item), (m, w, f) in out.items()), key=repr)


def enough(same):
    """Whether any long stretch of an alignment is equal enough; short items must be equal throughout."""
    least, sums = min(decontaminate.MIN_SPAN, len(same)), [0]
    for x in same:
        sums.append(sums[-1] + x)
    if len(same) < decontaminate.MIN_ITEM:
        return len(same) > 0 and all(same)
    return any(5 * (sums[b] - sums[a]) >= 4 * (b - a) for b in range(least, len(same) + 1) for a in range(b - least + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force(spark, seed):
    """Few words, so that chance hits abound, and items in pieces at every distance."""
    r = random.Random(seed)
    vocabulary = [prose(r, 1) for _ in range(14)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(12)]
    rows = awkward()
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        part = r.choice(items)[1].split()
        lo = r.randrange(len(part))
        part = [r.choice(vocabulary) if r.random() < r.choice([0, 0.1, 0.3]) else x for x in part[lo : lo + r.randint(5, 40)]]
        rows.append((100 + i, " ".join(words[:20] + part + words[20:]), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(rows, items)
    assert len(want) > 5
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        got = leaks(frame(spark, rows), bench, limit).collect()
        assert sorted(((x["doc_id"], x["item_id"], x["n_words"], x["n_matched"], x["first_word"]) for x in got), key=repr) == want


def overlapping(rows, items):
    """(doc_id, item_id) of all pairs with a long and equal enough stretch on any diagonal."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = set()
    for i, t, *_ in rows:
        w = split(t)
        for item, text in items:
            g = split(text)
            least = min(decontaminate.MIN_SPAN, len(g))
            for d in range(-len(g) + 1, len(w)):
                sums = [0]
                for k, x in enumerate(g):
                    sums.append(sums[-1] + (0 <= d + k < len(w) and w[d + k] == x))
                if any(5 * (sums[b] - sums[a]) >= 4 * (b - a) for b in range(least, len(g) + 1) for a in range(b - least + 1)):
                    out.add((i, item))
                    break
    return out


def test_leaks_of_trimmed_and_hidden_stretches(spark):
    """Substitutions near the ends, long half-equal stretches around equal ones, against all windows of all diagonals."""
    r = random.Random(21)
    items = [(i, prose(r, n)) for i, n in enumerate([8, 9, 10, 11, 12, 13, 15, 16, 25, 59, 120])]
    rows = []
    for item, text in items:
        for _ in range(12):
            words = text.split()
            for k in r.sample(range(len(words)), len(words) // 5):
                words[k] = prose(r, 1)
            rows.append((len(rows), prose(r, 5) + " " + " ".join(words) + " " + prose(r, 5), None, None, None))
    for item, whole, every in ((9, 13, 3), (10, 50, 4), (10, 13, 2)):
        words = items[item][1].split()
        rows.append((len(rows), " ".join(prose(r, 1) if k >= whole and k % every == 0 else w for k, w in enumerate(words)), None, None, None))
    want = overlapping(rows, items)
    assert len(want) > len(items) * 11
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        assert {(x["doc_id"], x["item_id"]) for x in leaks(frame(spark, rows), bench, limit).collect()} == want


def test_masks_miss_no_overlap():
    """No stretch that counts as an overlap escapes every mask."""
    masks = [(len(m), int(m, 2)) for m in decontaminate.MASKS]
    most = {0: 0}  # the last words' matches: the most matches so far
    for n in range(1, 2 * decontaminate.MIN_SPAN):
        step = {}
        for last, count in most.items():
            for same in (0, 1):
                now = (last << 1 | same) & 255
                if not any(now & m == m for size, m in masks if size <= n):
                    step[now] = max(step.get(now, 0), count + same)
        most = step
        assert n < decontaminate.MIN_ITEM or 5 * max(most.values()) < 4 * n


def test_leak_places(spark):
    r = random.Random(2)
    item = prose(r, 20)
    df = frame(spark, [(1, "one two three " + item + " four", None, None, None)])
    row = leaks(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["n_words"], x["n_matched"], x["first_word"]) for x in row] == [(1, 5, 20, 20, 3)]


def test_leaks_empty(spark):
    bench = spark.createDataFrame([(1, prose(random.Random(1), 20))], "item_id long, text string")
    assert leaks(frame(spark, []), bench).count() == 0
    assert leaks(frame(spark, awkward()), bench.limit(0)).count() == 0
    assert without_leaks(frame(spark, awkward()), bench.limit(0)).count() == len(awkward())
