"""Mixing and sharding against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from milldam.llm import mixing, sharding

from .cases import awkward, frame, prose

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=400):
    r = random.Random(seed)
    rows = awkward()
    texts = [prose(r, r.randint(1, 60)) for _ in range(n // 4)]
    for i in range(n):
        source = "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "é", None])
        rows.append((1000 + i, r.choice(texts), None, source, None))
    return rows


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def plain_mix(rows):
    """(doc_id, size, taken) of every row."""
    def size(t):
        return len(BLANK.findall(t or ""))

    def key(row):
        name = f"text:{row[1] or ''}" if row[0] is None else str(row[0])
        u = (int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        t = row[1] or ""
        symbols = sum(t.count(c) for c in mixing.SYMBOLS)
        lines = [x for x in t.split("\n") if x]
        fresh = len(set(lines)) / len(lines) if lines else 1.0
        return -math.log(u) / max(0.1, (1 - 4 * symbols / max(1, len(t))) * fresh)

    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r[1])
    target, out = plain_targets(total), []
    for s, t in target.items():
        epochs = int(t // total[s]) if total[s] else 0
        rest = int(t - epochs * total[s])
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: (key(r), r[0] is not None, r[0])):
            part = min(max(rest, 0), size(r[1]))
            rest -= size(r[1])
            out.append((r[0], size(r[1]), epochs * size(r[1]) + part))
    return target, sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_mix_equals_plain(spark, monkeypatch, limit):
    rows = [(i, *r[1:]) for i, r in enumerate(corpus())]  # ids that tell rows apart
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    monkeypatch.setattr(mixing, "BROADCAST_STEPS", limit)
    rows += [(5000 + i, "same line\n" * 5 + "#$%&*" * i, None, "hot", None) for i in range(30)] + [(None, prose(random.Random(i), 9), None, "a", None) for i in range(30)]
    got = mixing.mix(frame(spark, rows, clash=True)).collect()
    target, want = plain_mix(rows)
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr) == want
    assert {r["source"]: round(r["target"], 6) for r in got} == {s: round(t, 6) for s, t in target.items()}


def test_buckets_are_even(spark, monkeypatch):
    """Keys of every weight fill their buckets alike."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 500)
    docs = spark.range(40_000).selectExpr("id as doc_id", "case when id % 3 = 0 then '#$%&*|!' else 'plain text' end as text", "'hot' as source")
    seen = []
    real = mixing.Scratch.save

    def save(self, df, name):
        out = real(self, df, name)
        if name == "steps":
            seen.append(out)
        return out

    monkeypatch.setattr(mixing.Scratch, "save", save)
    rows = mixing.mix(docs)
    assert rows.count() == 40_000
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan
    steps = seen[0].groupBy("bucket").count().count()
    assert 70 <= steps <= 81  # 40,000 rows in buckets of 500 and a step more


def test_mix_limits(spark):
    got = mixing.mix(frame(spark, corpus())).collect()
    assert len(got) == len(corpus())
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 1.0001 for s in target)


def test_draw(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(corpus())]
    df = frame(spark, rows, clash=True)
    out = mixing.draw(df)
    assert out.columns == df.columns
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(df).collect()}
    times = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    for i, (t, n) in taken.items():
        if n:
            assert times[i] == -(-t // n)


def test_mix_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.draw(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", None)])).collect()
    assert {(r["doc_id"], r["taken"], r["target"]) for r in got} == {(1, 0, 0.0), (2, 0, 0.0)}


@pytest.mark.parametrize("n", [0, 5, 400])
def test_shards(spark, n):
    rows = corpus(n=n) if n else []
    got = sharding.balanced_shards(frame(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots.get(j, [])) for j in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_links_pull_together(spark):
    r = random.Random(8)
    rows = [(10 * g + c, prose(random.Random(g), 10), None, None, None) for g in range(300) for c in range(4)]
    r.shuffle(rows)
    got = sharding.balanced_shards(frame(spark, rows)).collect()
    spread = defaultdict(set)
    for x in got:
        spread[x["doc_id"] // 10].add(x["shard"])
    assert sum(len(s) == 1 for s in spread.values()) > 200


def spark_hash(*values):
    """The session's 64-bit hash: str, int (four bytes) or (int,) (eight bytes); None changes nothing."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return struct.unpack("<q", struct.pack("<Q", seed))[0]


def signed(value):
    return (value,) if value is not None else None


def plain_propagation(rows, shards):
    """The shard of every linked row (doc_id, text) before counts are evened out, cell by cell."""
    goal, fraction = len(rows) // shards, lambda *of: spark_hash(*of) % (1 << 30) / (1 << 30)
    team = lambda t: spark_hash(t or "", signed(zlib.crc32((t or "").encode())), len((t or "").encode()))
    cell = lambda i, t: (team(t), spark_hash(signed(i), "start") % shards, spark_hash(signed(i), "part") % sharding.PARTS)
    count = Counter(cell(i, t) for i, t, *_ in rows)
    members = Counter()
    for c, n in count.items():
        members[c[0]] += n
    where, strict, turn = {c: c[1] for c in count if members[c[0]] > 1}, True, 1
    while turn <= sharding.ROUNDS:
        most = goal if strict else int(goal * (1 + sharding.SLACK)) + 1
        size, votes = [0] * shards, defaultdict(Counter)
        for c, j in where.items():
            size[j] += count[c]
            votes[c[0]][j] += count[c]
        free = [most - n for n in size]
        open_ = [j for j in range(shards) if free[j] > 0]
        asks = {}
        for t, v in votes.items():
            if len(v) == 1:
                continue
            own = [(free[j] >= members[t] - n, n, spark_hash((t,), j), j) for j, n in v.items() if free[j] > 0]
            best = max(own, default=None)
            fits, target = bool(best and best[0]), best[3] if best else None
            if open_ and not fits:
                other = open_[spark_hash((t,), turn) % len(open_)]
                if free[other] >= members[t]:
                    fits, target = True, other
            for c, j in where.items():
                rank = lambda k: (v[k], spark_hash((t,), k))  # noqa: B023, E731
                if c[0] == t and target is not None and j != target and (fits or (strict and rank(j) < rank(target))):
                    asks[c] = target, fraction((t,), turn) if fits else fraction((t,), c[1], c[2], turn)
        wanted = Counter()
        for c, (target, _) in asks.items():
            wanted[where[c], target] += count[c]
        share = sharding.quotas(size, wanted, most)
        if sum(n * share[j] for (_, j), n in wanted.items()) < 1:
            if not strict:
                break
            strict = False
            continue
        for c, (target, draw) in asks.items():
            if draw < share[target]:
                where[c] = target
        turn += 1
    return {(i, t): where[cell(i, t)] for i, t, *_ in rows if cell(i, t) in where}


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 150), (3, 40)])
def test_propagation_equals_plain(spark, seed, hot):
    """Groups of copies of all sizes, one larger than a shard: each linked row goes where the rounds send it."""
    r = random.Random(seed)
    rows = [(i, "the hot text") for i in range(hot)]
    for g in range(40):
        rows += [(1000 * g + 500 + c, prose(random.Random(1000 * seed + g), 8)) for c in range(r.choice([1, 2, 3, 7, 15]))]
    rows += [(90_000 + i, prose(r, 6)) for i in range(200)] + [(90_500, None), (90_501, ""), (None, "lone"), (90_502, "lone")]
    rows = [(i, t, None, None, None) for i, t in rows]
    want = plain_propagation(rows, 6)
    got = {x["doc_id"]: x for x in sharding.balanced_shards(frame(spark, rows), 6).collect()}
    load = Counter(want.values())
    assert len(want) > 100 and len(got) == len(rows)
    for (i, _), shard in want.items():
        assert got[i]["shard"] == shard or load[shard] > len(rows) // 6  # a shard with more linked rows hands some on


def test_sharded_rows_keep_all_columns(spark):
    rows = corpus(n=60)
    df = frame(spark, rows, clash=True)
    out = sharding.sharded_rows(df)
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.columns == [c for c in df.columns if c not in new] + new
    key = lambda r: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
    assert Counter(map(key, out.collect())) == Counter(map(key, df.collect()))
    same = Counter((r["doc_id"], r["shard"], r["slot"]) for r in sharding.balanced_shards(df).collect())
    ids = Counter(r["doc_id"] for r in df.collect())
    assert {k: n for k, n in Counter((r["doc_id"], r["shard"], r["slot"]) for r in out.collect()).items() if ids[k[0]] == 1} == {k: n for k, n in same.items() if ids[k[0]] == 1}


def test_one_group_of_copies(spark):
    rows = [(i, "same text", None, None, None) for i in range(200)] + [(1000 + i, f"text {i}", None, None, None) for i in range(300)]
    got = sharding.balanced_shards(frame(spark, rows)).collect()
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 24


def test_quotas():
    share = sharding.quotas([10, 10, 4], {(0, 1): 5, (1, 0): 5, (0, 2): 8}, 10)
    assert share[2] == pytest.approx(0.75)
    assert 0 < share[0] <= 1 and 0 <= share[1] <= 1
