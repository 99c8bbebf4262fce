"""MinHash near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles, and equal sets one *class*. Independent trees branch the
classes: a node's children are picked by the minwise tokens at positions that the node's own name
chooses, so two sets of similarity s stay together in a child with probability s. Nodes that have
become small are compared exhaustively, as is every node at the depth limit. Every pair that the
sketches do not rule out is confirmed on the full sets.

Two sweeps keep hot groups cheap. The first links every class with the first class (the pivot) of
its root nodes; what is linked shares a label. The second descends the trees with these labels:
nodes of one label have nothing left to find, and in the others only pairs of different labels are
compared, those outside the pivot's label against all. No link between labels is skipped, so the
components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch
from .textops import blocks, mix, words

POSITIONS = 64
TREES = 2
ROOTS = 4
CHILDREN = 2
DEPTH = 8
#: Nodes up to this many classes are compared at once; so are larger ones with few classes outside
#: their commonest label, which takes less than branching them on. The rest is branched down to DEPTH.
SMALL = 200
OUTSIDE = 1_024
#: A node that keeps SHRINK of its parent would multiply its rows from level to level (twice SHRINK each),
#: so it is compared already with WIDE classes outside, which costs a row about as much as all levels.
SHRINK, WIDE = 0.7, 1 << 16
#: Nodes with more than one of so many parts of all rows are hot: there are at most as many of them,
#: so they are broadcast, and their rows are joined where they lie.
HOT_PARTS = 10_000
#: Sides of the blocks in which large nodes are compared.
BLOCK_OUTSIDE, BLOCK_ALL = 512, 2048
#: Ids that may be broadcast to pick texts (8 bytes each); beyond it the texts are shuffled instead.
BROADCAST_IDS = 1_000_000
#: Pairs whose sets are in memory at once when they are confirmed.
CONFIRM_ROWS = 256
TEXT_KEY = "__text_key"
#: The two halves of a set's name.
NAME = ["c0", "c1"]

_rng = np.random.default_rng(8021)
_XOR = _rng.integers(0, 2**63, size=POSITIONS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, size=POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles (hashed) of each text, one after another, and their bounds."""
    h, at, _ = words(data, ends)
    first, last = at[:-1], at[1:]
    have = last - first
    short = (have < k) & (have > 0)
    n = np.where(short, 1, np.maximum(have - k + 1, 0))
    to = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(to[-1], dtype=np.uint64)
    if len(h) >= k:
        roll = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            roll = mix(roll * _STEP + h[j : len(h) - k + 1 + j])
        rows = np.repeat(np.arange(len(n)), np.where(short, 0, n))
        long_at = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(np.where(short, 0, n))])[:-1], np.where(short, 0, n))
        out[to[rows] + long_at] = roll[first[rows] + long_at]
    for i in np.flatnonzero(short):
        x = have[i : i + 1].astype(np.uint64)
        for j in range(first[i], last[i]):
            x = mix(x * _STEP + h[j : j + 1])
        out[to[i]] = x[0]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[to[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[to]


def set_names(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each set (two int64); zeros for empty sets."""
    out = np.zeros((2, len(at) - 1), dtype=np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        n = (at[1:] - at[:-1])[full].astype(np.uint64)
        for half, key in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            a = np.add.reduceat(mix(sets ^ np.uint64(key)), at[:-1][full])
            b = np.bitwise_xor.reduceat(mix(sets + np.uint64(0x14057B7EF767814F + half)), at[:-1][full])
            out[half, full] = mix(a + mix(b + n)) | np.uint64(1)
    return out[0].view(np.int64), out[1].view(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values (32 bits) of each set; zeros for empty sets."""
    out = np.zeros((len(at) - 1, POSITIONS), dtype=np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        starts = at[:-1][full]
        for j in range(POSITIONS):
            out[full, j] = np.minimum.reduceat((sets ^ _XOR[j]) * _MUL[j], starts) >> np.uint64(32)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of every position, sixteen positions to a long."""
    bits = (mix(sig.astype(np.uint64) + np.uint64(1)) >> np.uint64(17)) & np.uint64(15)
    shift = (np.arange(16, dtype=np.uint64) * np.uint64(4))[None, None, :]
    return (bits.reshape(len(sig), 4, 16) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, ends in blocks(batch.column(1)):
                sets, at = shingle_sets(data, ends, k)
                sig = signatures(sets, at)
                sk = sketches(sig)
                flat = pa.array(sig.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array((at[1:] - at[:-1]))]
                    + [pa.array(half) for half in set_names(sets, at)]
                    + [pa.array(np.ascontiguousarray(sk[:, j])) for j in range(4)]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * POSITIONS), flat)],
                    names=["doc_id", TEXT_KEY, "row", "n_shingles", *NAME, "s0", "s1", "s2", "s3", "sig"],
                )

    return run


def _named(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi, data, ends in blocks(texts):
                sets, at = shingle_sets(data, ends, k)
                yield pa.RecordBatch.from_arrays([*map(pa.array, set_names(sets, at)), texts.slice(lo, hi - lo)], names=[*NAME, "text"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, CONFIRM_ROWS) for whole in batches for lo in range(0, whole.num_rows, CONFIRM_ROWS)):
            a, b = [], []
            for column, out in ((batch.column(2), a), (batch.column(3), b)):
                for _, _, data, ends in blocks(column):
                    sets, at = shingle_sets(data, ends, k)
                    out += [sets[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype=np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.int64) - both
            linked = pa.array((100 * both >= percent * either) & (both > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(linked), batch.column(1).filter(linked)], names=["a", "b"])

    return run


def _agree(x: str, y: str) -> Column:
    """Positions whose four bits agree."""
    out = F.lit(POSITIONS)
    for j in range(4):
        d = F.col(f"{x}.s{j}").bitwiseXOR(F.col(f"{y}.s{j}"))
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2))
        out = out - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def _likely(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_agree(x, y) >= _least(percent))


def _row_key() -> Column:
    """What a class finds one of its rows by, null ids too; a row that is found by chance has another set's name."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _texts(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(cls, text) of the classes in ``wanted`` (cls)."""
    ids = scratch.save(classes.select("cls", *NAME, "row").join(wanted, "cls", "left_semi"), "ids")
    pick = ids.select("row").distinct()
    if ids.count() <= BROADCAST_IDS:
        pick = F.broadcast(pick)
    texts = docs.withColumn("row", _row_key()).join(pick, "row", "left_semi").select("text").mapInArrow(_named(k), "c0 long, c1 long, text string")
    return texts.join(ids.select("cls", *NAME), NAME).select("cls", "text").dropDuplicates(["cls"])


def _at_nodes(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows`` (node, cls, ..) with the columns of their node in ``nodes`` (node, n, ..); rows of no node drop out.

    Rows of hot nodes meet the broadcast node in place, and go anywhere in the join of all others.
    """
    more = [c for c in nodes.columns if c != "node"]
    least = total // HOT_PARTS + SMALL
    hot = nodes.where(F.col("n") > least).select(F.col("node").alias("__hot"), *(F.col(c).alias(f"__h_{c}") for c in more))
    cold = nodes.where(F.col("n") <= least).select(F.col("node").alias("__cold"), *(F.col(c).alias(f"__c_{c}") for c in more))
    met = rows.join(F.broadcast(hot), F.col("node") == F.col("__hot"), "left")
    met = met.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("node")).otherwise(F.xxhash64("node", "cls")))
    met = met.join(cold, F.col("__key") == F.col("__cold"), "left").where("__hot is not null or __cold is not null")
    at = [F.when(F.col("__hot").isNotNull(), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c) for c in more]
    return met.select(*rows.columns, *at)


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), classes, k, scratch)
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    held = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent), "a long, b long")
    return scratch.save(held, "links")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns (int64), of batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _agreeing(sk: np.ndarray, one: np.ndarray) -> np.ndarray:
    """For each row of sketches, the positions that agree with ``one``."""
    d = sk ^ one
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return POSITIONS - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def _least(percent: int) -> int:
    """Agreeing positions that a pair at the threshold has but for 4.5 standard errors."""
    s = percent / 100
    p = s + (1 - s) / 16
    return int(POSITIONS * p - 4.5 * (POSITIONS * p * (1 - p)) ** 0.5)


def _candidates(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each outside row of a block with the rows it may be linked to (columns as in _blocks)."""
    col = {n: group.column(n).to_numpy() for n in ("cls", "n_shingles", "label", "outside", "hub")}
    sk = np.stack([group.column(f"s{j}").to_numpy() for j in range(4)], axis=1).view(np.uint64)
    mine, all_ = np.flatnonzero(col["outside"] == 1), np.flatnonzero(col["outside"] == 0)
    n, label, cls = col["n_shingles"][all_], col["label"][all_], col["cls"][all_]
    hub, sk_all, least = label == col["hub"][all_], sk[all_], _least(percent)
    for i in mine.tolist():
        m = col["n_shingles"][i]
        some = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (label != col["label"][i]) & (hub | (cls > col["cls"][i]))
        some = np.flatnonzero(some)
        some = some[_agreeing(sk_all[some], sk[i]) >= least]
        if len(some):
            yield i, all_[some]


def _involved(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rows = set()
            for i, others in _candidates(group, percent):
                rows.add(i)
                rows.update(others.tolist())
            if rows:
                yield from group.take(pa.array(sorted(rows))).combine_chunks().to_batches()

    return run


def _linked(k: int, percent: int):
    """Links that join the labels of a block as all its links would: none between what they already join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            cls, label = group.column("cls").to_numpy(), group.column("label").to_numpy()
            sets = []
            for _, _, data, ends in blocks(group.column("text")):
                flat, at = shingle_sets(data, ends, k)
                sets += [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            size = np.array([len(x) for x in sets])
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            bound = np.concatenate([[0], np.cumsum(size)])
            mark = np.zeros(codes.max() + 1, dtype=np.int64)
            team = np.unique(label, return_inverse=True)[1]
            root = np.arange(team.max() + 1)
            a, b = [], []
            for i, others in _candidates(group, percent):
                others = others[root[team[others]] != root[team[i]]]
                if not len(others):
                    continue
                own = codes[bound[i] : bound[i + 1]]
                mark[own] = 1
                both = np.add.reduceat(mark[np.concatenate([codes[bound[j] : bound[j + 1]] for j in others])], np.concatenate([[0], np.cumsum(size[others])[:-1]]))
                mark[own] = 0
                close = others[100 * both >= percent * (size[i] + size[others] - both)]
                found, at = np.unique(root[team[close]], return_index=True)
                for j in at:
                    a.append(cls[i])
                    b.append(cls[close[j]])
                root[np.isin(root, found)] = root[team[i]]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _large_links(docs: DataFrame, nodes: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between labels in large nodes (node, cls, sketch, label, hub, n, n_hub): blocks of
    classes outside the hub against blocks of all. Sketches meet first, and only where they allow a
    link do texts come to the block, each once."""
    parts_out = F.ceil((F.col("n") - F.col("n_hub")) / BLOCK_OUTSIDE).cast("long")
    parts_all = F.ceil(F.col("n") / BLOCK_ALL).cast("long")
    zero = F.lit(0).cast("long")
    bx, by = F.pmod(F.xxhash64("cls", F.lit(1)), parts_out), F.pmod(F.xxhash64("cls", F.lit(2)), parts_all)
    cols = ["node", "bx", "by", "cls", "n_shingles", "s0", "s1", "s2", "s3", "label", "hub", "outside"]
    out = nodes.where(F.col("label") != F.col("hub")).withColumn("bx", bx)
    out = out.withColumn("by", F.explode(F.sequence(zero, parts_all - 1))).withColumn("outside", F.lit(1)).select(cols)
    all_ = nodes.withColumn("by", by)
    all_ = all_.withColumn("bx", F.explode(F.sequence(zero, parts_out - 1))).withColumn("outside", F.lit(0)).select(cols)
    keys = ["node", "bx", "by"]
    dealt = out.unionByName(all_).repartition(*keys).sortWithinPartitions(*keys)
    part = scratch.save(dealt.mapInArrow(_involved(percent), dealt.schema), "involved")
    texts = _texts(docs, part.select("cls").distinct(), classes, k, scratch)
    filled = part.join(texts, "cls").select(*cols, "text").repartition(*keys).sortWithinPartitions(*keys)
    return scratch.save(filled.mapInArrow(_linked(k, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * |intersection| >= percent * |union| of their distinct k-word
    shingles (fewer words: the whole sequence is one shingle). component_id is the smallest doc_id
    reachable over links; kept marks the document whose id that is. Null and empty texts have no
    shingles and are linked with nothing. Rows that repeat a doc_id are scored like any others, each
    by its own text; null ids never represent a component (component_id is null only if all are).
    Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    keyed = TEXT_KEY in docs.columns
    key = F.col(TEXT_KEY) if keyed else F.lit(0).cast("long").alias(TEXT_KEY)
    profile = docs.select(F.col("doc_id").cast("long"), "text", key, _row_key().alias("row")).mapInArrow(
        _profile(k), f"doc_id long, {TEXT_KEY} long, row long, n_shingles long, c0 long, c1 long, s0 long, s1 long, s2 long, s3 long, sig array<int>"
    )
    docs = docs.select("doc_id", "text")
    profile = scratch.save(profile, "profile")
    per_class = ["n_shingles", "s0", "s1", "s2", "s3"]
    # Equal sets are one class; its number is drawn once, so that no two classes share it.
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    classes = profile.where("n_shingles > 0").groupBy(*NAME).agg(head, *(F.first(c).alias(c) for c in per_class), F.first("sig").alias("sig"))
    classes = classes.select(F.monotonically_increasing_id().alias("cls"), *NAME, F.col("head.doc_id").alias("rep"), F.col("head.row").alias("row"), *per_class, "sig")
    classes = scratch.save(classes, "classes")
    labels = _sweeps(docs, classes, k, percent, scratch)
    member = classes.select("cls", *NAME, "rep").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = member.groupBy("label").agg(F.min("rep").alias("component"))
    member = scratch.save(member.join(smallest, "label").select(*NAME, "component", "label"), "members")
    scratch.keep(profile, member)
    out = profile.select("doc_id", TEXT_KEY, "n_shingles", *NAME).join(member, NAME, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    kept = F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull())
    own = [TEXT_KEY, "label"] if keyed else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *own)


def _sweeps(docs: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(cls, label) of the classes that have links: one label for each component."""
    sketch = ["n_shingles", "s0", "s1", "s2", "s3"]
    total = classes.count() * TREES * ROOTS

    def roots(table: DataFrame, more: list[str]) -> DataFrame:
        """TREES * ROOTS nodes of every class; each tree has positions of its own at its root."""
        nodes = [F.xxhash64(F.lit(t), F.lit(j), F.col("sig")[t * (POSITIONS // TREES) + j]) for t in range(TREES) for j in range(ROOTS)]
        return table.select(F.posexplode(F.array(*nodes)).alias("root", "node"), "cls", *sketch, *more)

    # First sweep: every class against the pivot of its root nodes.
    nodes = roots(classes, ["c0"])
    pivots = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("c0", "cls", *sketch)).alias("y")).where("n > 1")
    met = _at_nodes(nodes.select("node", "cls", F.struct("cls", *sketch).alias("x")), pivots, total)
    met = met.where((F.col("x.cls") != F.col("y.cls")) & _likely("x", "y", percent))
    a, b = F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")
    tried = scratch.save(met.select(a, b).distinct(), "tried")
    links = _verify(docs, tried, classes, k, percent, scratch)
    first = components(links, scratch)

    # Second sweep: down the trees, where labels still differ.
    marked = classes.join(first.withColumnRenamed("id", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    state, finals, heavy = roots(marked, ["label"]).withColumn("up", F.lit(1 << 60)), None, None
    for depth in range(1, DEPTH + 1):
        stats = state.groupBy("node").agg(
            F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        mixed = stats.where("lo != hi").select("node", "n", F.col("lo").alias("hub"))
        level = scratch.save(_at_nodes(state, mixed, total), f"level{depth}")
        done = level.where(F.col("n") <= SMALL)
        finals = done if finals is None else finals.unionByName(done)
        large = level.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        # In large nodes the hub is the commonest label; only what is outside it is compared with all.
        votes = large.groupBy("node", "label").count().groupBy("node").agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top"))
        votes = votes.select("node", "n", F.col("top.label").alias("hub"), F.col("top.count").alias("n_hub"))
        outside = F.col("n") - F.col("n_hub")
        last = (outside <= F.when(F.col("n") >= SHRINK * F.col("up"), max(OUTSIDE, WIDE)).otherwise(OUTSIDE)) | F.lit(depth == DEPTH)
        large = scratch.save(_at_nodes(large.drop("n", "hub"), votes, total).withColumn("last", last), f"large{depth}")
        ended = large.where("last").drop("last")
        heavy = ended if heavy is None else heavy.unionByName(ended)
        large = large.where("not last").withColumn("up", F.col("n")).drop("n", "hub", "n_hub", "last").join(classes.select("cls", "sig"), "cls")
        if depth == DEPTH or large.isEmpty():
            break
        # A tree has POSITIONS // TREES positions of its own, so the trees are independent.
        share = POSITIONS // TREES
        pick = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(share)).cast("int")
        skip = F.pmod(F.xxhash64("node", F.lit(-depth)), F.lit(share - 1)).cast("int") + 1
        tree = F.floor(F.col("root") / ROOTS).cast("int")
        places = [tree * share + F.pmod(pick + skip * c, F.lit(share)) for c in range(CHILDREN)]
        children = [F.xxhash64("node", F.lit(depth), p, F.element_at("sig", p + 1)) for p in places]
        state = large.select("root", F.explode(F.array(*children)).alias("node"), "cls", *sketch, "label", "up")
    # Large nodes first, those of one root before all others: what they link leaves most other nodes
    # with a single label, and those drop out.
    if heavy is not None:
        for turn in (F.col("root") == 0, F.col("root") > 0):
            links = links.unionByName(_large_links(docs, _current(heavy.where(turn), first, total, scratch), classes, k, percent, scratch))
            first = components(links, scratch)
        finals = _current(finals, first, total, scratch)
    outside = finals.where(F.col("label") != F.col("hub")).alias("x")
    pair = outside.join(finals.alias("y"), "node").where(
        (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.hub")) | (F.col("x.cls") < F.col("y.cls")))
        & _likely("x", "y", percent)
    )
    fresh = pair.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    fresh = scratch.save(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verify(docs, fresh, classes, k, percent, scratch))
    return components(links, scratch).withColumnRenamed("id", "cls")


def _current(nodes: DataFrame, labels: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """``nodes`` with the labels of now, their size and commonest label; nodes of one label are gone."""
    now = labels.select(F.col("id").alias("cls"), F.col("label").alias("now"))
    rows = nodes.select("node", "cls", "n_shingles", "s0", "s1", "s2", "s3", "label").join(now, "cls", "left")
    rows = rows.withColumn("label", F.coalesce("now", "label")).drop("now")
    votes = rows.groupBy("node", "label").count().groupBy("node")
    votes = votes.agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top"))
    votes = votes.select("node", "n", F.col("top.label").alias("hub"), F.col("top.count").alias("n_hub")).where("n_hub < n")
    return scratch.save(_at_nodes(rows, votes, total), "nodes")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document represents its component, with all their columns.

    Rows that repeat both id and text stay once. Of a component without any id one text stays, and of
    its copies one row. Rows without words (null, empty, blank) stay, but for repeats of one id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "keepone")
    keyed = docs.withColumn(TEXT_KEY, F.xxhash64("text"))
    marks = scratch.save(near_duplicates(keyed, k, percent), "marks")
    nameless = marks.where("doc_id is null and component_id is null and n_shingles > 0")
    heads = nameless.groupBy("label").agg(F.min(TEXT_KEY).alias("head"))
    others = nameless.join(heads, "label").where(F.col(TEXT_KEY) != F.col("head"))
    gone = marks.where("not kept").select("doc_id", TEXT_KEY).unionByName(others.select("doc_id", TEXT_KEY)).distinct()
    again = marks.where("doc_id is not null or n_shingles > 0").groupBy("doc_id", TEXT_KEY).count().where("count > 1").select("doc_id", TEXT_KEY)

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        other = keys.select(F.col("doc_id").alias("__id"), F.col(TEXT_KEY).alias("__key"))
        other = F.broadcast(other) if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else other
        return rows.join(other, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows[TEXT_KEY] == F.col("__key")), how)

    kept = matched(keyed, scratch.save(gone, "gone"), "left_anti")
    again = scratch.save(again, "again")
    if not again.isEmpty():
        single = matched(kept, again, "left_anti")
        kept = single.unionByName(matched(kept, again, "left_semi").dropDuplicates(["doc_id", TEXT_KEY]))
    return kept.select(*(kept[c] for c in docs.columns))
