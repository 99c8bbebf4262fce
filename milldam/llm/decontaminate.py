"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become word hashes. Each mask picks fixed places of a window and ignores the others, so a
window with substitutions still matches where a mask skips them. Seeds of the benchmark are joined
with seeds of the documents; around each hit that begins a run of hits, document and item are
aligned word by word: any stretch that is long and equal enough decides, and the best-scoring one
(match +1, substitution -2) tells the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neardup import TEXT_KEY
from .store import Scratch

#: Places of a window that count; 0s are ignored. Together they hit every stretch of 7 words or more of
#: which MIN_SHARE match; without the last, some of 10, 11, 12 and 15 words are missed.
MASKS = ("1101011", "1110101", "10011011", "1111")
#: Words that an overlap must span (or the whole item, if that has fewer) and the share that must match.
MIN_SPAN = 13
MIN_SHARE = 0.8
#: Items of fewer words must stand word for word: a substitution leaves them too little evidence.
MIN_ITEM = 8
#: Items too short for any mask are leaked only by documents that hold nothing else: inside other
#: texts one to three words stand by chance. Their seed is the whole list of words.
WHOLE = len(MASKS)
SHORTEST = min(map(len, MASKS))
#: Seeds of the benchmark that may be broadcast (about 60 bytes each); beyond it they are shuffled.
BROADCAST_SEEDS = 1_000_000
#: Leaking rows that may be broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000
#: Beyond the broadcast limit, places of documents are dealt to so many parts of their seed, so that a
#: very frequent seed is no hot key.
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words. Splitting takes a tenth of the time of extracting matches.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters, digits and all beyond ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _hashes(text: Column) -> Column:
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def _seed(mask: int, h: Column, at: Column) -> Column:
    places = [j for j, c in enumerate(MASKS[mask]) if c == "1"]
    fits = (at >= 0) & (at + len(MASKS[mask]) <= F.size(h))
    return F.when(fits, F.xxhash64(F.lit(mask), *(F.get(h, at + j) for j in places)))


def _seeds(table: DataFrame, h: str) -> DataFrame:
    """Adds at, mask and seed: a row for each place and mask of the hashes in ``h``."""
    n = F.size(h)
    starts = F.when(n >= SHORTEST, F.sequence(F.lit(0), n - SHORTEST)).otherwise(F.array(F.lit(0)))
    places = table.where(n > 0).withColumn("at", F.explode(starts))
    whole = F.when(n < SHORTEST, F.xxhash64(F.lit(WHOLE), F.col(h)))
    seeds = F.array(*(_seed(m, F.col(h), F.col("at")) for m in range(len(MASKS))), whole)
    return places.select("*", F.posexplode(seeds).alias("mask", "seed")).where("seed is not null")


def _aligned(h: Column, g: Column, diagonal: Column) -> Column:
    """The best stretch where ``h`` (from ``diagonal`` on) meets ``g``: its words, how many match, its start in g.

    ``over`` tells whether any stretch of MIN_SPAN words (or all of g) or more matches in MIN_SHARE of
    them (in all, if g has fewer than MIN_ITEM). A match adds what a substitution lacks, so such a stretch sums to 0 or more: the last
    words' sum (``window``) and the best sum that ends before them (``ahead``) find it.
    """
    zero = F.lit(0)
    gain = F.lit(round(100 * (1 - MIN_SHARE)))
    loss = F.when(F.size(g) < MIN_ITEM, -100_000).otherwise(-round(100 * MIN_SHARE))
    least = F.least(F.lit(MIN_SPAN), F.size(g))
    start = F.struct(zero.alias("i"), zero.alias("run"), zero.alias("at"), zero.alias("hit"), zero.alias("top"), zero.alias("words"), zero.alias("matched"), zero.alias("begin"), zero.alias("window"), zero.alias("ahead"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(F.get(h, diagonal + s["i"]) == x, F.lit(False))
        fresh = s["run"] <= 0
        run = F.when(fresh, 0).otherwise(s["run"]) + F.when(same, 1).otherwise(-2)
        at = F.when(fresh, s["i"]).otherwise(s["at"])
        hit = F.when(fresh, 0).otherwise(s["hit"]) + F.when(same, 1).otherwise(0)
        better = run > s["top"]
        left = s["i"] - least
        gone = F.when(left < 0, 0).when(F.get(h, diagonal + left) == F.get(g, left), gain).otherwise(loss)
        window = s["window"] + F.when(same, gain).otherwise(loss) - gone
        ahead = F.greatest(zero, s["ahead"] + gone)
        return F.struct(
            (s["i"] + 1).alias("i"), run.alias("run"), at.alias("at"), hit.alias("hit"),
            F.when(better, run).otherwise(s["top"]).alias("top"),
            F.when(better, s["i"] - at + 1).otherwise(s["words"]).alias("words"),
            F.when(better, hit).otherwise(s["matched"]).alias("matched"),
            F.when(better, at).otherwise(s["begin"]).alias("begin"),
            window.alias("window"), ahead.alias("ahead"), (s["over"] | ((left >= -1) & (window + ahead >= 0))).alias("over"),
        )

    # get() has null before the first and after the last word of the document, which matches nothing.
    return F.aggregate(g, start, step)


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, text key, item_id, n_words, n_matched, first_word: one row for each document and item that overlap.

    They overlap if, in an alignment without gaps, any stretch of MIN_SPAN words or more (or of the
    item's length, if smaller) has MIN_SHARE of them equal. Items of fewer than MIN_ITEM words must
    stand word for word, and those of fewer than SHORTEST be all that the document has. The best-scoring stretch of that alignment
    gives n_words, n_matched and first_word, and may itself be shorter or less equal. Of several
    alignments with one item the longest match counts. Null and short texts overlap with nothing; repeated rows (equal id and
    text) give one row; null ids stay null. Extra columns are ignored; empty tables give no rows.
    """
    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias(TEXT_KEY), _hashes(F.col("text")).alias("h"))
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("g")).where(F.size("g") > 0).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "g"))
    known = _seeds(items, "g")
    before = F.coalesce(*(F.when(F.col("mask") == m, _seed(m, F.col("g"), F.col("at") - 1)) for m in range(len(MASKS))))
    known = known.select("item", "seed", F.col("at").alias("item_at"), before.alias("before"))
    begins = F.coalesce(
        *(F.when(F.col("mask") == m, F.coalesce(_seed(m, F.col("h"), F.col("at") - 1) != F.col("before"), F.lit(True))) for m in range(len(MASKS))),
        F.lit(True),
    )
    places = _seeds(own, "h")
    if known.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        hits = places.join(F.broadcast(known), "seed").where(begins)
        hits = hits.withColumn("diagonal", F.col("at") - F.col("item_at"))
        hits = hits.join(F.broadcast(items), "item")
    else:
        # Only where a run of hits begins: one row for each run, not for each place.
        sides = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
        last = F.coalesce(*(F.when(F.col("mask") == m, _seed(m, F.col("h"), F.col("at") - 1)) for m in range(len(MASKS))))
        dealt = dealt.select("doc_id", TEXT_KEY, "at", "seed", "salt", last.alias("last"))
        found = dealt.join(sides, ["seed", "salt"]).where(F.coalesce(F.col("last") != F.col("before"), F.lit(True)))
        found = found.select(F.col("doc_id").alias("id"), F.col(TEXT_KEY).alias("key"), "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col(TEXT_KEY) == F.col("key"))
        hits = own.distinct().join(found, same).drop("id", "key").join(items, "item")
    best = hits.select("doc_id", TEXT_KEY, "item_id", "diagonal", _aligned(F.col("h"), F.col("g"), F.col("diagonal")).alias("s"))
    best = best.where("s.over")
    first = F.col("diagonal") + F.col("s.begin")
    best = best.groupBy("doc_id", TEXT_KEY, "item_id").agg(
        F.max(F.struct(F.col("s.matched").alias("m"), (-F.col("s.words")).alias("w"), (-first).alias("f"))).alias("b")
    )
    return best.select(
        "doc_id", TEXT_KEY, "item_id", (-F.col("b.w")).alias("n_words"), F.col("b.m").alias("n_matched"), (-F.col("b.f")).alias("first_word")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, with all their columns.

    Null and empty texts stay, as do all rows of an empty benchmark. Copies of a leaking text all go,
    since each row is searched: a row goes by its id and its text's hash, so no other id is touched.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col(TEXT_KEY).alias("__key")).distinct()
    found = scratch.save(found, "found")
    if found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    keyed = docs.withColumn(TEXT_KEY, F.xxhash64("text"))
    kept = keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed[TEXT_KEY] == F.col("__key")), "left_anti")
    return kept.select(*(kept[c] for c in docs.columns))
