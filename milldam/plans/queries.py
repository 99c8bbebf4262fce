"""The queries over the reference operators, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import digest_number
from ..functions.text import word_set
from ..operators import explore, graph, itemsets, recommend, similarity
from ..session import saved, shared_dir, table
from ..sources import sinks
from ..streaming import programs, sketches
from . import derived as d

#: Absolute supports, and the items that a retail basket must exceed.
SUPPORT_1, SUPPORT_2, SUPPORT_RETAIL, RETAIL_ITEMS = 400, 3, 3, 4
BANDS, ROWS = 13, 2
SINCE = "1995"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


# -- exploration ---------------------------------------------------------------------------------


@query
def user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explore.user_summary(d.users(spark, sf_dir), SINCE)
    return out.withColumn("avg_reviews", F.round("avg_reviews", 6))


@query
def top10_popular_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_names(d.users(spark, sf_dir))


@query
def top10_most_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_reviewers(d.users(spark, sf_dir))


@query
def state_avg_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explore.state_averages(d.businesses(spark, sf_dir), d.reviews(spark, sf_dir))
    return out.select("state", F.round("stars", 6).alias("stars"))


@query
def top5_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_avg_stars(spark, sf_dir).orderBy(F.desc("stars"), "state").limit(5)


@query
def partition_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = d.users(spark, sf_dir)
    own = explore.partition_profile(users).withColumn("dealt", F.lit("default"))
    return own.unionByName(explore.custom_profile(users, "user_id", 8).withColumn("dealt", F.lit("custom")))


@query
def partition_profile_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod("user_id", F.lit(8)).cast("int").alias("partition")
    return d.users(spark, sf_dir).groupBy(part).agg(F.count("*").alias("n_items"))


@query
def round_robin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = d.users(spark, sf_dir)
    sizes = explore.round_robin_profile(users, 8)
    even = F.max("n_items") - F.min("n_items") <= users.rdd.getNumPartitions()
    return sizes.agg(F.count("*").alias("n_partitions"), F.sum("n_items").alias("n_items"), even.alias("even"))


@query
def collect_vs_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.collect_or_take(state_avg_stars(spark, sf_dir))


# -- itemsets ------------------------------------------------------------------------------------


def _brand_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(d.order_brands(spark, sf_dir), "o", "b")


def _order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(d.retail(spark, sf_dir), "item", "key")


def _retail_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.baskets(d.retail(spark, sf_dir), "key", "item", RETAIL_ITEMS)


def _flat(sets: DataFrame, *more: str) -> DataFrame:
    items = F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items")
    return sets.select(F.size("items").alias("size"), items, *more)


@query
def baskets_case1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_brand_sets(spark, sf_dir), F.col("key").alias("basket"))


@query
def baskets_case2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(itemsets.baskets(d.order_brands(spark, sf_dir), "b", "o"), F.col("key").alias("basket"))


@query
def retail_baskets_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_retail_sets(spark, sf_dir), F.col("key").alias("basket"))


@query
def son_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(itemsets.local_candidates(saved(_brand_sets(spark, sf_dir), "baskets"), SUPPORT_1, shards=4))


@query
def son_frequent_case1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(itemsets.frequent(saved(_brand_sets(spark, sf_dir), "baskets"), SUPPORT_1), "n")


@query
def son_two_phase_case1(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = saved(_brand_sets(spark, sf_dir), "baskets")
    return _flat(itemsets.confirmed(sets, itemsets.local_candidates(sets, SUPPORT_1, shards=4), SUPPORT_1), "n")


@query
def son_frequent_case2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(itemsets.frequent(_order_sets(spark, sf_dir), SUPPORT_2), "n")


@query
def son_frequent_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(itemsets.frequent(_retail_sets(spark, sf_dir), SUPPORT_RETAIL), "n")


@query
def itemset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.itemset_lines(itemsets.frequent(saved(_brand_sets(spark, sf_dir), "baskets"), SUPPORT_1))


# -- similarity ----------------------------------------------------------------------------------


def _word_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.document_words(spark, sf_dir).select("item", digest_number(F.col("word")).alias("member"))


def _word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("item"), F.transform(word_set(F.col("text")), digest_number).alias("members"))


@query
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signatures(_word_members(spark, sf_dir), BANDS * ROWS)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(minhash_signatures(spark, sf_dir), "signatures")


@query
def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.candidate_pairs(_signed(spark, sf_dir), BANDS, ROWS)


@query
def lsh_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.similar_items(_word_lists(spark, sf_dir), BANDS, ROWS, 0.5)
    return out.withColumn("similarity", F.round("similarity", 6))


@query
def exact_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.all_similar_items(_word_lists(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 6))


# -- recommenders --------------------------------------------------------------------------------


def _rated(spark: SparkSession, sf_dir: str, brands: bool = False) -> tuple[DataFrame, DataFrame]:
    return d.split(saved(d.ratings(spark, sf_dir, brands), "ratings"))


def _rounded(df: DataFrame, column: str = "prediction") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@query
def als_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.als_predictions(*_rated(spark, sf_dir))


@query
def cold_start_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.cold_pairs(*_rated(spark, sf_dir))


@query
def user_cf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.user_similarity(*_rated(spark, sf_dir)).where("sim is not null"), "sim")


@query
def user_cf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.user_predictions(*_rated(spark, sf_dir)))


@query
def user_cf_predictions_top_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.user_predictions(*_rated(spark, sf_dir, True), half=True))


@query
def user_cf_predictions_nonneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.user_predictions(*_rated(spark, sf_dir), positive=True))


def _item_pairs(train: DataFrame) -> DataFrame:
    return similarity.similar_items(train.select(F.col("i").alias("item"), F.col("u").alias("member")), 8, 1, 0.65)


@query
def item_cf_lsh_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rated(spark, sf_dir, True)
    return _rounded(recommend.item_predictions(train, test, _item_pairs(train)))


@query
def item_cf_lsh_predictions_top_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rated(spark, sf_dir, True)
    return _rounded(recommend.item_predictions(train, test, _item_pairs(train), half=True))


@query
def item_cf_rated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.rated_item_predictions(*_rated(spark, sf_dir, True)))


@query
def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.baseline_predictions(*_rated(spark, sf_dir)))


@query
def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.part_words(spark, sf_dir).select("i", F.array_join("words", " ").alias("words"))


@query
def content_nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.content_predictions(*_rated(spark, sf_dir), d.part_words(spark, sf_dir)))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    train, test = _rated(spark, sf_dir)
    parts = {
        "content": recommend.content_predictions(train, test, d.part_words(spark, sf_dir)),
        "user": recommend.user_predictions(train, test, positive=True),
        "baseline": recommend.baseline_predictions(train, test),
    }
    return {k: saved(v, k) for k, v in parts.items()}, test


@query
def hybrid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _ = _parts(spark, sf_dir)
    train, test = _rated(spark, sf_dir)
    return recommend.blended(parts | {"als": recommend.als_predictions(train, test, penalty=0.3)})


@query
def hybrid_without_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recommend.blended(_parts(spark, sf_dir)[0]))


@query
def rmse_user_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rated(spark, sf_dir)
    return _rounded(recommend.error_summary(recommend.user_predictions(train, test), test), "rmse")


@query
def error_histogram_user_cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rated(spark, sf_dir)
    return recommend.error_histogram(_rounded(recommend.user_predictions(train, test)), test)


# -- graphs --------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(d.supplier_edges(spark, sf_dir), "supplier-edges")


@query
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.edge_betweenness(_edges(spark, sf_dir)), "betweenness")


@query
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


@query
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_edges(spark, sf_dir))


@query
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, sf_dir))


@query
def modularity_of_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return _rounded(graph.modularity(edges, graph.label_propagation(edges), "label"), "q")


@query
def girvan_newman_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.girvan_newman(_edges(spark, sf_dir))
    return sinks.community_lines(graph.communities(found, "community"))


# -- streams -------------------------------------------------------------------------------------


@query
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sketches.bloom_rates(sketches.first_arrivals(d.arrivals(spark, sf_dir))), "fpr")


def _keys(rows: DataFrame) -> DataFrame:
    return sketches.window_keys(rows, "3 days", "1 day")


def _windows(keys: DataFrame) -> DataFrame:
    out = sketches.window_estimates(keys)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "truth", "estimate")


@query
def fm_window_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(_keys(d.keyed_events(spark, sf_dir)))


@query
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fixed_sample(d.tagged_events(spark, sf_dir))


@query
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.top_tags(reservoir_sample(spark, sf_dir))


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def _finished(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All of a bounded stream, worked off batch by batch into files: of a complete stream the last batch's rows.

    State and results lie in the cluster's shared folder, so a lost driver could take the stream up again.
    """
    spark = stream.sparkSession
    base, written = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number:09d}")
        written.append(f"{base}/out/{number:09d}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    paths = written[-1:] if mode == "complete" else written
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


@query
def stream_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, "part").select(
        F.col("p_name").alias("state"), F.col("p_partkey").alias("ord"), F.floor(F.col("p_partkey") / 200).alias("batch")
    )
    return _rounded(sketches.bloom_rates(_finished(sketches.first_arrivals(rows), "bloom", "complete")), "fpr")


@query
def stream_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("key"))
    return _windows(_finished(_keys(rows.withWatermark("ts", "3 days")), "distinct", "complete"))


@query
def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("tag"))
    held = _finished(sketches.stream_sample(rows), "sample", "update").select("rank", "id", "tag").distinct()
    return held.orderBy("rank", "id").limit(sketches.SAMPLE).select("id", "tag")


@query
def stream_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that rise and fall with the sample, after the stream's last batch."""
    tag = F.get_json_object("props", "$.k")
    rows = _streamed(spark, sf_dir, "events").where(tag.isNotNull()).select(F.col("event_id").alias("id"), F.array(tag).alias("tags"))
    state = f"{shared_dir(spark)}/tags-{uuid.uuid4().hex}"
    run = programs.sampled_tags(rows, f"{state}/out", state, availableNow=True)
    run.awaitTermination()
    return programs.Carried(spark, f"{state}/counts", "tag string, n long").before(run.lastProgress["batchId"] + 1 if run.lastProgress else 0)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)

