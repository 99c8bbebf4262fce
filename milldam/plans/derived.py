"""Inputs of the mining operators over the star-schema tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, word_set
from ..session import table

#: Edges are supplier pairs whose common orders exceed the mean by so many standard deviations.
EDGE_DEVIATIONS = 2.0


def users(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = customers.join(per, customers["c_custkey"] == per["o_custkey"], "left")
    since = F.date_format("first", "yyyy-MM-dd").alias("since")
    return joined.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("name"), F.coalesce("n", F.lit(0)).alias("review_count"), since)


USERS = """users as (
  select c_custkey as user_id, c_mktsegment as name, count(o_orderkey) as review_count, strftime(min(o_orderdate), '%Y-%m-%d') as since
  from customer left join orders on o_custkey = c_custkey group by 1, 2)"""


def businesses(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("state"))


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("business_id"), F.col("l_quantity").alias("stars"))


def order_brands(spark: SparkSession, d: str) -> DataFrame:
    """(o, b): brands of an order's parts, once each."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(F.col("l_orderkey").alias("o"), F.col("p_brand").alias("b")).distinct()


ORDER_BRANDS = "order_brands as (select distinct l_orderkey as o, p_brand as b from lineitem join part on l_partkey = p_partkey)"


def retail(spark: SparkSession, d: str) -> DataFrame:
    """(key, item): the parts that a customer ordered on a day."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    key = F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey").cast("string"))
    return joined.select(key.alias("key"), F.col("l_partkey").alias("item")).distinct()


RETAIL = """retail as (select distinct strftime(o_orderdate, '%Y-%m-%d') || '-' || o_custkey as key, l_partkey as item
  from lineitem join orders on l_orderkey = o_orderkey)"""


def ratings(spark: SparkSession, d: str, brands: bool = False) -> DataFrame:
    """(u, i, r): a customer's mean quantity of a part (or brand number), in tens, rounded up."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    item = F.col("l_partkey")
    if brands:
        parts = table(spark, d, "part")
        joined = joined.join(parts, joined["l_partkey"] == parts["p_partkey"])
        item = F.substring("p_brand", 7, 10).cast("long")
    grouped = joined.groupBy(F.col("o_custkey").alias("u"), item.alias("i"))
    return grouped.agg(F.ceil(F.avg("l_quantity") / 10).cast("int").alias("r"))


RATINGS = """ratings as (select o_custkey as u, l_partkey as i, cast(ceil(avg(l_quantity) / 10) as int) as r
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""
BRAND_RATINGS = """ratings as (select o_custkey as u, cast(substr(p_brand, 7) as bigint) as i, cast(ceil(avg(l_quantity) / 10) as int) as r
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)"""
SPLIT = """train as (select * from ratings where (u * 31 + i * 17) % 10 <> 0),
test as (select * from ratings where (u * 31 + i * 17) % 10 = 0)"""


def split(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: a tenth of the pairs is held out."""
    held = (F.col("u") * 31 + F.col("i") * 17) % 10 == 0
    return rated.where(~held), rated.where(held)


def part_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), tokens(text).alias("words"))


PART_WORDS = r"""part_words as (select p_partkey as i,
  regexp_extract_all(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^\w\s]', '', 'g'), '(\w\w+)', 1) as words from part)"""


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """(item, word): distinct lower-cased words of whole documents."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.explode(word_set(F.col("text"))).alias("word"))


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): suppliers that share unusually many orders."""
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    a, b = pairs.withColumnRenamed("s", "src"), pairs.withColumnRenamed("s", "dst")
    counts = a.join(b, "o").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    level = counts.agg((F.avg("n") + EDGE_DEVIATIONS * F.stddev_pop("n")).alias("least"))
    return counts.join(F.broadcast(level), F.col("n") > F.col("least")).select("src", "dst")


EDGES = f"""lines as (select distinct l_orderkey as o, l_suppkey as s from lineitem),
pair_counts as (select a.s as src, b.s as dst, count(*) as n from lines a join lines b on a.o = b.o and a.s < b.s group by 1, 2),
edges as (select src, dst from pair_counts where n > (select avg(n) + {EDGE_DEVIATIONS} * stddev_pop(n) from pair_counts)),
two as (select src, dst from edges union select dst, src from edges)"""


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """(state, ord, batch): part names in key order, two hundred keys to a batch."""
    return table(spark, d, "part").select(F.col("p_name").alias("state"), F.col("p_partkey").alias("ord"), F.floor(F.col("p_partkey") / 200).alias("batch"))


def keyed_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("key"))


def tagged_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("tag"))
