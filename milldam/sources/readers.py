"""Typed readers of the engine's input formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER = "user_id string, name string, review_count bigint, since string"
BUSINESS = "business_id string, state string"
BUSINESS_CONTENT = "business_id string, categories string, attributes map<string,string>"
REVIEW = "business_id string, stars double"
RATING = "user_id string, business_id string, stars double"
BASKET = "user_id string, business_id string"
EDGE = "src string, dst string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; only the schema's fields are parsed, absent ones are null."""
    return spark.read.schema(schema).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited rows, quoted fields included; columns by position, a first line of names skipped."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", True).csv(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows(spark, path, RATING)


def retail_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(key, item) of a sales file: date and customer form the key, the sixth column is the product."""
    raw = csv_rows(spark, path, "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")
    return raw.select(F.concat_ws("-", "c0", "c1").alias("key"), F.expr("try_cast(trim(c5) as bigint)").alias("item")).where("item is not null")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated node pairs without a header."""
    return csv_rows(spark, path, EDGE, header=False, sep=" ")


def rows(spark: SparkSession, data: Iterable[tuple], schema: str) -> DataFrame:
    """A small table from memory."""
    return spark.createDataFrame(list(data), schema)


def socket_json(spark: SparkSession, host: str, port: int, schema: str) -> DataFrame:
    """A stream of JSON lines from a socket with their arrival time as ``ts``."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return lines.select(F.from_json("value", schema).alias("r"), F.col("timestamp").alias("ts")).select("r.*", "ts")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tag_stream(stream: DataFrame, column: str = "hashtags") -> DataFrame:
    """Posts of a stream that carry at least one tag."""
    return stream.where(F.size(column) > 0)
