"""Sessions and tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; cluster settings stay what the cluster says."""
    builder = SparkSession.builder.appName("milldam")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset (tests) a local folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="milldam-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the cluster's shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets go of shuffle files that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
