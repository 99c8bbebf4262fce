"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="milldam-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of the driver's heap from which it is collected after a written table.
HEAP = 400 << 20


class Scratch:
    """Named Parquet tables below the shared folder; ``save`` cuts the lineage, ``drop`` frees the disk."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.parquet(path)
        if self.spark._jvm.java.lang.Runtime.getRuntime().totalMemory() > HEAP:
            self.spark._jvm.System.gc()  # a driver's heap that has grown over many plans gives memory back
        out = self.spark.read.schema(df.schema).parquet(path)
        out.milldam_path = path
        self.paths.add(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a saved table that nothing will read again."""
        self._remove(df.milldam_path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all saved tables but these."""
        for path in self.paths - {t.milldam_path for t in tables}:
            self._remove(path)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths.discard(name)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

__all__ = ["Scratch", "parallelism", "shared_dir"]
