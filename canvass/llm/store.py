"""Intermediate tables of one operator run in the shared folder, dropped when no longer needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import scratch_path


class Store:
    """Written tables cut the lineage and survive lost executors; their size is known to the planner."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{label}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._store_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._store_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free checksum of a table of longs."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.sum(F.xxhash64(*df.columns).bitwiseAND(0xFFFFFFFF))).first())
