"""Table profiles: shape, column information, first rows, descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.ordered import exact_quantiles, long_values


def table_shape(df: DataFrame) -> DataFrame:
    """Row count, column count and the column list, in one row."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def column_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of every column, from one aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column"),
                F.lit(kind).alias("type"), F.col(f"`{name}`").alias("non_null"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]))
    )


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First rows by key: files have no row order on Spark."""
    return df.orderBy(key).limit(n)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max per numeric column.

    Moments and exact quartiles both start from pre-aggregated values; a column without
    values keeps its row, with count 0.
    """
    moments = long_values(df, columns).groupBy("feature").agg(
        F.count("*").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("feature").agg(
        *[
            F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(name)
            for s, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
        ]
    )
    spark = df.sparkSession
    features = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature"))
    joined = features.join(moments, "feature", "left").join(quartiles, "feature", "left")
    return joined.select(
        "feature", F.coalesce("count", F.lit(0)).alias("count"),
        "mean", "std", "min", "p25", "p50", "p75", "max",
    )
