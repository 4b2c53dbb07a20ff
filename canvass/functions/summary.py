"""Quantile summaries of fixed size with a proven rank error.

A summary is a table of buckets: ranges of values that do not overlap, each with its count, least and greatest
value.  It starts with coarse ranges; a bucket of more than ``error * n`` rows is cut finer by the next bits of
its values, until it is small enough or holds one value only.  So

* ranks are known within a bucket's count, ``error * n`` at most, wherever a bucket is not a single value;
* there are fewer than ``1 / error`` buckets to cut in a round, 256 parts each, and eight rounds at most: the size
  does not depend on the rows;
* counts, minima and maxima give the same summary in any order of merging, and ``merged`` adds summaries of parts.

A round is one scan with partial aggregation; no values are shuffled one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.ordered import long_values, order_digits
from canvass.session import materialize

_KEY = ("a", "b", "c")
#: Bits of each digit that a round leaves out.
_ROUNDS = ((8, None, None), (0, None, None), (0, 15, None), (0, 7, None), (0, 0, None), (0, 0, 15), (0, 0, 7), (0, 0, 0))


def _key(shifts: tuple) -> list[Column]:
    """Bucket of a row with digits ``d0`` to ``d2``."""
    return [
        (F.lit(0).cast("bigint") if s is None else F.floor(F.col(f"d{i}") / (1 << s))).alias(n) for i, (n, s) in enumerate(zip(_KEY, shifts))
    ]


def quantile_summary(df: DataFrame, columns: Sequence[str], error: float = 0.001) -> DataFrame:
    """(feature, n, low, high): buckets of all values; nulls and NaN are left out."""
    if not 0 < error < 1:
        raise ValueError("error is a share of the rows, between 0 and 1")
    values = long_values(df, columns)
    digits = values.select("feature", "value", *[d.alias(f"d{i}") for i, d in enumerate(order_digits(F.col("value")))])
    whole = None
    out, rows = None, digits
    for step, shifts in enumerate(_ROUNDS):
        counted = rows.groupBy("feature", *_key(shifts)).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        counted = materialize(counted, "summary")
        if whole is None:
            whole = counted.groupBy("feature").agg(F.sum("n").alias("total"))
        # One row per feature.
        judged = counted.join(F.broadcast(whole), "feature").withColumn("cut", (F.col("n") > error * F.col("total")) & (F.col("low") < F.col("high")))
        done = judged.where("NOT cut").select("feature", "n", "low", "high")
        out = done if out is None else out.unionByName(done)
        heavy = judged.where("cut").select("feature", *[F.col(k).alias(f"_{k}") for k in _KEY])
        if step == len(_ROUNDS) - 1 or heavy.isEmpty():
            break
        # Fewer than 1 / error rows per feature.
        mine = digits.select("*", *[k.alias(f"my_{n}") for k, n in zip(_key(shifts), _KEY)])
        same = (mine["feature"] == heavy["feature"]) & (F.col("my_a") == F.col("_a")) & (F.col("my_b") == F.col("_b")) & (F.col("my_c") == F.col("_c"))
        rows = mine.join(F.broadcast(heavy), same, "left_semi").select(digits.columns)
    return out


def merged(summaries: Sequence[DataFrame]) -> DataFrame:
    """The summary of all parts together.  Buckets of different parts may overlap; the errors of the parts add up, as their rows do."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("feature", "low", "high").agg(F.sum("n").alias("n")).select("feature", "n", "low", "high")


def summary_quantiles(summary: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, n, share, quantile, rank_error): a value of the data near the rank (n - 1) * share.

    At most ``most_less`` values are less than an end of a bucket, at least ``least_upto`` are not greater; so the nearest
    occurrence of that end is at most ``rank_error`` ranks away.  The end with the least error is taken.  Between
    two neighbouring ends lie only buckets that hold both of them, one per merged part: the error is
    ``error * n`` at most, and one rank where buckets are single values.
    """
    ends = summary.select("feature", F.col("low").alias("value"), F.col("n").alias("opened"), F.lit(0).cast("bigint").alias("closed")).unionByName(
        summary.select("feature", F.col("high").alias("value"), F.lit(0).cast("bigint").alias("opened"), F.col("n").alias("closed")))
    ends = ends.groupBy("feature", "value").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    order = Window.partitionBy("feature").orderBy("value")  # as many rows as a summary has for a feature
    placed = ends.select(
        "feature", "value", F.coalesce(F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("most_less"),
        F.sum("closed").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("least_upto"), F.sum("opened").over(Window.partitionBy("feature")).alias("n"))
    each = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = (F.col("n") - 1) * F.col("share")
    error = F.greatest(F.col("most_less") - rank, rank - (F.col("least_upto") - 1), F.lit(0.0))
    best = F.min_by(F.struct(F.col("value").alias("quantile"), error.alias("rank_error"), "n"), F.struct(error, "value"))
    return each.groupBy("feature", "share").agg(best.alias("best")).select("feature", "best.n", "share", "best.quantile", "best.rank_error")
