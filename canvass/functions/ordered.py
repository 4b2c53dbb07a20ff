"""Exact running totals and quantiles over ordered values, without a one-task sort.

A window ordered over a whole table runs in one task.  Here a double is cut into
three digits that keep its order; running totals are taken digit by digit, and the
totals of the coarser digit are added to the finer one through equi-joins.  No window
group holds more than 2**23 rows whatever the data, and no join key repeats more often
than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split of the mantissa: 9 bits go with the exponent into the first digit, then 23 and
# 23 bits.  Together they cover the 55 bits that a scaled mantissa can have.
_TOP, _LOW = 2.0**9, 2.0**23
_DIGITS = ("_d1", "_d2", "_d3")


def order_digits(value: Column) -> list[Column]:
    """Three integers whose lexicographic order is the order of the doubles (NaN apart)."""
    x = value.cast("double")
    endless = F.abs(x) == float("inf")
    # Infinite values get a first digit beyond all others.
    magnitude = F.when(endless, F.lit(1.0)).otherwise(F.abs(x))
    # Rounding in log2 may move a value next to a power of two into the neighbour
    # bucket; it never changes the order, and the mantissa below stays exact.
    exponent = F.least(F.floor(F.log2(magnitude)), F.lit(1023))
    scaled = magnitude / F.pow(F.lit(2.0), exponent) / 4 * _TOP
    top = F.floor(scaled)
    rest = (scaled - top) * _LOW
    middle = F.floor(rest)
    low = F.floor((rest - middle) * _LOW)

    def signed(digit: Column) -> Column:
        return F.when(x == 0, F.lit(0).cast("bigint")).when(x < 0, -digit).otherwise(digit)

    first = F.when(endless, F.lit(1 << 40)).otherwise((exponent + 1080) * int(_TOP) + top)
    return [signed(first), signed(middle), signed(low)]


def running_totals(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    few_values: bool = False,
) -> DataFrame:
    """Totals of ``sums`` before each value within ``by``, and over the whole group.

    ``counts`` has one row per (``by``, ``value``).  Adds ``<s>_before`` (exclusive),
    ``<s>_total`` and ``next``, the struct of ``sums`` at the following value (null at
    the last one).  ``few_values=True`` says that a group is known to hold few distinct
    values (tree leaves, say) and uses one window per group; the result is the same.
    """
    by = list(by)
    here = F.struct(*[F.col(s) for s in sums])
    if few_values:
        order = F.col(value).desc() if descending else F.col(value).asc()
        ordered = Window.partitionBy(*by).orderBy(order)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*by)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
            F.lead(here).over(ordered).alias("next"),
        )

    digits = [(-d if descending else d) for d in order_digits(F.col(value))]
    fine = counts.select("*", *[d.alias(n) for d, n in zip(digits, _DIGITS)])
    levels = []
    for depth in (1, 2):
        keys = by + list(_DIGITS[:depth])
        # The head of a group is its first value: min_by on the digits below.
        head = F.min_by(here, F.struct(*_DIGITS[depth:])).alias("head")
        level = fine.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], head)
        ordered = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        columns = [
            F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before{depth}") for s in sums
        ]
        if depth == 1:
            whole = Window.partitionBy(*by)
            columns += [F.sum(s).over(whole).alias(f"{s}_total") for s in sums]
        columns.append(F.lead("head").over(ordered).alias(f"next{depth}"))
        levels.append(level.select(*keys, *columns))

    coarse = null_safe_join(levels[1], levels[0], by + [_DIGITS[0]])
    ordered = Window.partitionBy(*by, *_DIGITS[:2]).orderBy(_DIGITS[2])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select(
        "*",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before3") for s in sums],
        F.lead(here).over(ordered).alias("next3"),
    )
    joined = null_safe_join(fine, coarse, by + list(_DIGITS[:2]))
    return joined.select(
        *counts.columns,
        *[
            (F.col(f"{s}_before1") + F.col(f"{s}_before2") + F.col(f"{s}_before3")).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
        F.coalesce("next3", "next2", "next1").alias("next"),
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that also matches null keys; keeps the key columns of ``left``.

    Keys that cannot be null, and digits, are compared plainly, so that the join can use
    the partitioning of the windows below it.
    """
    right = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        plain = k in _DIGITS or not left.schema[k].nullable
        mine, other = F.col(k), F.col(f"_r_{k}")
        same = (mine == other) if plain else mine.eqNullSafe(other)
        condition = same if condition is None else condition & same
    return left.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of numeric columns as doubles, nulls left out."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "feature", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: (feature, n, share, quantile).

    Values are counted first (map-side partial aggregation, so a value that fills a
    third of the table is one row per task), then ranked with :func:`running_totals`.
    The table is scanned once: all levels reuse the shuffle of that count.
    """
    counts = long_values(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, ["feature"], "value", ["n"])
    position = (F.col("n_total") - 1) * F.col("share")
    low, high = F.floor(position), F.ceil(position)
    start, end = F.col("n_before"), F.col("n_before") + F.col("n")
    wanted = (
        ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .where(((low >= start) & (low < end)) | ((high >= start) & (high < end)))
        .groupBy("feature", "share")
        .agg(
            F.max("n_total").alias("n"),
            F.min("value").alias("lower"),
            F.max("value").alias("upper"),
        )
    )
    position = (F.col("n") - 1) * F.col("share")
    return wanted.select(
        "feature", "n", "share",
        # Between equal values, endless ones too, there is nothing to interpolate.
        F.when(F.col("lower") == F.col("upper"), F.col("lower"))
        .otherwise(F.col("lower") + (F.col("upper") - F.col("lower")) * (position - F.floor(position))).alias("quantile"),
    )
