"""Rows for tree growth: one array of doubles per row, and what its values mean.

A numeric column is there as it is; a choice column holds the number of the chosen category, 0 for
none.  Every value of a numeric column is a possible split, "value or less goes left"; how many
there are does not matter, as nothing but the columns' names reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.ordered import running_totals
from canvass.session import materialize, small_table


@dataclass(frozen=True)
class Layout:
    """Columns of the array: numeric ones, then choices.

    ``following``: table (column, value, following) of all values of numeric columns with the next greater one,
    null after the greatest.  ``features``: table (column, value, feature) naming the categories.
    """

    numeric: tuple[str, ...]
    choices: tuple[str, ...]
    following: DataFrame
    features: DataFrame

    def is_choice(self, column: Column) -> Column:
        return column >= len(self.numeric)

    def named(self, splits: DataFrame) -> DataFrame:
        """``splits`` (column, value, ...) with ``feature`` and ``threshold`` in place of both.

        The threshold is the middle between the value and the next one; where that is no number between
        them (neighbouring or endless values), the value itself.  After the greatest value it is infinite, which
        parts the missing values from all others.
        """
        middle = (F.col("value") + F.col("_after")) / 2
        between = (middle >= F.col("value")) & (middle < F.col("_after"))
        threshold = (
            F.when(self.is_choice(F.col("column")), F.lit(0.5)).when(F.col("_after").isNull(), F.lit(float("inf")))
            .otherwise(F.when(between, middle).otherwise(F.col("value")))
        )
        numeric = F.try_element_at(F.array(*[F.lit(n) for n in self.numeric]).cast("array<string>"), F.col("column") + 1)
        after = self.following.select("column", "value", F.col("following").alias("_after"))
        names = self.features.select("column", "value", F.col("feature").alias("_name"))
        # Few splits against large tables: equi-joins on both columns.
        joined = splits.join(after, ["column", "value"], "left").join(names, ["column", "value"], "left")
        return joined.withColumns({"feature": F.coalesce("_name", numeric), "threshold": threshold}).drop("_after", "_name", "column", "value")


def value_array(numeric: Sequence[Column], choices: Sequence[Column]) -> Column:
    """The array of a row.  Missing numbers (null or NaN) become NaN, which goes right everywhere."""
    numbers = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in numeric]
    return F.array(*numbers, *[F.coalesce(c.cast("double"), F.lit(0.0)) for c in choices]).cast("array<double>").alias("x")


def following_values(values: DataFrame) -> DataFrame:
    """(column, value, following): all distinct values of (column, value) with the next greater one of the column."""
    known = values.where("value IS NOT NULL AND NOT isnan(value)").distinct().withColumn("own", F.col("value"))
    return running_totals(known, ["column"], "value", ["own"]).select("column", "value", F.col("next.own").alias("following"))


def array_layout(rows: DataFrame, numeric: Sequence[str], choices: Sequence[str], features: DataFrame) -> Layout:
    """Layout of rows with ``x``; ``features`` names the categories."""
    values = rows.select(F.posexplode(F.slice("x", 1, len(numeric))).alias("column", "value")) if numeric else rows.limit(0).selectExpr("0 AS column", "0D AS value")
    return Layout(tuple(numeric), tuple(choices), materialize(following_values(values), "following"), features)


def make_layout(df: DataFrame, numeric: Sequence[str], indicators: Sequence[str]) -> Layout:
    """Layout of a table with one column per indicator."""
    names = [(len(numeric) + i, 1.0, name) for i, name in enumerate(indicators)]
    features = small_table(df.sparkSession, names, "column int, value double, feature string")
    return array_layout(df.select(value_array([F.col(f"`{n}`") for n in numeric], [])), numeric, indicators, features)


def array_rows(df: DataFrame, layout: Layout, keep: Sequence[Column]) -> DataFrame:
    """``keep`` columns and ``x``, of a table as for :func:`make_layout`."""
    flags = [F.when(F.col(f"`{n}`") > 0.5, 1.0) for n in layout.choices]
    return df.select(*keep, value_array([F.col(f"`{n}`") for n in layout.numeric], flags))
