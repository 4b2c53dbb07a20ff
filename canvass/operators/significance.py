"""Is the accuracy better than chance?  Exact one-sided binomial test per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.binomial import binomial_p_value

ALPHA = 0.05


def correct_count(df: DataFrame, label="label", prediction="prediction", by: Sequence[str] = ()) -> DataFrame:
    labelled = df.where(F.col(label).isNotNull())
    return labelled.groupBy(*by).agg(
        F.count_if(F.col(label) == F.col(prediction)).alias("correct"), F.count("*").alias("n")
    )


def with_decision(counts: DataFrame, p0: float = 0.5, alpha: float = ALPHA) -> DataFrame:
    """Adds accuracy, ``p_value``, ``reject_h0`` and the decision text to (correct, n) rows."""
    tested = counts.withColumn("p_value", binomial_p_value(F.col("correct"), F.col("n"), p0))
    reject = F.col("p_value") < alpha
    return tested.select(
        *counts.columns,
        F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0)).alias("accuracy"),
        "p_value",
        reject.alias("reject_h0"),
        F.when(reject, "reject H0").otherwise("do not reject H0").alias("decision"),
    )


def binomial_test(
    df: DataFrame, label="label", prediction="prediction", by: Sequence[str] = (),
    p0: float = 0.5, alpha: float = ALPHA,
) -> DataFrame:
    """H0: accuracy <= p0 against H1: accuracy > p0.

    Spark counts per segment; only those grouped rows reach the tail probability.
    """
    return with_decision(correct_count(df, label, prediction, by), p0, alpha)
