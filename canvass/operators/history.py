"""Queries over the histories: newest first, latest, counts, high probabilities.

Ties in ``created_at`` are broken by a second key, so results do not depend on file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.spec import HISTORY_LIMIT


def newest(df: DataFrame, limit: int = HISTORY_LIMIT, tie: str = "id", at: str = "created_at") -> DataFrame:
    """Newest rows: a top-k per task and one merge, no full sort."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit)


def latest_per(df: DataFrame, by: str, tie: str = "id", at: str = "created_at") -> DataFrame:
    """Newest row of each group, as a plain (partial) aggregate."""
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(at, tie))
    return df.groupBy(F.col(by).alias("_by")).agg(row.alias("r")).select("r.*")


def last_predictions(df: DataFrame, limit: int = 10, tie: str = "id") -> DataFrame:
    wanted = df.select(tie, "prediction", "probability_text", "class_name", "created_at")
    return newest(wanted, limit, tie)


def predictions_by_class(df: DataFrame) -> DataFrame:
    return df.groupBy("class_name").agg(F.count("*").alias("n"))


def high_probability(df: DataFrame, above: float = 0.8, tie: str = "id") -> DataFrame:
    """Rows whose stored probability text is above a limit, newest first."""
    return df.where(F.col("probability_text").try_cast("double") > above).orderBy(
        F.col("created_at").desc(), F.col(tie).desc()
    )
