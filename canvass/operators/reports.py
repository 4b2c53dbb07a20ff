"""Dashboard datasets: the table behind each card and chart.

Input is a metrics history (``created_at``, ``metrics``) or one of its rows; all of them
work on at most the newest 100 rows, or on the newest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.text import fixed4, percent2, timestamp_text, title_label
from canvass.operators.history import newest
from canvass.operators.significance import ALPHA, with_decision
from canvass.spec import HISTORY_LIMIT, METRIC_FIELDS


def _fields(df: DataFrame, *keep: str) -> DataFrame:
    values = [F.coalesce(F.col(f"metrics.{m}"), F.lit(0.0)).alias(m) for m in METRIC_FIELDS]
    return df.select(*keep, *values)


def metric_cards(history: DataFrame, tie: str = "id") -> DataFrame:
    """Five current values of the newest run; missing ones are 0."""
    return _fields(newest(history, 1, tie), "created_at")


def metric_series(history: DataFrame, limit: int = HISTORY_LIMIT, tie: str = "id") -> DataFrame:
    """(created_at, metric, value) of the newest runs, with readable metric labels."""
    wide = _fields(newest(history, limit, tie), "created_at")
    long = wide.unpivot(["created_at"], list(METRIC_FIELDS), "metric", "value")
    return long.select("created_at", title_label(F.col("metric")).alias("metric"), "value")


def confusion_cells(history: DataFrame, tie: str = "id") -> DataFrame:
    """Four labelled cells of the newest run; a missing matrix is all zeros."""
    zero = F.array(*[F.array(*[F.lit(0).cast("bigint")] * 2)] * 2)
    latest = newest(history, 1, tie).select(F.coalesce("metrics.confusion_matrix", zero).alias("m"))
    rows = latest.select(F.posexplode("m").alias("a", "r"))
    # The labels are part of the output.
    cells = rows.select("a", F.posexplode("r").alias("b", "n"))
    return cells.select(
        F.when(F.col("a") == 0, "Actual: No").otherwise("Actual: Yes").alias("actual"),
        F.when(F.col("b") == 0, "Predicted: No").otherwise("Predicted: Yes").alias("predicted"),
        "n",
    )


def _points(history: DataFrame, curve: str, x: str, y: str, name: str, tie: str) -> DataFrame:
    latest = newest(history, 1, tie).where(F.col(f"metrics.{curve}").isNotNull())
    zipped = latest.select(
        F.posexplode(F.arrays_zip(F.col(f"metrics.{curve}.{x}").alias("x"), F.col(f"metrics.{curve}.{y}").alias("y")))
        .alias("point_no", "pt")
    )
    return zipped.select(F.lit(name).alias("series"), "point_no", F.col("pt.x").alias("x"), F.col("pt.y").alias("y"))


def roc_long(history: DataFrame, tie: str = "id") -> DataFrame:
    """ROC points of the newest run and the random diagonal (only where there is a curve)."""
    curve = _points(history, "roc_curve", "fpr", "tpr", "ROC Curve", tie)
    corners = F.array(F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("v")), F.struct(F.lit(1).alias("n"), F.lit(1.0).alias("v")))
    diagonal = curve.where(F.col("point_no") == 0).select(F.explode(corners).alias("c")).select(
        F.lit("Random").alias("series"), F.col("c.n").alias("point_no"), F.col("c.v").alias("x"), F.col("c.v").alias("y")
    )
    return curve.unionByName(diagonal)


def pr_long(history: DataFrame, tie: str = "id") -> DataFrame:
    """Precision-recall points of the newest run: x is recall, y is precision."""
    return _points(history, "precision_recall_curve", "recall", "precision", "PR Curve", tie)


def curves_long(history: DataFrame, points: DataFrame, curve: str, tie: str = "id") -> DataFrame:
    """Points of the newest run from a table of curve rows keyed by run id.

    The long form of :func:`roc_long` and :func:`pr_long` for curves of any length; points are
    placed by ``threshold``, and nothing is gathered or numbered in one task.
    """
    own = points.where(F.col("curve") == curve).join(newest(history, 1, tie).select("id"), "id", "left_semi")
    name = {"roc": "ROC Curve", "pr": "PR Curve"}[curve]
    out = own.select(F.lit(name).alias("series"), "threshold", "x", "y")
    if curve == "pr":
        return out
    corners = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("v")
    return out.unionByName(out.where("threshold IS NULL").select(corners).select(
        F.lit("Random").alias("series"), F.lit(None).cast("double").alias("threshold"), F.col("v").alias("x"), F.col("v").alias("y")
    ))


def metrics_table(history: DataFrame, limit: int = HISTORY_LIMIT, tie: str = "id") -> DataFrame:
    """Printable history: time text and five metrics with four decimals."""
    wide = _fields(newest(history, limit, tie), "created_at")
    return wide.select(
        timestamp_text(F.col("created_at")).alias("created"), *[fixed4(F.col(m)).alias(m) for m in METRIC_FIELDS]
    )


def run_significance(history: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """p-value of every stored run, from its confusion matrix."""
    m = F.col("metrics.confusion_matrix")
    counts = history.select(
        "created_at",
        (m[0][0] + m[1][1]).alias("correct"),
        (m[0][0] + m[0][1] + m[1][0] + m[1][1]).alias("n"),
    )
    return with_decision(counts, 0.5, alpha)


def score_text(scored: DataFrame, key: str, prediction: str = "prediction", probability: str = "p") -> DataFrame:
    """Readable score: answer, probability with four decimals, percentage with two.

    Fixed values: the answers are part of the output.
    """
    return scored.select(
        key,
        F.when(F.col(prediction) == 1, "SÍ").otherwise("NO").alias("answer"),
        fixed4(F.col(probability)).alias("probability_text"),
        F.concat(percent2(F.col(probability)), F.lit("%")).alias("percent_text"),
    )
