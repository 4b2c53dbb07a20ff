"""Evaluation of binary classifiers: matrix, scalar metrics, report, AUC, curves, bundle.

Input has one row per scored record.  Every operator takes optional ``by`` columns, so
one job evaluates many segments, runs or candidates.  Rows are pre-aggregated to
(segment, score) before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.ordered import null_safe_join, running_totals
from canvass.spec import DEFAULT_MODEL_NAME, METRICS_STRUCT


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """tn, fp, fn, tp per segment: always the full 2x2, also when one class is absent.

    Rows without a label are left out and counted in ``unlabelled``.
    """
    y, hat = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (hat == 0)).alias("tn"),
        F.count_if((y == 0) & (hat == 1)).alias("fp"),
        F.count_if((y == 1) & (hat == 0)).alias("fn"),
        F.count_if((y == 1) & (hat == 1)).alias("tp"),
        F.count_if(y.isNull()).alias("unlabelled"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def scalar_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 from the matrix columns; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.select(
        "*",
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def _class_entries() -> tuple[list[Column], Column]:
    """Report entries ("0", "1", "macro avg", "weighted avg") and the accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def entry(right: Column, claimed_wrong: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": _ratio(right, right + claimed_wrong),
            "recall": _ratio(right, right + missed),
            "f1": _ratio(2 * right, 2 * right + claimed_wrong + missed),
            "support": right + missed,
        }

    zero, one = entry(tn, fn, fp), entry(tp, fp, fn)
    measures = ("precision", "recall", "f1")
    macro = {m: (zero[m] + one[m]) / 2 for m in measures}
    weighted = {
        m: _ratio(zero[m] * zero["support"] + one[m] * one["support"], total) for m in measures
    }
    rows = [("0", zero), ("1", one)]
    rows += [("macro avg", {**macro, "support": total}), ("weighted avg", {**weighted, "support": total})]
    structs = [
        F.struct(
            F.lit(name).alias("class"),
            *[row[m].alias(m) for m in measures],
            row["support"].cast("bigint").alias("support"),
        )
        for name, row in rows
    ]
    return structs, _ratio(tp + tn, total)


def classification_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class and averaged precision, recall, F1, support, from the matrix columns."""
    structs, accuracy = _class_entries()
    return matrix.select(*by, F.inline(F.array(*structs)), accuracy.alias("accuracy"))


def score_totals(
    df: DataFrame,
    label: str = "label",
    score: str = "p",
    by: Sequence[str] = (),
    few_scores: bool = False,
) -> DataFrame:
    """One row per segment and distinct score with the running counts from the top.

    Rows without a label, and those whose score is null or NaN, are left out.

    Columns: ``threshold``, ``pos``/``neg`` at the score, ``*_before`` above it,
    ``*_total`` of the segment, ``points`` distinct scores (``points_before`` numbers them).
    """
    counts = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*by, F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
        .withColumn("points", F.lit(1).cast("bigint"))
    )
    return running_totals(
        counts, list(by), "threshold", ["pos", "neg", "points"], descending=True, few_values=few_scores
    )


def auc_from_totals(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC, ties by trapezoid; 0.0 when a segment has one class only."""
    area = F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return totals.groupBy(*by).agg(
        F.coalesce(F.try_divide(area, pairs), F.lit(0.0)).alias("auc_roc"),
        F.coalesce(F.max("pos_total"), F.lit(0)).alias("positives"),
        F.coalesce(F.max("neg_total"), F.lit(0)).alias("negatives"),
    )


def roc_auc(df: DataFrame, label="label", score="p", by: Sequence[str] = (), few_scores=False) -> DataFrame:
    return auc_from_totals(score_totals(df, label, score, by, few_scores), by)


def _both_classes(totals: DataFrame) -> DataFrame:
    return totals.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))


def roc_from_totals(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points from (0, 0); interior points of a straight run are dropped.

    A point is on a straight run when the next score adds the same counts.  ``threshold``
    is null at the start point; segments with one class have no curve.
    """
    first = F.col("points_before") == 0
    last = F.col("next").isNull()
    bends = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
    point = F.struct(
        F.col("threshold").alias("threshold"),
        ((F.col("neg_before") + F.col("neg")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.col("pos_total")).alias("tpr"),
    )
    start = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return (
        _both_classes(totals)
        .where(first | last | bends)
        .select(*by, F.explode(F.when(first, F.array(start, point)).otherwise(F.array(point))).alias("point"))
        .select(*by, "point.*")
    )


def pr_from_totals(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall points of every distinct score, and the end point (1, 0).

    ``threshold`` ascends along the curve and is null at the end point.
    """
    hits = F.col("pos_before") + F.col("pos")
    flagged = hits + F.col("neg_before") + F.col("neg")
    first = F.col("points_before") == 0
    point = F.struct(
        F.col("threshold").alias("threshold"),
        (hits / flagged).alias("precision"),
        (hits / F.col("pos_total")).alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return (
        _both_classes(totals)
        .select(*by, F.explode(F.when(first, F.array(point, end)).otherwise(F.array(point))).alias("point"))
        .select(*by, "point.*")
    )


def roc_points(df: DataFrame, label="label", score="p", by: Sequence[str] = (), few_scores=False) -> DataFrame:
    return roc_from_totals(score_totals(df, label, score, by, few_scores), by)


def pr_points(df: DataFrame, label="label", score="p", by: Sequence[str] = (), few_scores=False) -> DataFrame:
    return pr_from_totals(score_totals(df, label, score, by, few_scores), by)


def _curve_arrays(points: DataFrame, by: Sequence[str], name: str, x: str, y: str, ascending: bool) -> DataFrame:
    """Points of a segment as two arrays, in curve order."""
    rank = F.col("threshold") if ascending else -F.col("threshold")
    # A missing threshold is the start of a ROC curve and the end of a PR curve.
    edge = F.lit(float("inf") if ascending else float("-inf"))
    packed = F.array_sort(F.collect_list(F.struct(F.coalesce(rank, edge).alias("r"), x, y)))
    return points.groupBy(*by).agg(packed.alias("_pts")).select(
        *by, F.struct(F.col(f"_pts.{x}").alias(x), F.col(f"_pts.{y}").alias(y)).alias(name)
    )


def metrics_bundle(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str | None = "p",
    by: Sequence[str] = (),
    model_name: str = DEFAULT_MODEL_NAME,
    timestamp: Column | str | None = None,
    few_scores: bool = False,
    curves: str = "rows",
) -> DataFrame:
    """One row per segment with the nested ``metrics`` document.

    ``curves="arrays"`` embeds the curves, all points of them, and is meant for scores that
    take few values.  With ``"rows"`` the arrays are null whatever the data, and
    :func:`curve_rows` gives all points as rows.  ``curve_points`` counts distinct scores.
    """
    if curves not in ("arrays", "rows"):
        raise ValueError("curves is 'arrays' or 'rows'")
    by = list(by)
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(1))
    matrix = confusion(source, label, prediction, keys)
    if not by:
        # Keep the row of a table without records, as a global aggregate does.
        matrix = confusion(df, label, prediction).select(F.lit(1).alias("_all"), "*")
    bundle = scalar_metrics(matrix)
    if score is None:
        bundle = bundle.select(
            "*", F.lit(0.0).alias("auc_roc"), F.lit(0).cast("bigint").alias("curve_points"),
            F.lit(None).cast(METRICS_STRUCT["roc_curve"].dataType).alias("roc_curve"),
            F.lit(None).cast(METRICS_STRUCT["precision_recall_curve"].dataType).alias("precision_recall_curve"),
        )
    else:
        totals = score_totals(source, label, score, keys, few_scores)
        auc = auc_from_totals(totals, keys)
        length = totals.groupBy(*keys).agg(F.max("points_total").alias("curve_points"))
        parts = [auc.select(*keys, "auc_roc"), length]
        if curves == "arrays":
            parts.append(_curve_arrays(roc_from_totals(totals, keys), keys, "roc_curve", "fpr", "tpr", ascending=False))
            parts.append(_curve_arrays(
                pr_from_totals(totals, keys), keys, "precision_recall_curve", "precision", "recall", ascending=True
            ))
        for part in parts:
            bundle = null_safe_join(bundle, part, keys, how="left")
        if curves == "rows":
            bundle = bundle.withColumns({
                c: F.lit(None).cast(METRICS_STRUCT[c].dataType) for c in ("roc_curve", "precision_recall_curve")
            })
        bundle = bundle.fillna({"auc_roc": 0.0, "curve_points": 0})
    structs, accuracy = _class_entries()
    report = F.map_from_entries(
        F.array(*[
            F.struct(s["class"].alias("key"), F.struct(
                s["precision"].alias("precision"), s["recall"].alias("recall"),
                s["f1"].alias("f1"), s["support"].alias("support"),
            ).alias("value"))
            for s in structs
        ])
    )
    if timestamp is None:
        stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    else:
        stamp = F.lit(timestamp) if isinstance(timestamp, str) else timestamp
    cells = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return bundle.select(
        *by,
        F.struct(
            F.lit(model_name).alias("model"),
            "accuracy", "precision", "recall", "f1_score", "auc_roc",
            cells.alias("confusion_matrix"),
            report.alias("classification_report"),
            accuracy.alias("report_accuracy"),
            stamp.alias("timestamp"),
            "roc_curve",
            "precision_recall_curve",
        ).alias("metrics"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"),
        "unlabelled",
        "curve_points",
    )


def curve_rows(
    df: DataFrame, label: str = "label", score: str = "p", by: Sequence[str] = (), few_scores: bool = False
) -> DataFrame:
    """All points of both curves: ``by``, ``curve`` (roc, pr), ``threshold``, ``x``, ``y``.

    A point's place in its curve is that of its threshold, falling for roc and rising for pr; the
    null threshold starts the one and ends the other.
    """
    totals = score_totals(df, label, score, by, few_scores)
    roc, pr = roc_from_totals(totals, by), pr_from_totals(totals, by)
    return roc.select(*by, F.lit("roc").alias("curve"), "threshold", F.col("fpr").alias("x"), F.col("tpr").alias("y")).unionByName(
        pr.select(*by, F.lit("pr").alias("curve"), "threshold", F.col("recall").alias("x"), F.col("precision").alias("y"))
    )


def class_distribution(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))
