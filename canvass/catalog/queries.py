"""Registered queries: every operator over the campaign view of the warehouse tables.

Doubles are rounded, as sums depend on the order of the rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import summary, text
from canvass.functions.ordered import long_values
from canvass.operators import (
    encoding, evaluation, grid, history, profiling, projection, reports, significance, splitting, tree, validation,
)
from canvass.plans import jobs
from canvass.session import materialize, scratch_path, small_table
from canvass.sources import history as store
from canvass.sources import tables
from canvass.spec import CAMPAIGN, METRIC_FIELDS, NODE_TABLE, FeatureSpec
from canvass.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
KEY = CAMPAIGN.key


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r9(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scorecard(tables.contacts(spark, sf_dir))


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with a score that takes about as many values as there are rows."""
    p = (F.col("balance") + 1e3) / 1.1e4 * 0.25 + F.col("duration") / 5e3 * 0.75
    return scored(spark, sf_dir).withColumn("p", p)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics history: one document per week of contacts."""
    rows = scored(spark, sf_dir).withColumn("week", text.week_start(F.col("contact_ts")))
    # Nine possible scores.
    bundle = evaluation.metrics_bundle(
        rows, by=["week"], model_name="scorecard", timestamp=text.timestamp_text(F.col("week")), few_scores=True, curves="arrays"
    )
    return store.metrics_records(bundle, "week")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prediction_records(scored(spark, sf_dir), created_at="contact_ts")


# --- evaluation -----------------------------------------------------------------------


@query
def classification_report(spark, sf_dir):
    report = evaluation.classification_report(evaluation.confusion(scored(spark, sf_dir)))
    return rounded(report, "precision", "recall", "f1", "accuracy")


@query
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(scored(spark, sf_dir))


@query
def scalar_metrics(spark, sf_dir):
    matrix = evaluation.confusion(scored(spark, sf_dir))
    return rounded(evaluation.scalar_metrics(matrix), "accuracy", "precision", "recall", "f1_score").drop("unlabelled")


@query
def scalar_metrics_by_job(spark, sf_dir):
    matrix = evaluation.confusion(scored(spark, sf_dir), by=["job"])
    return rounded(evaluation.scalar_metrics(matrix), "accuracy", "precision", "recall", "f1_score").drop("unlabelled")


@query
def auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(scored(spark, sf_dir), few_scores=True), "auc_roc")


@query
def auc_by_job(spark, sf_dir):
    return rounded(evaluation.roc_auc(scored(spark, sf_dir), by=["job"], few_scores=True), "auc_roc")


@query
def auc_continuous(spark, sf_dir):
    return rounded(evaluation.roc_auc(smooth(spark, sf_dir)), "auc_roc")


@query
def auc_continuous_by_contact(spark, sf_dir):
    return rounded(evaluation.roc_auc(smooth(spark, sf_dir), by=["contact"]), "auc_roc")


@query
def roc_points(spark, sf_dir):
    return rounded(evaluation.roc_points(scored(spark, sf_dir), few_scores=True), "threshold", "fpr", "tpr")


@query
def pr_points(spark, sf_dir):
    return rounded(evaluation.pr_points(scored(spark, sf_dir), few_scores=True), "threshold", "precision", "recall")


@query
def roc_points_continuous(spark, sf_dir):
    return rounded(evaluation.roc_points(smooth(spark, sf_dir)), "threshold", "fpr", "tpr")


@query
def pr_points_continuous(spark, sf_dir):
    return rounded(evaluation.pr_points(smooth(spark, sf_dir)), "threshold", "precision", "recall")


@query
def metrics_bundle(spark, sf_dir):
    bundle = evaluation.metrics_bundle(
        scored(spark, sf_dir), by=["contact"], timestamp="2024-01-01 00:00:00", few_scores=True, curves="arrays"
    )
    m, report = F.col("metrics"), F.col("metrics.classification_report")

    def joined(path: str) -> Column:
        return F.array_join(F.transform(F.col(f"metrics.{path}"), text.fixed4), ",")

    return bundle.select(
        "contact", "n", m["model"].alias("model"), m["timestamp"].alias("timestamp"),
        *[r9(m[f]).alias(f) for f in METRIC_FIELDS],
        m["confusion_matrix"][0][0].alias("tn"), m["confusion_matrix"][0][1].alias("fp"),
        m["confusion_matrix"][1][0].alias("fn"), m["confusion_matrix"][1][1].alias("tp"),
        r9(report["0"]["precision"]).alias("precision_0"), r9(report["macro avg"]["f1"]).alias("macro_f1"),
        r9(report["weighted avg"]["recall"]).alias("weighted_recall"),
        joined("roc_curve.fpr").alias("roc_fpr"), joined("roc_curve.tpr").alias("roc_tpr"),
        joined("precision_recall_curve.precision").alias("pr_precision"),
        joined("precision_recall_curve.recall").alias("pr_recall"),
    )


@query
def metrics_without_scores(spark, sf_dir):
    bundle = evaluation.metrics_bundle(scored(spark, sf_dir), score=None, timestamp="2024-01-01 00:00:00")
    m = F.col("metrics")
    return bundle.select(
        *[r9(m[f]).alias(f) for f in METRIC_FIELDS],
        m["roc_curve"].isNull().alias("no_roc"), m["precision_recall_curve"].isNull().alias("no_pr"),
    )


@query
def correct_count(spark, sf_dir):
    return significance.correct_count(scored(spark, sf_dir))


@query
def binomial_test(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("week", text.timestamp_text(text.week_start(F.col("contact_ts"))))
    return rounded(significance.binomial_test(rows, by=["week"]), "accuracy", "p_value")


# --- profiling ------------------------------------------------------------------------


@query
def table_shape(spark, sf_dir):
    return profiling.table_shape(tables.contacts(spark, sf_dir))


@query
def column_info(spark, sf_dir):
    return profiling.column_info(tables.contacts(spark, sf_dir))


@query
def head5(spark, sf_dir):
    return profiling.head(tables.contacts(spark, sf_dir).drop("contact_ts"), KEY, 5)


@query
def describe(spark, sf_dir):
    stats = profiling.describe(tables.contacts(spark, sf_dir), CAMPAIGN.numeric)
    return rounded(stats, "mean", "std", "min", "p25", "p50", "p75", "max", digits=6)


@query
def class_distribution(spark, sf_dir):
    return evaluation.class_distribution(projection.with_label(tables.contacts(spark, sf_dir)))


# --- validation -----------------------------------------------------------------------


def requests(spark, sf_dir) -> DataFrame:
    """Requests as a table on files, as they arrive.

    Checked straight from the view, every rule would drag the CASE expressions that
    derive its column through the optimizer.
    """
    return materialize(tables.raw_requests(tables.contacts(spark, sf_dir)), "requests")


def checked(spark, sf_dir) -> DataFrame:
    return validation.check(requests(spark, sf_dir))


@query
def validate_accept(spark, sf_dir):
    return validation.accepted(checked(spark, sf_dir))


@query
def validate_quarantine(spark, sf_dir):
    bad = validation.quarantined(checked(spark, sf_dir))
    names = F.transform("violations", lambda v: F.concat(v["rule"], F.lit(":"), v["kind"]))
    return bad.select(KEY, "age", "job", F.array_join(names, ",").alias("violations"))


@query
def validate_violations(spark, sf_dir):
    return validation.violation_counts(checked(spark, sf_dir))


@query
def violation_details(spark, sf_dir):
    return validation.violation_rows(checked(spark, sf_dir), KEY)


@query
def validate_strict(spark, sf_dir):
    rows = requests(spark, sf_dir)
    rows = rows.withColumn("month", F.when(F.col(KEY) % 59 == 0, "smarch").otherwise(F.col("month")))
    return validation.violation_counts(validation.check(rows, strict_domains=True))


@query
def coerce_types(spark, sf_dir):
    return checked(spark, sf_dir).select(
        KEY, F.col("typed.age").alias("age"), r9("typed.balance").alias("balance"),
        F.col("typed.campaign").alias("campaign"),
    )


@query
def output_invariant(spark, sf_dir):
    rows = smooth(spark, sf_dir).withColumn("doubled", F.col("p") * 2)
    return rows.agg(
        F.count_if(validation.probability_valid(F.col("p"))).alias("valid"),
        F.count_if(~validation.probability_valid(F.col("doubled"))).alias("doubled_invalid"),
    )


# --- projections and encoding ---------------------------------------------------------


@query
def split_target(spark, sf_dir):
    return projection.without_target(tables.contacts(spark, sf_dir)).drop("contact_ts")


@query
def label_map(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    rows = rows.withColumn("deposit", F.when(F.col(KEY) % 73 == 0, "maybe").otherwise(F.col("deposit")))
    return projection.with_label(rows).select(KEY, "deposit", "label")


@query
def label_quality(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    rows = rows.withColumn("deposit", F.when(F.col(KEY) % 73 == 0, "maybe").otherwise(F.col("deposit")))
    return projection.label_quality(rows)


@query
def keep_columns(spark, sf_dir):
    return projection.keep_columns(tables.contacts(spark, sf_dir), [KEY, *CAMPAIGN.numeric])


@query
def unknown_handler(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir).select(KEY, "age", "job", "education", "contact", "poutcome")
    return projection.mark_unknown(rows)


@query
def robust_fit(spark, sf_dir):
    return rounded(encoding.robust_parameters(tables.contacts(spark, sf_dir), CAMPAIGN.numeric), "center", "scale")


@query
def robust_fit_approximate(spark, sf_dir):
    """Quartiles from a summary, of the whole table and merged from three parts: true ranks are as near as the summary says."""
    rows, shares, error = tables.contacts(spark, sf_dir), [0.25, 0.5, 0.75], 0.002
    parts = [summary.quantile_summary(rows.where(F.col(KEY) % 3 == i), CAMPAIGN.numeric, error) for i in range(3)]
    found = summary.summary_quantiles(summary.quantile_summary(rows, CAMPAIGN.numeric, error), shares).withColumn("source", F.lit("whole")).unionByName(
        summary.summary_quantiles(summary.merged(parts), shares).withColumn("source", F.lit("merged")))
    found = materialize(found, "quartiles")
    counts = long_values(rows, CAMPAIGN.numeric).groupBy("feature", "value").agg(F.count("*").alias("same"))
    # Columns x shares rows, twice.
    ranks = counts.join(F.broadcast(found), "feature").groupBy("source", "feature", "share", "n", "rank_error").agg(
        F.sum(F.when(F.col("value") < F.col("quantile"), F.col("same")).otherwise(0)).alias("less"),
        F.sum(F.when(F.col("value") <= F.col("quantile"), F.col("same")).otherwise(0)).alias("upto"))
    rank = (F.col("n") - 1) * F.col("share")
    off = F.greatest(F.col("less") - rank, rank - (F.col("upto") - 1), F.lit(0.0))
    return ranks.select("source", "feature", "share", "n", (off <= F.col("rank_error")).alias("rank_within_bound"), (F.col("rank_error") <= error * F.col("n") + 1).alias("bound_kept"))


@query
def describe_infinite(spark, sf_dir):
    """Statistics of columns with endless values."""
    endless = float("inf")
    rows = tables.contacts(spark, sf_dir).select(
        F.when(F.col("duration") > 1000, endless).otherwise(F.col("duration").cast("double")).alias("long"),
        F.when(F.col("day") < 10, -endless).when(F.col("day") > 20, endless).otherwise(F.col("day").cast("double")).alias("both"))
    shown = ["min", "p25", "p50", "p75", "max"]
    finite = [F.when(F.col(c) == endless, 1e300).when(F.col(c) == -endless, -1e300).otherwise(F.round(c, 6)).alias(c) for c in shown]
    return profiling.describe(rows, ["long", "both"]).select("feature", "count", *finite)


@query
def robust_transform(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    model = encoding.fit_encoder(rows)
    names = [f"num__{c}" for c in CAMPAIGN.numeric]
    return rounded(model.transform(rows, keep=[KEY]).select(KEY, *names), *names, digits=6)


@query
def onehot_fit(spark, sf_dir):
    return encoding.vocabulary(tables.contacts(spark, sf_dir))


@query
def onehot_transform(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    model = encoding.fit_encoder(rows)
    names = [n for n in model.feature_names if n.startswith("cat__")]
    totals = model.transform(rows).agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("bigint").alias("rows_set")) for n in names
    ])))


@query
def feature_names(spark, sf_dir):
    return encoding.fit_encoder(tables.contacts(spark, sf_dir)).names_table(spark)


@query
def encode_features(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    model = encoding.fit_encoder(rows)
    wide = model.transform(rows, keep=[KEY])
    return wide.select(
        KEY, *[F.round(F.col(f"`{n}`"), 6).alias(f"f{i}") for i, n in enumerate(model.feature_names)]
    )


@query
def encode_sparse(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    sparse = encoding.fit_encoder(rows).transform_sparse(rows, keep=[KEY])
    long = sparse.select(KEY, F.explode("features").alias("position", "value"))
    return long.groupBy("position").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.col(KEY)).alias("key_sum")
    )


@query
def encoder_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "encoder")
    encoding.fit_encoder(tables.contacts(spark, sf_dir)).save(spark, path)
    return rounded(encoding.load_encoder(spark, path).scaler_table(spark), "center", "scale")


@query
def vocabulary_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "encoder")
    encoding.fit_encoder(tables.contacts(spark, sf_dir)).save(spark, path)
    return encoding.load_encoder(spark, path).vocabulary_table(spark)


@query
def unseen_categories(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    model = encoding.fit_encoder(rows.where(F.col("contact") == "cellular"))
    return model.unseen_categories(rows)


# --- splits ---------------------------------------------------------------------------


def labelled(spark, sf_dir) -> DataFrame:
    return projection.labelled(tables.contacts(spark, sf_dir))


@query
def stratified_split(spark, sf_dir):
    return splitting.stratified_split(labelled(spark, sf_dir), KEY).select(KEY, "label", "part")


@query
def stratified_folds(spark, sf_dir):
    return splitting.stratified_folds(labelled(spark, sf_dir), KEY).select(KEY, "label", "fold")


@query
def class_weights(spark, sf_dir):
    return rounded(splitting.class_weights(labelled(spark, sf_dir)), "weight")


@query
def row_weights(spark, sf_dir):
    return rounded(splitting.with_class_weight(labelled(spark, sf_dir)).select(KEY, "label", "weight"), "weight")


# --- sources and histories ------------------------------------------------------------


@query
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "campaign-csv")
    tables.contacts(spark, sf_dir).drop("contact_ts").write.option("header", True).csv(path)
    return tables.read_campaign(spark, path)


@query
def csv_scan_mixed_headers(spark, sf_dir):
    """Files of three headers: the declared order, another order, and without one column."""
    path, rows = scratch_path(spark, "mixed-csv"), tables.contacts(spark, sf_dir).drop("contact_ts")
    for i, columns in enumerate((rows.columns, rows.columns[::-1], [c for c in rows.columns if c != "poutcome"])):
        rows.where(F.col(KEY) % 3 == i).select(columns).write.mode("append").option("header", True).csv(path)
    return tables.read_campaign(spark, path).select(*rows.columns)


@query
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "campaign-json")
    tables.contacts(spark, sf_dir).drop("contact_ts").write.json(path)
    return tables.read_campaign(spark, path, "json")


@query
def parquet_scan(spark, sf_dir):
    path = scratch_path(spark, "campaign-parquet")
    tables.contacts(spark, sf_dir).drop("contact_ts").write.parquet(path)
    return tables.read_campaign(spark, path, "parquet")


@query
def json_requests(spark, sf_dir):
    path = scratch_path(spark, "requests-json")
    tables.raw_requests(tables.contacts(spark, sf_dir)).write.json(path)
    return tables.read_requests(spark, path)


@query
def source_contract(spark, sf_dir):
    """A table without the target, or a path without files, is refused before any job."""
    rows = tables.contacts(spark, sf_dir)
    try:
        tables.require_target(rows.drop("deposit").columns)
        target = "accepted"
    except ValueError:
        target = "refused"
    try:
        tables.read_campaign(spark, scratch_path(spark, "nothing"))
        path = "accepted"
    except Exception as e:  # the type lives in another module for a remote session
        path = "refused" if type(e).__name__ == "AnalysisException" else "unexpected"
    return rows.agg(F.count("*").alias("n")).select(
        "n", F.lit(target).alias("missing_target"), F.lit(path).alias("missing_path")
    )


def _prediction_view(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(
        KEY, *more, "prediction", r9("probability").alias("probability"), "probability_text", "class_name",
        text.timestamp_text(F.col("created_at")).alias("created"),
    )


@query
def prediction_history(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    store.append_history(predictions(spark, sf_dir), path, grain="month")
    back = store.read_history(spark, path)
    return _prediction_view(back, F.col("input_data.job").alias("job"), F.col("input_data.balance").alias("balance"))


@query
def prediction_documents(spark, sf_dir):
    """Inputs as JSON text; read back by field, as number texts differ between engines."""
    docs = predictions(spark, sf_dir).select(KEY, F.to_json("input_data").alias("doc"))
    doc = F.col("doc")
    return docs.select(
        KEY, F.get_json_object(doc, "$.job").alias("job"), text.field_or_zero(doc, "balance").alias("balance"),
        text.field_or_zero(doc, "no_such_field").alias("missing"),
    )


@query
def latest_predictions(spark, sf_dir):
    return _prediction_view(history.newest(predictions(spark, sf_dir), tie=KEY))


@query
def last10_predictions(spark, sf_dir):
    last = history.last_predictions(predictions(spark, sf_dir), tie=KEY)
    return last.select(KEY, "prediction", "probability_text", "class_name",
                       text.timestamp_text(F.col("created_at")).alias("created"))


def _stored_predictions(spark, sf_dir) -> str:
    """A history of three batches, by month: contacts are few for their many days."""
    path, rows = scratch_path(spark, "stored"), predictions(spark, sf_dir)
    for i in range(3):
        store.write_history_batch(rows.where(F.col(KEY) % 3 == i), path, "r", i, "month", rebalance=True)
    return path


@query
def latest_predictions_stored(spark, sf_dir):
    """From a stored history, of which only the newest dates are read."""
    return _prediction_view(store.read_newest(spark, _stored_predictions(spark, sf_dir), tie=KEY))


@query
def last10_predictions_stored(spark, sf_dir):
    last = store.read_newest(spark, _stored_predictions(spark, sf_dir), 10, KEY)
    return last.select(KEY, "prediction", "probability_text", "class_name", text.timestamp_text(F.col("created_at")).alias("created"))


@query
def high_probability_stored(spark, sf_dir):
    return _prediction_view(history.high_probability(store.read_history(spark, _stored_predictions(spark, sf_dir)), tie=KEY))


@query
def quarantine_history(spark, sf_dir):
    """What a scoring batch rejects, read back from its own table."""
    path = scratch_path(spark, "both")
    jobs.scoring_job(requests(spark, sf_dir), fixed_model(spark, sf_dir), path, path + "-quarantine")
    kept = store.read_history(spark, path + "-quarantine")
    names = F.transform("violations", lambda v: F.concat(v["rule"], F.lit(":"), v["kind"]))
    return kept.select(KEY, "age", "job", F.array_join(names, ",").alias("violations"))


@query
def predictions_by_class(spark, sf_dir):
    return history.predictions_by_class(predictions(spark, sf_dir))


@query
def high_probability(spark, sf_dir):
    return _prediction_view(history.high_probability(predictions(spark, sf_dir), tie=KEY))


def _metrics_view(df: DataFrame) -> DataFrame:
    return df.select(
        text.timestamp_text(F.col("created_at")).alias("created"), "model_name",
        *[r9(f"metrics.{f}").alias(f) for f in METRIC_FIELDS],
    )


@query
def append_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    store.append_metrics(weekly(spark, sf_dir), path)
    return _metrics_view(store.read_history(spark, path))


@query
def metrics_top100(spark, sf_dir):
    return _metrics_view(history.newest(weekly(spark, sf_dir)))


@query
def latest_metrics(spark, sf_dir):
    return _metrics_view(history.newest(weekly(spark, sf_dir), 1))


@query
def latest_metrics_per_model(spark, sf_dir):
    """Newest week of every contact channel, each channel as a model of its own."""
    rows = scored(spark, sf_dir).withColumn("week", text.week_start(F.col("contact_ts")))
    bundle = evaluation.metrics_bundle(rows, by=["contact", "week"], timestamp="", few_scores=True)
    runs = bundle.select("contact", F.col("week").alias("created_at"), "metrics", F.col("contact").alias("id"))
    latest = history.latest_per(runs, "contact")
    return latest.select(
        "contact", text.timestamp_text(F.col("created_at")).alias("created"),
        *[r9(f"metrics.{f}").alias(f) for f in METRIC_FIELDS],
    )


# --- dashboard datasets ---------------------------------------------------------------


def _created(df: DataFrame) -> DataFrame:
    return df.select(text.timestamp_text(F.col("created_at")).alias("created"), *[c for c in df.columns if c != "created_at"])


@query
def metric_cards(spark, sf_dir):
    return rounded(_created(reports.metric_cards(weekly(spark, sf_dir))), *METRIC_FIELDS)


@query
def metric_series(spark, sf_dir):
    return rounded(_created(reports.metric_series(weekly(spark, sf_dir))), "value")


@query
def confusion_cells(spark, sf_dir):
    return reports.confusion_cells(weekly(spark, sf_dir))


@query
def roc_long(spark, sf_dir):
    return rounded(reports.roc_long(weekly(spark, sf_dir)), "x", "y")


@query
def pr_long(spark, sf_dir):
    return rounded(reports.pr_long(weekly(spark, sf_dir)), "x", "y")


def _long_curve(spark, sf_dir, curve):
    """A run with about as many curve points as records, its points kept as rows."""
    rows = smooth(spark, sf_dir)
    runs = store.metrics_records(evaluation.metrics_bundle(rows, timestamp=""))
    runs = materialize(runs, "runs")
    points = evaluation.curve_rows(rows).crossJoin(F.broadcast(runs.select("id")))
    return rounded(reports.curves_long(runs, points, curve), "threshold", "x", "y")


@query
def roc_long_continuous(spark, sf_dir):
    return _long_curve(spark, sf_dir, "roc")


@query
def pr_long_continuous(spark, sf_dir):
    return _long_curve(spark, sf_dir, "pr")


@query
def metrics_table(spark, sf_dir):
    return reports.metrics_table(weekly(spark, sf_dir))


@query
def run_significance(spark, sf_dir):
    return rounded(_created(reports.run_significance(weekly(spark, sf_dir))), "accuracy", "p_value")


@query
def score_text(spark, sf_dir):
    return reports.score_text(scored(spark, sf_dir), KEY)


@query
def text_functions(spark, sf_dir):
    rows = tables.contacts(spark, sf_dir)
    share = F.col("duration") / F.lit(5000.0)
    iso = text.iso_text(F.col("contact_ts"))
    return rows.select(
        KEY, text.fixed4(share).alias("four"), text.percent2(share).alias("percent"),
        text.timestamp_text(F.col("contact_ts")).alias("stamp"), iso.alias("iso"),
        text.timestamp_text(text.parse_iso(iso)).alias("parsed"),
        text.to_number(F.concat(F.col("duration").cast("string"), F.when(F.col("day") > 15, ".5").otherwise("x"))).alias("number"),
        text.title_label(F.concat(F.col("contact"), F.lit("_"), F.col("month"))).alias("title"),
    )


# --- trees ----------------------------------------------------------------------------

# A small tree over encoded features, for scoring without training.
FIXED_TREE = [
    (1, 0, "num__duration", 0.0, 1000, 1000.0, 0.42, None),
    (2, 1, "cat__poutcome_success", 0.5, 500, 500.0, 0.2, 1000),
    (3, 1, "cat__contact_telephone", 0.5, 500, 500.0, 0.63, 1000),
    (4, 2, None, None, 400, 400.0, 0.1, 500),
    (5, 2, "num__age", -0.4, 100, 100.0, 0.54, 500),
    (6, 2, None, None, 300, 300.0, 0.85, 500),
    (7, 2, "cat__poutcome_success", 0.5, 200, 200.0, 0.4, 500),
    (10, 3, None, None, 40, 40.0, 0.6, 100),
    (11, 3, None, None, 60, 60.0, 0.5, 100),
    (14, 3, None, None, 150, 150.0, 0.3, 200),
    (15, 3, None, None, 50, 50.0, 0.95, 200),
]


def fixed_model(spark, sf_dir) -> jobs.Model:
    pointers = [(2 * r[0], 2 * r[0] + 1) if r[2] else (None, None) for r in FIXED_TREE]
    nodes = small_table(spark, [(*r, *p) for r, p in zip(FIXED_TREE, pointers)], NODE_TABLE)
    return jobs.Model(encoding.fit_encoder(tables.contacts(spark, sf_dir)), nodes)


@query
def score_fixed_tree(spark, sf_dir):
    model = fixed_model(spark, sf_dir)
    return model.score(tables.contacts(spark, sf_dir), keep=[KEY])


@query
def score_fixed_tree_walk(spark, sf_dir):
    """The same tree by the batch walk that large trees use."""
    model = fixed_model(spark, sf_dir)
    encoded = model.encoder.transform(tables.contacts(spark, sf_dir), keep=[KEY])
    return tree.score(encoded, model.nodes, keep=[KEY], case_nodes=0)


@query
def tree_roundtrip(spark, sf_dir):
    model = fixed_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    model.save(path)
    loaded = jobs.load_model(spark, path)
    scores = loaded.score(tables.contacts(spark, sf_dir), keep=["contact"])
    return scores.groupBy("contact", "p", "prediction").agg(F.count("*").alias("n"))


@query
def truncated_tree_scores(spark, sf_dir):
    """The fixed tree cut at depth 2, and at 450 rows per split."""
    model = fixed_model(spark, sf_dir)
    encoded = model.encoder.transform(tables.contacts(spark, sf_dir), keep=[KEY])
    first = tree.score(encoded, tree.truncate(model.nodes, max_depth=2)).drop("prediction").withColumnRenamed("p", "p_depth")
    return tree.score(first, tree.truncate(model.nodes, min_split=450), keep=[KEY, "p_depth"]).select(KEY, "p_depth", F.col("p").alias("p_size"))


@query
def scoring_job(spark, sf_dir):
    """Validate, score and append spoilt and sound requests; read the history back."""
    path = scratch_path(spark, "scores")
    jobs.scoring_job(requests(spark, sf_dir), fixed_model(spark, sf_dir), path, path + "-quarantine")
    return store.read_history(spark, path).select(
        KEY, "prediction", "probability", "probability_text", "class_name",
        F.col("input_data.job").alias("job"), F.col("input_data.age").alias("age"),
    )


@query
def evaluation_job(spark, sf_dir):
    """Score and evaluate the same hold-out again with a stored model, which knows where the split was."""
    model, path = fixed_model(spark, sf_dir), scratch_path(spark, "evaluated")
    split = splitting.split_thresholds(labelled(spark, sf_dir), KEY)
    jobs.Model(model.encoder, model.nodes, split).save(path)
    bundle = jobs.evaluate_holdout(tables.contacts(spark, sf_dir), jobs.load_model(spark, path), timestamp="2024-01-01 00:00:00")
    m = F.col("metrics")
    return bundle.select("n", *[r9(m[f]).alias(f) for f in METRIC_FIELDS], m["timestamp"].alias("timestamp"))


def _train_part(spark, sf_dir) -> tuple[encoding.EncoderModel, DataFrame]:
    # Written once: split, encoder and encoding read it seven times, and the view's CASEs would be copied into every indicator.
    rows = materialize(labelled(spark, sf_dir), "labelled")
    parts = splitting.stratified_split(rows, KEY)
    encoder = encoding.fit_encoder(rows)
    train = encoder.transform(parts.where(F.col("part") == "train"), keep=[KEY, "label"])
    return encoder, materialize(train, "train")


def _nodes_view(nodes: DataFrame) -> DataFrame:
    return rounded(tree.numbered(nodes), "threshold", "n_weighted", "p1")


@query
def tree_gini(spark, sf_dir):
    encoder, train = _train_part(spark, sf_dir)
    forest = tree.grow_trees(train, *jobs.split_kinds(encoder), [tree.TreeSetting("gini")], max_depth=5)
    return _nodes_view(tree.node_table(forest))


@query
def tree_entropy(spark, sf_dir):
    encoder, train = _train_part(spark, sf_dir)
    forest = tree.grow_trees(train, *jobs.split_kinds(encoder), [tree.TreeSetting("entropy")], max_depth=5)
    return _nodes_view(tree.node_table(forest))


@query
def tree_size_limits(spark, sf_dir):
    """One deep tree per leaf size, cut at several depths and split sizes: node counts."""
    encoder, train = _train_part(spark, sf_dir)
    settings = [tree.TreeSetting("gini", False, m) for m in (1, 2, 4, 8)]
    forest = tree.grow_trees(train, *jobs.split_kinds(encoder), settings, max_depth=8)
    out = None
    for t in forest.trees:
        nodes = tree.node_table(forest, t["tree"])
        for depth in (3, 5, 8):
            for size in (2, 20):
                cut = tree.truncate(nodes, depth, size).agg(
                    F.count("*").alias("nodes"), F.count_if(F.col("feature").isNull()).alias("leaves"),
                    F.max("depth").alias("deepest"),
                ).select(
                    F.lit(t["min_leaf"]).alias("min_leaf"), F.lit(depth).alias("max_depth"),
                    F.lit(size).alias("min_split"), "*",
                )
                out = cut if out is None else out.unionByName(cut)
    return out


# Features with few values: every midpoint is a candidate, so SQL can find the same split.
PLAIN_NUMERIC = ("age", "day", "campaign", "previous")
PLAIN_FLAGS = ("housing", "loan", "default")


def _first_splits(rows, value):
    rows = rows.select(
        "label", *[value(i, c).cast("double").alias(c) for i, c in enumerate(PLAIN_NUMERIC)],
        F.when(F.col("contact") == "cellular", 1.0).otherwise(0.0).alias("cellular"),
        F.when(F.col("contact") == "telephone", 1.0).otherwise(0.0).alias("telephone"),
        F.when(F.col("poutcome") == "success", 1.0).otherwise(0.0).alias("success"),
        *[F.when(F.col(c) == "yes", 1.0).otherwise(0.0).alias(c) for c in PLAIN_FLAGS],
    )
    settings = [tree.TreeSetting(c, b, 5) for c in ("gini", "entropy") for b in (False, True)]
    forest = tree.grow_trees(
        rows, PLAIN_NUMERIC, ("cellular", "telephone", "success", *PLAIN_FLAGS), settings, max_depth=2
    )
    return tree.numbered(forest.nodes).select(
        "tree", "node", "n0", "n1", "feature", F.when(F.col("threshold") == float("inf"), 1e300).otherwise(F.col("threshold")).alias("threshold"),
        r9(F.col("n1") * F.col("w1") / (F.col("n0") * F.col("w0") + F.col("n1") * F.col("w1"))).alias("p1"),
    )


@query
def tree_first_splits(spark, sf_dir):
    """Depth-2 trees by both criteria, with and without class weights."""
    return _first_splits(labelled(spark, sf_dir), lambda i, c: F.col(c))


@query
def tree_with_missing(spark, sf_dir):
    """The same trees where each numeric feature lacks every seventh value."""
    return _first_splits(labelled(spark, sf_dir), lambda i, c: F.when(F.col(KEY) % 7 != i, F.col(c)))


FOUR_TREES = [tree.TreeSetting(c, b, 5) for c in ("gini", "entropy") for b in (False, True)]


def _split_view(forest: tree.Forest) -> DataFrame:
    shown = F.when(F.col("threshold") == float("inf"), 1e300).when(F.col("threshold") == float("-inf"), -1e300).otherwise(F.col("threshold"))
    return tree.numbered(forest.nodes).select(
        "tree", "node", "n0", "n1", "feature", shown.alias("threshold"),
        r9(F.col("n1") * F.col("w1") / (F.col("n0") * F.col("w0") + F.col("n1") * F.col("w1"))).alias("p1"),
    )


@query
def tree_all_midpoints(spark, sf_dir):
    """Trees over all numeric columns, as many split points as values, and all categories."""
    rows = labelled(spark, sf_dir)
    encoder = encoding.fit_encoder(rows)
    wide = materialize(encoder.transform(rows, keep=["label", *CAMPAIGN.numeric]), "wide")
    return _split_view(tree.grow_trees(wide, CAMPAIGN.numeric, jobs.split_kinds(encoder)[1], FOUR_TREES, max_depth=4))


@query
def tree_odd_numbers(spark, sf_dir):
    """Trees over columns with missing and endless values, one of them constant but for missing values."""
    endless = float("inf")
    rows = labelled(spark, sf_dir).select(
        "label", F.when(F.col(KEY) % 7 != 0, F.col("balance")).alias("balance"), F.when(F.col("duration") % 5 != 0, 1.0).alias("constant"),
        F.when(F.col("duration") > 3000, endless).when(F.col("duration") < 300, -endless).otherwise(F.col("duration")).alias("duration"),
        F.when(F.col("day") > 20, endless).otherwise(-endless).alias("sign"),
    )
    return _split_view(tree.grow_trees(rows, ["balance", "constant", "duration", "sign"], [], FOUR_TREES, max_depth=4))


#: A column with about as many categories as there are rows, beside a small one.
BRANCHES = FeatureSpec(key=KEY, numeric=("age", "duration"), categorical=("branch", "job"), target="deposit", rules=())


def _branch_trees(spark, sf_dir) -> tuple[DataFrame, encoding.EncoderModel, tree.Forest]:
    rows = labelled(spark, sf_dir).withColumn("branch", F.concat(F.lit("b"), (F.col(KEY) % 20011).cast("string")))
    encoder = encoding.fit_encoder(rows, BRANCHES)
    coded = materialize(encoder.coded(rows, keep=["label"]), "coded")
    settings = [tree.TreeSetting("gini", False, 1), tree.TreeSetting("entropy", True, 3)]
    return rows, encoder, tree.grow_arrays(coded, encoder.layout(coded), settings, max_depth=4)


@query
def encode_many_categories(spark, sf_dir):
    """Trees over a key-like column: its categories are positions in a table, not columns."""
    return _split_view(_branch_trees(spark, sf_dir)[2])


@query
def score_many_categories(spark, sf_dir):
    """The rows of each leaf, scored from the raw table with a saved and loaded model."""
    rows, encoder, forest = _branch_trees(spark, sf_dir)
    path = scratch_path(spark, "branches")
    jobs.Model(encoder, tree.node_table(forest, 1)).save(path)
    scores = jobs.load_model(spark, path, BRANCHES).score(rows, keep=[KEY])
    return scores.groupBy(r9("p").alias("p")).agg(F.count("*").alias("n"))


@query
def grid_search(spark, sf_dir):
    """Cross-validated scores of all 320 candidates on 10 folds of the training part."""
    full = grid.Grid()
    # Written once, as in _train_part.
    rows = materialize(labelled(spark, sf_dir), "labelled")
    encoder = encoding.fit_encoder(rows)
    parts = splitting.stratified_split(rows, KEY).where(F.col("part") == "train")
    train = materialize(encoder.coded(parts, keep=[KEY, "label"]), "train")
    scores, _ = grid.search_arrays(train, KEY, encoder.layout(train), full, folds=10)
    ranked = grid.candidate_table(spark, full).join(grid.rank_candidates(scores), "candidate")
    return rounded(ranked, "mean_test_score", "std_test_score", "mean_train_score", "std_train_score")


def _job_scores(spark, sf_dir) -> DataFrame:
    """Fold scores with each job as a candidate: AUC of the scorecard in every fold."""
    folded = splitting.stratified_folds(scored(spark, sf_dir), KEY, folds=5)
    number = F.array_position(F.array(*[F.lit(j) for j in sorted(tables.CAMPAIGN_JOBS_BY_INDEX)]), F.col("job"))
    rows = folded.withColumn("candidate", number.cast("int"))
    test = evaluation.roc_auc(rows, by=["candidate", "fold"], few_scores=True).withColumn("part", F.lit("test"))
    train = evaluation.roc_auc(rows.withColumn("p", F.col("duration") / 5e3), by=["candidate", "fold"])
    return test.unionByName(train.withColumn("part", F.lit("train")))


@query
def grid_rank(spark, sf_dir):
    ranked = grid.rank_candidates(_job_scores(spark, sf_dir))
    return rounded(ranked, "mean_test_score", "std_test_score", "mean_train_score", "std_train_score")


@query
def grid_best(spark, sf_dir):
    best = grid.best_candidate(grid.rank_candidates(_job_scores(spark, sf_dir)))
    return rounded(best, "mean_test_score").select("candidate", "mean_test_score", "rank_test_score")


@query
def holdout_evaluation(spark, sf_dir):
    """Search, select, refit and test: the whole training job on the full grid."""
    result = jobs.train_and_select(
        tables.contacts(spark, sf_dir), grid=grid.Grid(), folds=10, timestamp="2024-01-01 00:00:00"
    )
    m = F.col("metrics")
    return result.holdout.select(
        "n", *[r9(m[f]).alias(f) for f in METRIC_FIELDS],
        F.lit(result.best["criterion"]).alias("criterion"), F.lit(result.best["max_depth"]).alias("max_depth"),
        F.lit(result.best["min_split"]).alias("min_split"),
    )


# --- streams --------------------------------------------------------------------------


#: Rows of a file of requests; one task deals out and writes each file.
FILE_ROWS = 500_000


def write_requests(requests: DataFrame, path: str, files: int) -> None:
    """All requests as JSON in ``files`` files, in more where files would get too large."""
    requests.repartition(max(files, -(-requests.count() // FILE_ROWS))).write.json(path)


@query
def stream_scoring(spark, sf_dir):
    """Requests arrive as JSON files; the drained history equals the batch job."""
    base = scratch_path(spark, "stream-scoring")
    source, target = os.path.join(base, "requests"), os.path.join(base, "history")
    write_requests(tables.raw_requests(tables.contacts(spark, sf_dir)), source, 4)
    streams.stream_scoring(
        spark, source, fixed_model(spark, sf_dir), target, os.path.join(base, "quarantine"),
        os.path.join(base, "checkpoint"), once=True, max_files=2,
    ).awaitTermination()
    return store.read_history(spark, target).select(
        KEY, "prediction", "probability", "probability_text", "class_name",
        F.col("input_data.job").alias("job"), F.col("input_data.age").alias("age"),
    )


@query
def mixed_history(spark, sf_dir):
    """A batch job and two streams, the second with a new checkpoint, append to one history."""
    base = scratch_path(spark, "mixed-history")
    source, target = os.path.join(base, "requests"), os.path.join(base, "history")
    model = fixed_model(spark, sf_dir)
    requests = tables.raw_requests(tables.contacts(spark, sf_dir))
    write_requests(requests, source, 2)
    jobs.scoring_job(tables.read_requests(spark, source), model, target)
    for name in ("first", "second"):
        streams.stream_scoring(
            spark, source, model, target, os.path.join(base, "quarantine"), os.path.join(base, name), once=True
        ).awaitTermination()
    return store.read_history(spark, target).groupBy(KEY, "prediction", "probability_text", "class_name").agg(F.count("*").alias("n"))


@query
def stream_refresh(spark, sf_dir):
    """Metric documents arrive; the refreshed printable table is read back."""
    base = scratch_path(spark, "stream-refresh")
    source, target = os.path.join(base, "metrics"), os.path.join(base, "tables")
    store.append_metrics(weekly(spark, sf_dir), source)
    streams.stream_refresh(spark, source, target, os.path.join(base, "checkpoint"), once=True).awaitTermination()
    return streams.read_dashboard(spark, target)["metrics_table"]


@query
def stream_refresh_all(spark, sf_dir):
    """Documents arrive in three batches; all six tables of the last version, a line of text per row."""
    base = scratch_path(spark, "refresh-all")
    source, target = os.path.join(base, "metrics"), os.path.join(base, "tables")
    documents = materialize(weekly(spark, sf_dir), "weekly")
    for i in range(3):
        store.append_metrics(documents.where(F.pmod("id", F.lit(3)) == i), source)
        streams.stream_refresh(spark, source, target, os.path.join(base, "checkpoint"), once=True).awaitTermination()
    created = text.timestamp_text(F.col("created_at"))
    shown = {
        "metric_cards": [created, *[text.fixed4(F.col(m)) for m in METRIC_FIELDS]],
        "metric_series": [created, "metric", text.fixed4(F.col("value"))],
        "confusion_cells": ["actual", "predicted", F.col("n").cast("string")],
        "roc_long": ["series", F.col("point_no").cast("string"), text.fixed4(F.col("x")), text.fixed4(F.col("y"))],
        "pr_long": ["series", F.col("point_no").cast("string"), text.fixed4(F.col("x")), text.fixed4(F.col("y"))],
        "metrics_table": ["created", *METRIC_FIELDS],
    }
    out = None
    for name, df in streams.read_dashboard(spark, target).items():
        lines = df.select(F.lit(name).alias("name"), F.concat_ws("|", *shown[name]).alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


def _job_curves(spark, sf_dir, curve: str) -> DataFrame:
    """Curve of the newest document of a history that an evaluation job wrote."""
    base = scratch_path(spark, "job-curves")
    history_path, curves_path = os.path.join(base, "metrics"), os.path.join(base, "curves")
    jobs.evaluate_holdout(
        tables.contacts(spark, sf_dir), fixed_model(spark, sf_dir), timestamp="2024-01-01 00:00:00", history_path=history_path, curves_path=curves_path)
    points = reports.curves_long(store.read_history(spark, history_path), spark.read.parquet(curves_path), curve)
    return rounded(points, "threshold", "x", "y")


@query
def roc_long_stored(spark, sf_dir):
    return _job_curves(spark, sf_dir, "roc")


@query
def pr_long_stored(spark, sf_dir):
    return _job_curves(spark, sf_dir, "pr")
