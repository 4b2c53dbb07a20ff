"""Append-only histories of predictions and of metrics, as Parquet tables.

A batch counts once its manifest is written, one small file that names the batch and the rows of each date.  Readers
go by the manifests: what a write left that was ended half-way is never read.  Several tables can be written as one
batch; the manifest of the first one commits them all.

Identifiers are hashes of the business key and the time: a gap-free counter would be a
bottleneck, and a partition-based id would change when a task is run again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.functions.text import class_name, fixed4
from canvass.operators.history import newest
from canvass.session import discard, exists, make_folder, write_text
from canvass.spec import CAMPAIGN, HISTORY_LIMIT, FeatureSpec

MANIFESTS = "_commits"
MANIFEST_SCHEMA = "run_id string, batch_id int, dates array<struct<date: string, rows: long>>, commits_with string"
PARTITIONS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def utc_now() -> Column:
    """Current time as a zone-less UTC timestamp, whatever the session time zone."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def prediction_records(
    scored: DataFrame,
    spec: FeatureSpec = CAMPAIGN,
    prediction: str = "prediction",
    probability: str = "p",
    created_at: str | None = None,
) -> DataFrame:
    """Scored rows in the layout of the prediction history.

    ``created_at`` names a timestamp column; without it the time is now (UTC).
    """
    at = F.col(created_at).cast("timestamp_ntz") if created_at else utc_now()
    inputs = [F.col(f"`{c}`") for c in spec.inputs]
    return scored.select(F.struct(*inputs).alias("input_data"), F.col(f"`{spec.key}`").alias("_key"),
                         at.alias("created_at"), F.col(prediction).cast("int").alias("prediction"),
                         F.col(probability).cast("double").alias("probability")).select(
        F.xxhash64("_key", "created_at").alias("id"),
        F.col("_key").alias(spec.key),
        "input_data",
        "prediction",
        "probability",
        fixed4(F.col("probability")).alias("probability_text"),
        class_name(F.col("prediction")).alias("class_name"),
        "created_at",
    )


def metrics_records(bundle: DataFrame, created_at: str | None = None) -> DataFrame:
    """Metric documents in the layout of the metrics history."""
    at = F.col(created_at).cast("timestamp_ntz") if created_at else utc_now()
    return bundle.select(
        at.alias("created_at"), F.col("metrics.model").alias("model_name"), "metrics"
    ).select(F.xxhash64("model_name", "created_at").alias("id"), "model_name", "metrics", "created_at")


def _dated(df: DataFrame, grain: str) -> DataFrame:
    # The text of a zone-less timestamp starts with its date: yyyy-MM-dd.
    width = len(PARTITIONS[grain])
    return df.withColumn("created_date", F.substring(F.col("created_at").cast("string"), 1, width))


def new_run() -> str:
    """Name of a writer: a batch job, or a stream for as long as its checkpoint lives."""
    return f"r{uuid.uuid4().hex}"


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run kept with a checkpoint; a new or lost checkpoint starts a new run."""
    path = os.path.join(checkpoint, "run")
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException:
        run = new_run()
        spark.range(1).select(F.lit(run).alias("value")).write.text(path)
        return run


def append_history(df: DataFrame, path: str, grain: str = "day", rebalance: bool = False) -> None:
    """Append to a history as a run of its own.

    ``rebalance`` shuffles the rows to gather each date into few files.
    """
    write_history_batch(df, path, new_run(), 0, grain, rebalance)


def write_history_batch(df: DataFrame, path: str, run: str, batch_id: int, grain: str = "day", rebalance: bool = False) -> None:
    write_together([(df, path)], run, batch_id, grain, rebalance)


def write_together(tables: Sequence[tuple[DataFrame, str]], run: str, batch_id: int, grain: str = "day", rebalance: bool = False) -> None:
    """Write one batch of each table to ``run_id=/batch_id=/created_date=``, and commit them together.

    A retry replaces just that batch.  Batch jobs and streams share this layout, so one history can hold both, and no run
    replaces what another one wrote.  The manifest of the first table comes last; those of the others point to it.
    """
    manifests = []
    for df, path in tables:
        spark = df.sparkSession
        _open(spark, path)
        dated = _dated(df, grain) if "created_at" in df.columns else df.withColumn("created_date", F.lit("all"))
        if rebalance:
            dated = dated.hint("rebalance", "created_date")
        folder = os.path.join(path, f"run_id={run}", f"batch_id={int(batch_id)}")
        # A batch that is written again does not count until it is complete.
        manifest = os.path.join(path, MANIFESTS, f"{run}-{int(batch_id)}.json")
        discard(spark, manifest)
        dated.write.mode("overwrite").partitionBy("created_date").parquet(folder)
        # As many rows as the batch has dates; counts come from the files' footers.
        dates = spark.read.schema(dated.schema).parquet(folder).groupBy(F.col("created_date").cast("string").alias("d")).count().collect()
        rows = [{"date": r["d"], "rows": r["count"]} for r in sorted(dates, key=lambda r: r["d"])]
        manifests.append((manifest, {"run_id": run, "batch_id": int(batch_id), "dates": rows}))
    first = tables[0][1]
    for (manifest, content), (_, path) in reversed(list(zip(manifests, tables))):
        write_text(spark, manifest, json.dumps(content if path == first else content | {"commits_with": first}))


def _open(spark: SparkSession, path: str) -> None:
    """Start the manifests of a history; batches of before there were any get theirs."""
    if exists(spark, os.path.join(path, MANIFESTS)):
        return
    older = []
    if exists(spark, path):
        df = spark.read.parquet(path)
        if "run_id" in df.columns:
            older = df.groupBy("run_id", "batch_id", F.col("created_date").cast("string").alias("date")).count().collect()
    make_folder(spark, os.path.join(path, MANIFESTS))
    for run, batch in sorted({(r["run_id"], r["batch_id"]) for r in older}):
        rows = [{"date": r["date"], "rows": r["count"]} for r in older if (r["run_id"], r["batch_id"]) == (run, batch)]
        write_text(spark, os.path.join(path, MANIFESTS, f"{run}-{batch}.json"), json.dumps({"run_id": run, "batch_id": batch, "dates": rows}))


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """(run_id, batch_id, dates) of the batches that count; none where a table has no manifests and all of it counts."""
    folder = os.path.join(path, MANIFESTS)
    if not exists(spark, folder):
        return None
    own = spark.read.schema(MANIFEST_SCHEMA).json(folder)
    batches = own.where("commits_with IS NULL").drop("commits_with")
    # Tables that others are committed with: one or two.
    for r in own.select("commits_with").where("commits_with IS NOT NULL").distinct().collect():
        leading = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(r["commits_with"], MANIFESTS)).select("run_id", "batch_id")
        mine = own.where(F.col("commits_with") == r["commits_with"]).drop("commits_with")
        batches = batches.unionByName(mine.join(leading, ["run_id", "batch_id"], "left_semi"))
    return batches


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric documents: few rows per run, so no partitioning."""
    df.write.mode("append").parquet(path)


def read_history(
    spark: SparkSession, path: str, drop: Sequence[str] = ("created_date", "run_id", "batch_id"), since: str | None = None,
) -> DataFrame:
    """The committed batches of a history, all of it or the dates from ``since`` (text of a date) on: other folders are not read."""
    df, batches = spark.read.parquet(path), committed(spark, path)
    if batches is not None:
        df = df.join(batches.select("run_id", "batch_id"), ["run_id", "batch_id"], "left_semi")
    if since is not None:
        # A month's folder may hold the day that is asked for.
        df = df.where(F.concat(F.col("created_date").cast("string"), F.lit("~")) >= since)
    return df.drop(*[c for c in drop if c in df.columns])


def first_date_of_newest(spark: SparkSession, path: str, limit: int) -> str | None:
    """The date from which on a history holds ``limit`` rows at least, by its manifests; none if it holds fewer."""
    batches = committed(spark, path)
    if batches is None:
        return None
    by_date = batches.select(F.inline("dates")).groupBy("date").agg(F.sum("rows").alias("rows"))
    # One row per date of the history.
    upto = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return by_date.select("date", upto.alias("upto")).where(F.col("upto") >= limit).agg(F.max("date")).first()[0]


def read_newest(spark: SparkSession, path: str, limit: int = HISTORY_LIMIT, tie: str = "id") -> DataFrame:
    """The newest rows of a stored history; folders of dates before them are neither listed nor opened."""
    since = first_date_of_newest(spark, path, limit)
    if since is None:
        return newest(read_history(spark, path), limit, tie)
    # One row per batch and date from there on.
    wanted = committed(spark, path).select("run_id", "batch_id", F.inline("dates")).where(F.concat("date", F.lit("~")) >= since).collect()
    folders = [os.path.join(path, f"run_id={r['run_id']}", f"batch_id={r['batch_id']}", f"created_date={r['date']}") for r in wanted]
    rows = spark.read.option("basePath", path).parquet(*folders)
    return newest(rows.drop("created_date", "run_id", "batch_id"), limit, tie)
