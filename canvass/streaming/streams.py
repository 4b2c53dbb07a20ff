"""Streams: continuous scoring, and refresh of the dashboard tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators import reports
from canvass.plans.jobs import Model, score_batch
from canvass.session import discard, exists, list_folder, read_text, write_text
from canvass.sources.history import run_of
from canvass.sources.tables import read_requests
from canvass.spec import CAMPAIGN, METRICS_HISTORY, FeatureSpec

REFRESH_SECONDS = 30


def _start(writer, once: bool, seconds: int) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start()


def stream_scoring(
    spark: SparkSession,
    source: str,
    model: Model,
    history_path: str,
    quarantine_path: str,
    checkpoint: str,
    spec: FeatureSpec = CAMPAIGN,
    once: bool = False,
    seconds: int = 5,
    max_files: int | None = None,
) -> StreamingQuery:
    """Score arriving JSON requests and append them to the history.

    Stateless, so there is no watermark.  A micro-batch goes to a folder named after the run and
    its number: when it is repeated after a failure it replaces what it wrote before.  A
    run lives as long as its checkpoint, so a new checkpoint adds to the history.
    """
    requests = read_requests(spark, source, spec, stream=True) if max_files is None else (
        spark.readStream.schema(read_requests(spark, source, spec).schema)
        .option("maxFilesPerTrigger", max_files).json(source)
    )

    run = run_of(spark, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, model, history_path, quarantine_path, run, batch_id, spec)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(writer, once, seconds)


DASHBOARD_TABLES = {
    "metric_cards": reports.metric_cards,
    "metric_series": reports.metric_series,
    "confusion_cells": reports.confusion_cells,
    "roc_long": reports.roc_long,
    "pr_long": reports.pr_long,
    "metrics_table": reports.metrics_table,
}
#: The file that names the version readers take.
CURRENT = "current"
KEPT_VERSIONS = 2


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder of the version to be read, none before the first refresh."""
    pointer = os.path.join(target, CURRENT)
    return os.path.join(target, read_text(spark, pointer)) if exists(spark, pointer) else None


def read_dashboard(spark: SparkSession, target: str, names: Sequence[str] = tuple(DASHBOARD_TABLES)) -> dict[str, DataFrame]:
    """Tables of one and the same version, however many refreshes happen meanwhile."""
    version = current_version(spark, target)
    if version is None:
        raise ValueError("the dashboard has not been refreshed yet")
    return {n: spark.read.parquet(os.path.join(version, n)) for n in names}


def refresh_dashboard(batch: DataFrame, target: str, version: str, curves_path: str | None = None) -> None:
    """Fold arriving metric documents into the kept state and switch to a new version of all tables.

    The state is the newest documents that any table shows, at most ``HISTORY_LIMIT`` rows; so a refresh costs the
    batch, not the history.  A batch that is repeated adds nothing: documents are told apart by their id.  All tables go to a
    folder of their own; the pointer is written last, in one step.
    """
    spark = batch.sparkSession
    before = current_version(spark, target)
    rows = batch.select(METRICS_HISTORY.names)
    if before is not None:
        rows = rows.unionByName(spark.read.parquet(os.path.join(before, "state")))
    folder = os.path.join(target, version)
    reports.newest(rows.dropDuplicates(["id"])).write.mode("overwrite").parquet(os.path.join(folder, "state"))
    state = spark.read.parquet(os.path.join(folder, "state"))
    points = spark.read.parquet(curves_path) if curves_path and exists(spark, curves_path) else None
    for name, build in DASHBOARD_TABLES.items():
        table = build(state)
        if name in ("roc_long", "pr_long"):
            # Curves of the jobs are rows of a table of their own; documents of others hold arrays.
            table = table.withColumn("threshold", F.lit(None).cast("double"))
            if points is not None:
                own = reports.curves_long(state, points, name.removesuffix("_long"))
                table = table.unionByName(own, allowMissingColumns=True)
        table.write.mode("overwrite").parquet(os.path.join(folder, name))
    write_text(spark, os.path.join(target, CURRENT), version)
    for old in sorted(n for n in list_folder(spark, target) if n.startswith("v"))[:-KEPT_VERSIONS]:
        if old != version and old != os.path.basename(before or ""):
            discard(spark, os.path.join(target, old))


def stream_refresh(
    spark: SparkSession,
    history_path: str,
    target: str,
    checkpoint: str,
    once: bool = False,
    seconds: int = REFRESH_SECONDS,
    curves_path: str | None = None,
) -> StreamingQuery:
    """Refresh the dashboard tables when metric documents arrive; readers use :func:`read_dashboard`."""
    arriving = spark.readStream.schema(METRICS_HISTORY).parquet(history_path)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        refresh_dashboard(batch, target, f"v{batch_id:012d}-{uuid.uuid4().hex}", curves_path)

    writer = arriving.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return _start(writer, once, seconds)
