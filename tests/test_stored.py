"""Histories by manifests, newest dates first, the dashboard's versions, large vocabularies, summaries."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canvass.functions.ordered import long_values
from canvass.functions.summary import merged, quantile_summary, summary_quantiles
from canvass.operators import encoding
from canvass.sources import history
from canvass.sources.tables import read_campaign
from canvass.spec import FeatureSpec, METRICS_HISTORY
from canvass.streaming import streams


def rows(spark, days, start=0):
    return spark.createDataFrame([(start + i, datetime(2024, 1, d, i % 24)) for i, d in enumerate(days)], "id long, created_at timestamp_ntz")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_a_write_that_ends_half_way_is_not_read(spark, tmp_path, monkeypatch):
    path, other = str(tmp_path / "h"), str(tmp_path / "q")
    history.write_together([(rows(spark, [1, 2]), path), (rows(spark, [1], 10), other)], "r", 0)
    real = history.write_text

    def ends(session, place, text):
        if place.startswith(path):
            raise RuntimeError("killed")
        real(session, place, text)

    monkeypatch.setattr(history, "write_text", ends)
    with pytest.raises(RuntimeError):
        history.write_together([(rows(spark, [3], 20), path), (rows(spark, [3], 30), other)], "r", 1)
    # Both tables have the rows' files, and the second one its manifest; neither counts.
    assert os.path.isdir(os.path.join(path, "run_id=r", "batch_id=1"))
    assert ids(history.read_history(spark, path)) == [0, 1] and ids(history.read_history(spark, other)) == [10]
    monkeypatch.setattr(history, "write_text", real)
    history.write_together([(rows(spark, [3], 20), path), (rows(spark, [3], 30), other)], "r", 1)
    assert ids(history.read_history(spark, path)) == [0, 1, 20] and ids(history.read_history(spark, other)) == [10, 30]
    history.write_together([(rows(spark, [4], 40), path)], "r", 1)
    assert ids(history.read_history(spark, path)) == [0, 1, 40]


def test_older_dates_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "h")
    history.write_history_batch(rows(spark, [1, 1, 2, 5]), path, "a", 0)
    history.write_history_batch(rows(spark, [3, 5, 6], 10), path, "a", 1)
    assert history.first_date_of_newest(spark, path, 3) == "2024-01-05"
    for name in os.listdir(os.path.join(path, "run_id=a", "batch_id=0")):
        if name in ("created_date=2024-01-01", "created_date=2024-01-02"):
            for f in os.listdir(os.path.join(path, "run_id=a", "batch_id=0", name)):
                if f.endswith(".parquet"):
                    with open(os.path.join(path, "run_id=a", "batch_id=0", name, f), "wb") as damaged:
                        damaged.write(b"no parquet")
    assert [r["id"] for r in history.read_newest(spark, path, 3).collect()] == [12, 3, 11]
    assert history.first_date_of_newest(spark, path, 100) is None


def test_a_reader_sees_one_version(spark, tmp_path):
    target = str(tmp_path / "tables")

    def document(i):
        values = {"model": "m", "accuracy": i / 10, "precision": 0.5, "recall": 0.5, "f1_score": 0.5, "auc_roc": 0.5, "confusion_matrix": [[i, 0], [0, i]]}
        return spark.createDataFrame([(i, "m", values, datetime(2024, 1, i))], METRICS_HISTORY)

    streams.refresh_dashboard(document(1), target, "v1")
    seen = streams.read_dashboard(spark, target)
    streams.refresh_dashboard(document(2), target, "v2")
    assert len({os.path.dirname(f.rstrip("/")).rsplit("/", 2)[-2] for df in seen.values() for f in df.inputFiles()}) == 1
    assert seen["metric_cards"].first()["accuracy"] == 0.1
    again = streams.read_dashboard(spark, target)
    assert again["metric_cards"].first()["accuracy"] == 0.2 and again["metrics_table"].count() == 2
    streams.refresh_dashboard(document(2), target, "v3")
    assert streams.read_dashboard(spark, target)["metrics_table"].count() == 2


def test_large_vocabularies_equal_inline_ones(spark, tmp_path, monkeypatch):
    spec = FeatureSpec(key="id", numeric=("n",), categorical=("a", "b"), target="y")
    values = ["x", "unknown", None, "é", "z", "", "x"]
    df = spark.createDataFrame([(i, float(i), values[i % 7], f"v{i % 13}", "yes") for i in range(60)], "id long, n double, a string, b string, y string").repartition(4)
    new = spark.createDataFrame([(1, 1.0, "never", "v3", "no"), (2, 2.0, None, "v0", "no"), (3, 3.0, "unknown", "v999", "no")], df.schema)

    def seen(model, rows):
        coded = sorted((r["id"], list(r["x"])) for r in model.coded(rows, ["id"]).collect())
        sparse = sorted((r["id"], sorted(r["features"].items())) for r in model.transform_sparse(rows, ["id"]).collect())
        unseen = sorted(map(tuple, model.unseen_categories(rows).collect()))
        return coded, sparse, unseen, sorted(map(str, model.features(spark).collect()))

    small = encoding.fit_encoder(df, spec)
    monkeypatch.setattr(encoding, "INLINE_CATEGORIES", 2)
    large = encoding.fit_encoder(df, spec)
    large.save(spark, str(tmp_path / "m"))
    loaded = encoding.load_encoder(spark, str(tmp_path / "m"), spec)
    assert dict(large.large_sizes) == {"a": 6, "b": 13} and not small.large_sizes
    for table in (df, new):
        assert seen(small, table) == seen(large, table) == seen(loaded, table)
    with pytest.raises(ValueError):
        large.transform(df)


def test_csv_files_of_other_headers(spark, tmp_path):
    spec = FeatureSpec(key="id", numeric=("n",), categorical=("a",), target="y")
    for name, text in (("a", "id,n,a,y\n1,2,p,yes\n"), ("b c", "y,a,id,n\nno,q,2,3\n"), ("c", "id,y\n3,yes\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = sorted(map(tuple, read_campaign(spark, str(tmp_path), spec=spec).select("id", "n", "a", "y").collect()))
    assert found == [(1, "2", "p", "yes"), (2, "3", "q", "no"), (3, None, None, "yes")]
    (tmp_path / "d.csv").write_text("id,n\n4,5\n")
    with pytest.raises(ValueError):
        read_campaign(spark, str(tmp_path), spec=spec)


@pytest.mark.parametrize("error", [0.3, 0.02])
def test_summary_ranks(spark, error):
    """Also for one value that holds most rows, negative, tiny and endless values, and merged parts."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.exp((F.col("id") - 1500) / 40.0)).alias("a"), F.sin("id").alias("b"),
                                  F.when(F.col("id") % 2 == 0, float("inf")).when(F.col("id") % 5 == 0, None).otherwise(-F.col("id").cast("double")).alias("c"))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    values = {}
    for r in long_values(df, ["a", "b", "c"]).collect():
        values.setdefault(r["feature"], []).append(r["value"])
    whole = quantile_summary(df, ["a", "b", "c"], error)
    parts = merged([quantile_summary(df.where(F.col("id") % 4 == i), ["a", "b", "c"], error) for i in range(4)])
    for s in (whole, parts):
        for r in summary_quantiles(s, shares).collect():
            known = sorted(values[r["feature"]])
            rank = (len(known) - 1) * r["share"]
            less, upto = sum(v < r["quantile"] for v in known), sum(v <= r["quantile"] for v in known)
            assert max(less - rank, rank - (upto - 1), 0) <= r["rank_error"] <= error * len(known) + 1
