"""Jobs: train and select, evaluate on the hold-out, score requests."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from canvass.operators.encoding import EncoderModel, fit_encoder, load_encoder
from canvass.operators.evaluation import curve_rows, metrics_bundle
from canvass.operators.grid import Grid, best_candidate, candidate_table, rank_candidates, search_arrays
from canvass.operators.projection import labelled
from canvass.operators.splitting import split_thresholds, stratified_split
from canvass.operators.tree import WIDE_CELL, TreeSetting, grow_arrays, load_tree, node_table, save_tree, score_arrays
from canvass.operators.validation import accepted, check, probability_valid, quarantined
from canvass.session import discard, exists, materialize, written
from canvass.sources.history import append_metrics, metrics_records, new_run, prediction_records, write_together
from canvass.spec import CAMPAIGN, CV_FOLDS, DEFAULT_MODEL_NAME, SPLIT_SEED, TEST_SHARE, FeatureSpec


@dataclass(frozen=True)
class Model:
    """A fitted encoder and the node table of the selected tree; and ``split``, where its training part ended.

    ``split`` has one row per class, as of ``split_thresholds``: with it an evaluation finds the held-out rows by comparing
    hashes, without counting the table again.
    """

    encoder: EncoderModel
    nodes: DataFrame
    split: DataFrame | None = None

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.encoder.save(self.nodes.sparkSession, os.path.join(path, "encoder"), mode)
        save_tree(self.nodes, os.path.join(path, "tree"), mode)
        if self.split is not None:
            self.split.coalesce(1).write.mode(mode).parquet(os.path.join(path, "split"))

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return score_arrays(self.encoder.coded(df, keep=keep), self.encoder.placed(self.nodes), keep)


def load_model(spark: SparkSession, path: str, spec: FeatureSpec = CAMPAIGN) -> Model:
    split = os.path.join(path, "split")
    return Model(
        load_encoder(spark, os.path.join(path, "encoder"), spec), load_tree(spark, os.path.join(path, "tree")),
        spark.read.parquet(split) if exists(spark, split) else None,
    )


@dataclass(frozen=True)
class Training:
    model: Model
    best: dict
    candidates: DataFrame  # candidate parameters with their scores
    holdout: DataFrame  # one metrics document, from the test part


def few_leaves(nodes: DataFrame) -> bool:
    """The scores of the tree fit into one window group."""
    return nodes.where("feature IS NULL").count() < WIDE_CELL


def split_kinds(encoder: EncoderModel) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the indicator features."""
    names = encoder.feature_names
    n = len(encoder.spec.numeric)
    return names[:n], names[n:]


def train_and_select(
    df: DataFrame,
    spec: FeatureSpec = CAMPAIGN,
    grid: Grid | None = None,
    folds: int = CV_FOLDS,
    test_share: float = TEST_SHARE,
    seed: int = SPLIT_SEED,
    fit_on: str = "all",
    model_name: str = DEFAULT_MODEL_NAME,
    timestamp: str | None = None,
) -> Training:
    """Encode, split, search the grid by cross-validated ROC-AUC, refit, test.

    ``fit_on="all"`` fits the encoder before the split, as existing models were;
    ``"train"`` keeps the test part out of it.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    grid = grid or Grid()
    # Written once: split, encoder and encoding read it again and again.
    usable = materialize(labelled(df, spec), "labelled")
    # Two rows.
    split = materialize(split_thresholds(usable, spec.key, share=test_share, seed=seed), "split")
    parts = stratified_split(usable, spec.key, seed=seed, edges=split)
    encoder = fit_encoder(usable if fit_on == "all" else parts.where(F.col("part") == "train"), spec)
    # Written once: the search, the refit and the test read it again and again.
    encoded = materialize(encoder.coded(parts, keep=[spec.key, "label", "part"]), "encoded")
    train = encoded.where(F.col("part") == "train")
    scores, forest = search_arrays(train, spec.key, encoder.layout(train), grid, folds=folds, seed=seed)
    ranked = materialize(rank_candidates(scores), "candidates")
    winner = best_candidate(ranked).first()["candidate"]
    best = next(c for c in grid.candidates() if c["candidate"] == winner)
    setting = TreeSetting(best["criterion"], best["balanced"], best["min_leaf"])
    refit = grow_arrays(train, forest.layout, [setting], max_depth=best["max_depth"], min_split=best["min_split"])
    nodes = node_table(refit)
    test = score_arrays(encoded.where(F.col("part") == "test"), encoder.placed(nodes), keep=["label"])
    holdout = metrics_bundle(test, model_name=model_name, timestamp=timestamp, few_scores=few_leaves(nodes))
    candidates = candidate_table(df.sparkSession, grid).join(ranked, "candidate")
    return Training(Model(encoder, nodes, split), best, candidates, holdout)


def evaluate_holdout(
    df: DataFrame,
    model: Model,
    spec: FeatureSpec = CAMPAIGN,
    test_share: float = TEST_SHARE,
    seed: int = SPLIT_SEED,
    model_name: str = DEFAULT_MODEL_NAME,
    timestamp: str | None = None,
    history_path: str | None = None,
    curves_path: str | None = None,
) -> DataFrame:
    """Find the same test part again, by the split kept with the model if there is one, score it, evaluate it, append to the history.

    The points of the curves go to ``curves_path`` as rows with the id of the run.
    """
    parts = stratified_split(labelled(df, spec), spec.key, share=test_share, seed=seed, edges=model.split)
    test = model.score(parts.where(F.col("part") == "test"), keep=["label"])
    few = few_leaves(model.nodes)
    bundle = metrics_bundle(test, model_name=model_name, timestamp=timestamp, few_scores=few)
    if history_path:
        records = materialize(metrics_records(bundle), "metrics")
        if curves_path:
            append_metrics(curve_rows(test, few_scores=few).join(F.broadcast(records.select("id")), how="cross"), curves_path)
        append_metrics(records, history_path)
    return bundle


def score_requests(
    requests: DataFrame,
    model: Model,
    spec: FeatureSpec = CAMPAIGN,
    strict_domains: bool = False,
    created_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(history records of valid requests, quarantined requests).  One narrow stage.

    A failing history write fails the job; it is not swallowed.
    """
    return score_checked(check(requests, spec, strict_domains), model, spec, created_at)


def score_checked(
    checked: DataFrame, model: Model, spec: FeatureSpec = CAMPAIGN, created_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """:func:`score_requests` for requests that have been checked."""
    keep = [spec.key, *spec.inputs, *([created_at] if created_at else [])]
    scored = model.score(accepted(checked, spec), keep=keep)
    # No record leaves with a probability out of range: the job fails instead.
    refused = F.raise_error(F.lit("probability out of range")).cast("double")
    scored = scored.withColumn("p", F.when(probability_valid(F.col("p")), F.col("p")).otherwise(refused))
    return prediction_records(scored, spec, created_at=created_at), quarantined(checked)


def scoring_job(
    requests: DataFrame, model: Model, history_path: str, quarantine_path: str | None = None,
    spec: FeatureSpec = CAMPAIGN, created_at: str | None = None, grain: str = "day",
) -> None:
    """Validate, score and append a batch of requests."""
    score_batch(requests, model, history_path, quarantine_path, new_run(), 0, spec, created_at, grain)


def score_batch(
    requests: DataFrame, model: Model, history_path: str, quarantine_path: str | None, run: str, batch_id: int,
    spec: FeatureSpec = CAMPAIGN, created_at: str | None = None, grain: str = "day",
) -> None:
    """One batch: the source is read and checked once, what is scored and what is rejected commit together."""
    checked, path = written(check(requests, spec), "checked")
    records, rejected = score_checked(checked, model, spec, created_at)
    outputs = [(records, history_path)] + ([(rejected, quarantine_path)] if quarantine_path else [])
    write_together(outputs, run, batch_id, grain)
    discard(requests.sparkSession, path)
