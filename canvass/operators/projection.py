"""Projections: target split, label mapping, unknown tokens, column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.sources.tables import require_target
from canvass.spec import CAMPAIGN, FeatureSpec


def without_target(df: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    require_target(df.columns, spec)
    return df.drop(spec.target)


def with_label(df: DataFrame, spec: FeatureSpec = CAMPAIGN, name: str = "label") -> DataFrame:
    """Adds the 0/1 label; a target that is neither word gives null."""
    require_target(df.columns, spec)
    target = F.col(f"`{spec.target}`")
    return df.withColumn(name, F.when(target == spec.positive, 1).when(target == spec.negative, 0))


def labelled(df: DataFrame, spec: FeatureSpec = CAMPAIGN, name: str = "label", strict: bool = False) -> DataFrame:
    """Rows with a usable label; ``strict=True`` fails at run time on any other row."""
    out = with_label(df, spec, name)
    if strict:
        bad = F.raise_error(F.lit(f"target {spec.target} is neither {spec.positive} nor {spec.negative}"))
        return out.withColumn(name, F.when(F.col(name).isNull(), bad.cast("int")).otherwise(F.col(name)))
    return out.where(F.col(name).isNotNull())


def label_quality(df: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    """How many rows have a label, and how many had to be left out."""
    return with_label(df, spec).agg(
        F.count("label").alias("labelled"), F.count_if(F.col("label").isNull()).alias("unlabelled")
    )


def mark_unknown(
    df: DataFrame, tokens: Sequence[str] = ("unknown",), columns: Sequence[str] | None = None
) -> DataFrame:
    """Unknown tokens of string columns become the category ``unknown_<column>``.

    Exact and case-sensitive; other types are left alone.
    """
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    chosen = strings if columns is None else strings & set(columns)

    def expression(name: str):
        value = F.col(f"`{name}`")
        if name not in chosen:
            return value
        return F.when(value.isin(*tokens), F.lit(f"unknown_{name}")).otherwise(value).alias(name)

    return df.select(*[expression(c) for c in df.columns])


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns in the listed order; the rest is dropped (and not scanned)."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
