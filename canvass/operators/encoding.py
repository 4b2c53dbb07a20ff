"""Feature encoding: exact robust scaling and drop-first indicators, fitted once.

Columns of up to ``INLINE_CATEGORIES`` categories are inlined as literals, so for them the transform stays
one projection without joins.  The vocabulary of a column with more is a table, whatever its size: the
position of a category is found by a join, and a row holds positions instead of a column per category.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.functions.ordered import exact_quantiles
from canvass.functions.summary import quantile_summary, summary_quantiles
from canvass.operators.binning import Layout, array_layout, value_array
from canvass.operators.projection import mark_unknown
from canvass.session import materialize, small_table
from canvass.spec import CAMPAIGN, FeatureSpec

# Categories of a column up to which they are literals (generated code grows with each), and
# indicators that may become columns of their own in the wide form.
INLINE_CATEGORIES = 200
WIDE_INDICATORS = 500

SCALER_SCHEMA = "position int, feature string, center double, scale double"
VOCABULARY_SCHEMA = "feature string, category string, position int, is_baseline boolean"


def robust_parameters(df: DataFrame, columns: Sequence[str], exact: bool = True, error: float = 0.001) -> DataFrame:
    """(position, feature, center, scale): median and interquartile range.

    ``exact=False`` takes quantiles from a summary of fixed size, whose ranks are at most ``error`` of the rows off.
    """
    shares = ((0.25, "q1"), (0.5, "center"), (0.75, "q3"))
    if exact:
        found = exact_quantiles(df, columns, [s for s, _ in shares])
    else:
        found = summary_quantiles(quantile_summary(df, columns, error), [s for s, _ in shares])
    found = found.groupBy("feature").agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in shares])
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    return found.select(
        (order - 1).cast("int").alias("position"), "feature", "center",
        (F.col("q3") - F.col("q1")).alias("scale"),
    )


def distinct_categories(df: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    """(feature, category) after the unknown tokens are marked; null is a category."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in spec.categorical])
    marked = mark_unknown(text, spec.unknown_tokens)
    return marked.unpivot([], list(spec.categorical), "feature", "category").distinct()


def vocabulary(df: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    """Sorted categories per column with their position; the first one is the baseline."""
    ordered = Window.partitionBy("feature").orderBy(F.col("category").asc_nulls_last())
    position = F.row_number().over(ordered) - 1
    return distinct_categories(df, spec).select(
        "feature", "category", position.alias("position"), (position == 0).alias("is_baseline")
    )


def large_vocabulary(words: DataFrame) -> DataFrame:
    """(feature, category, position) of any number of words, sorted without a one-task window.

    Sorted ranges are written with their places inside; a category's position is its place and the sizes
    of the ranges before, less those of the features before.
    """
    order = ["feature", F.col("category").asc_nulls_last()]
    ranges = materialize(
        words.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "feature", "category", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")),
        "vocabulary",
    )
    # One row per range, one per column.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    placed = ranges.join(F.broadcast(offsets), "part").select("feature", "category", (F.col("before") + F.col("place")).alias("place"))
    starts = placed.groupBy("feature").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "feature").select("feature", "category", (F.col("place") - F.col("start")).cast("int").alias("position"))


@dataclass(frozen=True)
class EncoderModel:
    """Fitted encoder: scaler rows (feature, center, scale), and the vocabulary.

    ``categories`` holds the columns with few categories; ``large`` is a table (feature, category, position) of the
    others, ``large_sizes`` their numbers of categories.
    """

    spec: FeatureSpec
    scaler: tuple[tuple[str, float | None, float | None], ...]
    categories: tuple[tuple[str, tuple[str | None, ...]], ...]
    large: DataFrame | None = None
    large_sizes: tuple[tuple[str, int], ...] = ()

    @property
    def feature_names(self) -> list[str]:
        """``num__<column>`` then ``cat__<column>_<category>``, without the baselines."""
        self._refuse_large("feature_names")
        return self.numeric_names + [f"cat__{c}_{_category_name(v)}" for c, v in self._indicators()]

    @property
    def numeric_names(self) -> list[str]:
        return [f"num__{c}" for c in self.spec.numeric]

    def _refuse_large(self, what: str) -> None:
        if self.large_sizes:
            raise ValueError(f"{what} lists every category; use coded() or transform_sparse() with large columns")

    def _indicators(self) -> list[tuple[str, str | None]]:
        found = dict(self.categories)
        return [(c, v) for c in self.spec.categorical for v in found.get(c, ())[1:]]

    def _scaled(self) -> list[Column]:
        found = {f: (center, scale) for f, center, scale in self.scaler}
        out = []
        for c in self.spec.numeric:
            center, scale = found.get(c, (None, None))
            divisor = 1.0 if scale == 0 else scale
            out.append((F.col(f"`{c}`").cast("double") - F.lit(center)) / F.lit(divisor))
        return out

    def _words(self, column: str, value: str | None) -> list[str]:
        """Raw values that mean a category: unknown tokens mean ``unknown_<column>``."""
        if value is None:
            return []
        tokens = self.spec.unknown_tokens if value == f"unknown_{column}" else ()
        return [value, *tokens]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and one double column per feature; an unseen category is all 0."""
        names, indicators = self.feature_names, self._indicators()
        if len(indicators) > WIDE_INDICATORS:
            raise ValueError(f"{len(indicators)} indicator columns; use coded() or transform_sparse() for more than {WIDE_INDICATORS}")
        columns = [e.alias(n) for e, n in zip(self._scaled(), names)]
        for (column, value), name in zip(indicators, names[len(columns):]):
            here = F.col(f"`{column}`")
            hit = here.isNull() if value is None else here.isin(*self._words(column, value))
            columns.append(F.when(hit, 1.0).otherwise(0.0).alias(name))
        return df.select(*[F.col(f"`{k}`") for k in keep], *columns)

    def _positions(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """``df``, joined with the large vocabularies, and the position of each categorical column; null if unseen."""
        found, positions = dict(self.categories), {}
        sizes = dict(self.large_sizes)
        for i, column in enumerate(self.spec.categorical):
            here = F.col(f"`{column}`")
            if column in sizes:
                words = self.large.where(F.col("feature") == column).select(F.col("category").alias(f"_word{i}"), F.col("position").alias(f"_position{i}"))
                meant = here.cast("string")
                for token in self.spec.unknown_tokens:
                    meant = F.when(here == token, f"unknown_{column}").otherwise(meant)
                # A category that holds most rows is split by adaptive execution, small vocabularies are broadcast by the planner.
                df = df.join(words, meant.eqNullSafe(F.col(f"_word{i}")), "left")
                positions[column] = F.col(f"_position{i}")
                continue
            values = found.get(column, ())
            lookup = {w: p for p, v in enumerate(values) for w in self._words(column, v)}
            index = F.try_element_at(F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair]), here.cast("string")) if lookup else F.lit(None).cast("int")
            if None in values:
                index = F.when(here.isNull(), values.index(None)).otherwise(index)
            positions[column] = index
        return df, positions

    def coded(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and ``x``: scaled numbers, then per categorical column the category's position, 0 for baseline and unseen ones."""
        joined, positions = self._positions(df)
        return joined.select(*[F.col(f"`{k}`") for k in keep], value_array(self._scaled(), [positions[c] for c in self.spec.categorical]))

    def features(self, spark: SparkSession) -> DataFrame:
        """(column, value, feature): the place in ``x`` and the number of every feature; value is null for numeric ones."""
        start = len(self.spec.numeric)
        rows = [(i, None, n) for i, n in enumerate(self.numeric_names)]
        found = dict(self.categories)
        rows += [
            (start + i, float(p), f"cat__{c}_{_category_name(v)}")
            for i, c in enumerate(self.spec.categorical) for p, v in enumerate(found.get(c, ())) if p
        ]
        out = small_table(spark, rows, "column int, value double, feature string")
        if self.large is None:
            return out
        number = F.array_position(F.array(*[F.lit(c) for c in self.spec.categorical]), F.col("feature")) - 1 + start
        name = F.concat(F.lit("cat__"), "feature", F.lit("_"), F.coalesce("category", F.lit("nan")))
        return out.unionByName(self.large.where("position > 0").select(
            number.cast("int").alias("column"), F.col("position").cast("double").alias("value"), name.alias("feature")))

    def layout(self, coded: DataFrame) -> Layout:
        """The layout of rows from :meth:`coded`; their values are the possible splits."""
        return array_layout(coded, self.numeric_names, self.spec.categorical, self.features(coded.sparkSession).where("value IS NOT NULL"))

    def placed(self, nodes: DataFrame) -> DataFrame:
        """A node table with the places of its features in ``x``."""
        return nodes.join(self.features(nodes.sparkSession), "feature", "left")

    def transform_sparse(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and ``features``: map from feature position to non-zero value.

        One lookup per categorical column, however many categories it has.
        """
        start = len(self.spec.numeric)
        entries = [
            F.struct(F.lit(i).alias("key"), e.alias("value")) for i, e in enumerate(self._scaled())
        ]
        joined, positions = self._positions(df)
        sizes = {c: len(v) for c, v in self.categories} | dict(self.large_sizes)
        for column in self.spec.categorical:
            position = positions[column]
            entries.append(F.when(position > 0, F.struct((position + (start - 1)).alias("key"), F.lit(1.0).alias("value"))))
            start += max(sizes.get(column, 0) - 1, 0)
        nonzero = F.filter(F.array_compact(F.array(*entries)), lambda e: e["value"] != 0)
        return joined.select(
            *[F.col(f"`{k}`") for k in keep], F.map_from_entries(nonzero).alias("features")
        )

    def unseen_categories(self, df: DataFrame) -> DataFrame:
        """(feature, rows, unseen): rows whose category was not seen at fit time."""
        joined, positions = self._positions(df)
        counts = [F.count_if(positions[c].isNull()).alias(c) for c in self.spec.categorical]
        totals = joined.agg(F.count("*").alias("_rows"), *counts)
        return totals.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col("_rows").alias("rows"), F.col(f"`{c}`").alias("unseen"))
            for c in self.spec.categorical
        ])))

    def scaler_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, c, s) for i, (f, c, s) in enumerate(self.scaler)]
        return small_table(spark, rows, SCALER_SCHEMA)

    def vocabulary_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, v, i, i == 0) for f, values in self.categories for i, v in enumerate(values)]
        out = small_table(spark, rows, VOCABULARY_SCHEMA).coalesce(1)
        return out if self.large is None else out.unionByName(self.large.withColumn("is_baseline", F.col("position") == 0))

    def names_table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, list(enumerate(self.feature_names)), "position int, feature string")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        self.scaler_table(spark).coalesce(1).write.mode(mode).parquet(os.path.join(path, "scaler_params"))
        self.vocabulary_table(spark).write.mode(mode).parquet(os.path.join(path, "vocab"))


def _category_name(value: str | None) -> str:
    return "nan" if value is None else value


def _model(spec: FeatureSpec, scaler_rows, words: DataFrame) -> EncoderModel:
    """``words``: (feature, category, position), position null where it is still to be found."""
    sizes = {r["feature"]: r["count"] for r in words.groupBy("feature").count().collect()}  # one row per column
    many = sorted(c for c, n in sizes.items() if n > INLINE_CATEGORIES)
    few = [c for c in sizes if c not in many]
    by_feature: dict[str, list] = {}
    # INLINE_CATEGORIES rows per column, at most.
    for r in words.where(F.col("feature").isin(few)).select("feature", "category").collect() if few else []:
        by_feature.setdefault(r["feature"], []).append(r["category"])
    # Spark orders strings by their UTF-8 bytes; nulls come last.
    categories = tuple((c, tuple(sorted(by_feature.get(c, ()), key=lambda v: (v is None, (v or "").encode())))) for c in spec.categorical if c not in many)
    scaler = tuple((r["feature"], r["center"], r["scale"]) for r in sorted(scaler_rows, key=lambda r: r["position"]))
    if not many:
        return EncoderModel(spec, scaler, categories)
    large = words.where(F.col("feature").isin(many))
    if "position" in words.columns:
        large = large.select("feature", "category", "position")
    else:
        large = materialize(large_vocabulary(large), "large-vocabulary")
    return EncoderModel(spec, scaler, categories, large, tuple((c, sizes[c]) for c in many))


def fit_encoder(df: DataFrame, spec: FeatureSpec = CAMPAIGN, exact: bool = True) -> EncoderModel:
    """What reaches the driver is columns and the categories of columns that have few."""
    words = materialize(distinct_categories(df, spec), "words")
    return _model(spec, robust_parameters(df, spec.numeric, exact).collect(), words)


def load_encoder(spark: SparkSession, path: str, spec: FeatureSpec = CAMPAIGN) -> EncoderModel:
    """All that was saved; a missing path raises Spark's ``AnalysisException``."""
    scaler = spark.read.parquet(os.path.join(path, "scaler_params"))
    return _model(spec, scaler.collect(), spark.read.parquet(os.path.join(path, "vocab")))
