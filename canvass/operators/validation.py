"""Row validation: coercion, required, range and domain rules; accept or quarantine.

Each input column yields at most one violation, the first of: missing, type, range,
domain.  Validation adds no shuffle: one compact predicate decides on a row, and the
details are worked out for the rejected rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.text import to_number
from canvass.spec import CAMPAIGN, FeatureSpec, FieldRule

# A whole number in a text; zero decimals are fine.
_WHOLE = r"^\s*([+-]?[0-9]+)(\.0*)?\s*$"


def _coerced(rule: FieldRule, have: T.DataType) -> Column:
    """The column in its declared type, null when the value does not fit it."""
    value = F.col(f"`{rule.name}`")
    is_text = isinstance(have, T.StringType)
    if rule.kind == "str":
        return value.cast("string")
    if rule.kind == "float":
        return to_number(value) if is_text else value.cast("double")
    if is_text:
        return F.regexp_extract(value, _WHOLE, 1).try_cast("int")
    if isinstance(have, (T.ByteType, T.ShortType, T.IntegerType)):
        return value.cast("int")
    whole = value.try_cast("int")
    return F.when(whole == value, whole)


def _allowed(rule: FieldRule, strict_domains: bool) -> tuple[str, ...]:
    return rule.allowed or (rule.documented if strict_domains else ())


def _is_fine(rule: FieldRule, value: Column, strict_domains: bool) -> Column:
    tests = [value.isNotNull()]
    if rule.minimum is not None:
        tests.append(value >= rule.minimum)
    if rule.maximum is not None:
        tests.append(value <= rule.maximum)
    if _allowed(rule, strict_domains):
        tests.append(value.isin(*_allowed(rule, strict_domains)))
    # The later tests are null for a missing value, so they imply the first one.
    return reduce(lambda a, b: a & b, tests[1:] or tests)


def _violation(rule: FieldRule, value: Column, strict_domains: bool) -> Column:
    """Kind of the violation of one column, null when it is fine."""
    kind = F.when(F.col(f"`{rule.name}`").isNull(), "missing").when(value.isNull(), "type")
    if rule.minimum is not None:
        kind = kind.when(value < rule.minimum, "range")
    if rule.maximum is not None:
        kind = kind.when(value > rule.maximum, "range")
    if _allowed(rule, strict_domains):
        kind = kind.when(~value.isin(*_allowed(rule, strict_domains)), "domain")
    return kind


def check(df: DataFrame, spec: FeatureSpec = CAMPAIGN, strict_domains: bool = False) -> DataFrame:
    """Adds ``valid``, ``typed`` (struct of the coerced inputs) and ``violations``.

    ``violations`` is an array of (rule, kind); the rule is named after its column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [r.name for r in spec.rules if r.name not in types]
    if missing:
        raise ValueError(f"input columns missing from the table: {missing}")
    values = {r.name: _coerced(r, types[r.name]) for r in spec.rules}
    fine = [_is_fine(r, values[r.name], strict_domains) for r in spec.rules]
    # One predicate as a whole: split into its many conjuncts, it would cost the optimizer
    # seconds to derive constraints from every one of them.
    valid = F.coalesce(reduce(lambda a, b: a & b, fine), F.lit(False))
    # The coerced columns get a projection of their own: they are used several times.
    typed = df.select(
        "*",
        valid.alias("valid"),
        *[v.alias(f"_typed_{name}") for name, v in values.items()],
    )
    kinds = [_violation(r, F.col(f"_typed_{r.name}"), strict_domains).alias(f"_kind_{r.name}") for r in spec.rules]
    found = [
        F.when(F.col(f"_kind_{r.name}").isNotNull(), F.struct(F.lit(r.name).alias("rule"), F.col(f"_kind_{r.name}").alias("kind")))
        for r in spec.rules
    ]
    return typed.select("*", *kinds).select(
        *[F.col(f"`{c}`") for c in df.columns],
        "valid",
        F.struct(*[F.col(f"_typed_{r.name}").alias(r.name) for r in spec.rules]).alias("typed"),
        F.array_compact(F.array(*found)).alias("violations"),
    )


def _others(df: DataFrame, spec: FeatureSpec) -> list[str]:
    names = {r.name for r in spec.rules} | {"valid", "typed", "violations"}
    return [c for c in df.columns if c not in names]


def accepted(checked: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    """Valid rows with their inputs in declared types."""
    return checked.where("valid").select(*_others(checked, spec), "typed.*")


def quarantined(checked: DataFrame) -> DataFrame:
    """Invalid rows as they came, with their violations."""
    return checked.where("NOT valid").drop("typed", "valid")


def violation_rows(checked: DataFrame, key: str) -> DataFrame:
    """One row per violated rule of a row."""
    # Rejected rows have a violation, so outer changes nothing but spares the planner a
    # filter on the size of the whole array expression.
    return checked.where("NOT valid").select(key, F.inline_outer("violations"))


def violation_counts(checked: DataFrame) -> DataFrame:
    return (
        checked.where("NOT valid").select(F.inline_outer("violations")).groupBy("rule", "kind").agg(F.count("*").alias("n"))
    )


def probability_valid(p: Column) -> Column:
    """Output invariant: 0 <= p <= 1, and present."""
    return F.coalesce((p >= 0) & (p <= 1), F.lit(False))
