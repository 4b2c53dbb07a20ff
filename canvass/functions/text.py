"""Scalar expressions: number and time text, labels, document fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def fixed4(value: Column) -> Column:
    """Text with four decimals (half-even on the exact binary value, no grouping)."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.0000"))


def percent2(value: Column) -> Column:
    """Fraction as a percentage with two decimals, without the sign."""
    return F.call_function("format_number", value.cast("double") * 100, F.lit("0.00"))


def timestamp_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a zone-less timestamp.

    The plain cast does not pass through the session time zone, as ``date_format`` would.
    """
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19)


def iso_text(ts: Column) -> Column:
    """ISO form with ``T``; fraction digits are kept when there are any."""
    return F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))


def parse_iso(text: Column) -> Column:
    return F.replace(text, F.lit("T"), F.lit(" ")).cast("timestamp_ntz")


def field_or_zero(document: Column, name: str) -> Column:
    """Number at a top-level field of a JSON document, 0 when missing."""
    value = F.get_json_object(document, f"$.{name}")
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def to_number(text: Column) -> Column:
    """Number in a text, null when the text is not a plain decimal number."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def title_label(name: Column) -> Column:
    """``f1_score`` -> ``F1 Score``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def class_name(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("yes")).otherwise(F.lit("no"))


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week, as a zone-less timestamp."""
    return F.trunc(F.to_date(ts), "week").cast("timestamp_ntz")
