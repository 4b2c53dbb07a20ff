"""A fixed-size bitmap of ids, to leave rows that cannot match out of a shuffle.

The bitmap has ``SLOTS`` rows of 63 bits at most, whatever the number of ids; so its broadcast is
bounded (a few MB).  A full bitmap lets every row pass and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17


def _place(ident: Column) -> tuple[Column, Column]:
    h = F.xxhash64(ident)
    return F.pmod(h, F.lit(SLOTS)), F.pmod(F.shiftright(h, 32), F.lit(63)).cast("int")


def bitmap(ids: DataFrame) -> DataFrame:
    """Bitmap of the only column of ``ids``."""
    slot, bit = _place(F.col(ids.columns[0]))
    return ids.select(slot.alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__slot").agg(
        F.bit_or("__bit").alias("__bits"))


def marked(rows: DataFrame, ident: str, bits: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``__hit``: false only if the id is not in the bitmap."""
    slot, bit = _place(F.col(ident))
    out = rows.withColumn("__slot", slot).withColumn("__at", bit).join(F.broadcast(bits), "__slot", "left")
    hit = F.coalesce(F.call_function("shiftright", F.col("__bits"), F.col("__at")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return out.withColumn("__hit", hit).drop("__slot", "__at", "__bits")
