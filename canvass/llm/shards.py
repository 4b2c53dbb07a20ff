"""Shuffled shards of a table by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash of id, text digest and place in the
input, so that copies and repeated ids spread too.  There are so many buckets that one is about
``BUCKET_BYTES`` at most, and several for each shuffle task.  Pass two permutes each bucket in
memory (Fisher-Yates, seeded by the bucket) and writes it.  The buckets in order are the shuffled
table; row ``k`` of it goes to shard ``k mod shards``, so shard sizes differ by one row at most.

A null text has no bytes.  Repeated rows are rows of their own.  An empty table gives an empty
result.  All columns are passed on; those of the result are added after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.store import Store

BUCKET_BYTES = 64 << 20
#: Buckets for each shuffle partition at least, so that tasks get even shares.
PER_TASK = 16


def _permute(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket = table.column("__bucket")[0].as_py()
        order = pc.sort_indices(table, sort_keys=[("__order", "ascending"), ("__crc", "ascending")]).to_numpy()
        at = np.arange(len(order))
        draw = np.random.default_rng([seed, bucket])
        # Fisher-Yates: each place swaps with a random earlier one or itself.
        picks = draw.integers(0, np.arange(len(at)) + 1)
        for i in range(len(at) - 1, 0, -1):
            j = picks[i]
            at[i], at[j] = at[j], at[i]
        out = table.take(pa.array(order[at]))
        return out.append_column("__place", pa.array(np.arange(len(at)), pa.int64()))

    return run


def shuffle_rows(rows: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The written buckets, and ``(__bucket, __base)``: the rows in all buckets before."""
    spark = rows.sparkSession
    store = Store(spark, "shards")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    total = rows.agg(F.sum(size)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-total // BUCKET_BYTES), PER_TASK * tasks)
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own = rows.withColumns({"__size": size, "__crc": crc, "__order": F.xxhash64(F.lit(seed), id_col, crc, F.monotonically_increasing_id())})
    own = own.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__order"), F.lit(buckets)))
    schema = T.StructType(own.schema.fields + [T.StructField("__place", T.LongType())])
    done = store.put(own.groupBy("__bucket").applyInArrow(_permute(seed), schema), "buckets")
    counts = done.groupBy("__bucket").agg(F.count("*").alias("n"))
    # Running totals in two steps: within blocks of buckets, then over the blocks.
    step = 1 << 12
    blocks = counts.groupBy(F.floor(F.col("__bucket") / step).alias("block")).agg(F.sum("n").alias("b"))
    before = blocks.select("block", (F.sum("b").over(Window.orderBy("block")) - F.col("b")).alias("before"))
    within = Window.partitionBy("block").orderBy("__bucket")
    base = counts.withColumn("block", F.floor(F.col("__bucket") / step)).withColumn("inner", F.sum("n").over(within) - F.col("n"))
    return done, store.put(base.join(before, "block").select("__bucket", (F.col("inner") + F.col("before")).alias("__base")), "bases")


def shards(rows: DataFrame, count: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    done, bases = shuffle_rows(rows, seed, id_col, text_col)
    at = F.col("__base") + F.col("__place")
    placed = done.join(bases, "__bucket")
    new = {"size": F.col("__size"), "text_crc32": F.col("__crc"), "shard": (at % count).cast("int"), "slot": F.floor(at / count)}
    return placed.select(*[c for c in rows.columns if c not in new], *[e.alias(n) for n, e in new.items()])


def write_shards(rows: DataFrame, path: str, count: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One folder per shard, rows in slot order within each file."""
    out = shards(rows, count, seed, id_col, text_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
