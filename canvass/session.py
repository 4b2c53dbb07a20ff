"""Session helpers: a local session for tests and benches, and shared scratch space."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = 8, app: str = "canvass", memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        # One process only: "local-cluster" has executors of their own.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="canvass-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, "canvass", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back.

    Cuts the lineage, survives executor loss, and gives the planner real file sizes
    to decide on broadcasts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """:func:`materialize`, and the path for :func:`discard`."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; replaces an older one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(place):
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
        overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(draft, place, options)
    else:
        files.rename(draft, place)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


@contextmanager
def without_constraints(spark: SparkSession) -> Iterator[None]:
    """Plan what runs inside without deriving constraints: from long expressions that takes the optimizer seconds a query."""
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """Fitted parameters as a DataFrame.

    The Arrow form becomes a local relation: no Python task, and its size is known to
    the planner.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(declared)
    columns = list(zip(*rows)) if rows else [()] * len(declared.fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    # Nullable fields: Arrow tables built here carry no promise about nulls.
    plain = pa.schema([pa.field(f.name, f.type) for f in arrow])
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=plain))
