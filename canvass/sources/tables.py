"""Sources: campaign tables from files, and the campaign view over the warehouse tables."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.spec import CAMPAIGN, FeatureSpec

FORMATS = ("csv", "parquet", "json")


def read_campaign(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    spec: FeatureSpec = CAMPAIGN,
    key_type: T.DataType | None = T.LongType(),
) -> DataFrame:
    """Scan a campaign table with its declared schema (no inference pass).

    A missing path raises Spark's ``AnalysisException`` when the plan is built; a missing
    target column raises ``ValueError`` before any job runs.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    if fmt == "csv":
        return _read_csv(spark, path, spec, key_type)
    if fmt == "json":
        df = spark.read.schema(spec.table_schema(key_type)).json(path)
        # A declared schema always has the column; what counts is whether any document does.
        if not df.isEmpty() and df.where(F.col(spec.target).isNotNull()).isEmpty():
            raise ValueError(f"column {spec.target!r} is not in the table")
    else:
        df = spark.read.parquet(path)
    require_target(df.columns, spec)
    return df


def _read_csv(spark: SparkSession, path: str, spec: FeatureSpec, key_type: T.DataType | None) -> DataFrame:
    """Files grouped by their header, each group read in its own order of columns and put together by name.

    A column that a file lacks is null in its rows.  Headers are found in one pass over the first line of every file;
    one row per different header reaches the driver, with the paths of its files.
    """
    lines = spark.read.option("wholetext", False).text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    first = lines.where("start = 0").withColumn("row", F.monotonically_increasing_id())
    headers = first.groupBy("file").agg(F.min_by("value", "row").alias("header")).groupBy("header").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("header").collect()
    if not headers:
        raise ValueError(f"column {spec.target!r} is not in the table")
    declared = {f.name: f for f in spec.table_schema(key_type).fields}
    groups, names = [], []
    for r in headers:
        files = [unquote(f) for f in r["files"]]
        header = spark.read.option("header", True).csv(files[0]).columns
        require_target(header, spec)
        schema = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
        # Spark compares the header of every file with the schema.
        groups.append(spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files))
        names += [c for c in header if c not in names]
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in names])


def read_requests(
    spark: SparkSession, path: str, spec: FeatureSpec = CAMPAIGN, stream: bool = False,
    key_type: T.DataType | None = T.LongType(),
) -> DataFrame:
    """Scoring requests as JSON documents, one row each.

    Values stay text at the edge, so that validation can report what does not parse.
    """
    reader = spark.readStream if stream else spark.read
    return reader.schema(spec.text_schema(key_type)).json(path)


def require_target(columns: Sequence[str], spec: FeatureSpec = CAMPAIGN) -> None:
    if spec.target not in columns:
        raise ValueError(f"column {spec.target!r} is not in the table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(index: Column, values: Sequence[str], default: str) -> Column:
    """Value at a small integer index, ``default`` beyond the list."""
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, v) if out is None else out.when(index == i, v)
    return out.otherwise(default)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign contact per order, joined to its customer."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    rank = F.substring("o_orderpriority", 1, 1)
    first_contact = ok % 3 == 0
    won_before = ~first_contact & rank.isin("1", "2")
    lucky = F.substring(F.md5(ok.cast("string").cast("binary")), 1, 1).isin("0", "1", "2", "3")

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    signals = (
        one(F.col("o_totalprice") >= 250000) + one(won_before)
        + one(F.col("o_orderstatus") == "F") + one(lucky)
    )

    def yes(condition: Column) -> Column:
        return F.when(condition, "yes").otherwise("no")

    return orders.join(customer, ck == F.col("c_custkey")).select(
        ok.alias("contact_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("contact_ts"),
        (18 + (ck * 7 + 3) % 70).cast("int").alias("age"),
        _pick(ck % 12, CAMPAIGN_JOBS_BY_INDEX, "unknown").alias("job"),
        _pick(F.col("c_nationkey") % 3, ("single", "married"), "divorced").alias("marital"),
        _pick((ck + F.col("c_nationkey")) % 4, ("primary", "secondary", "tertiary"), "unknown").alias("education"),
        yes(ok % 50 == 0).alias("default"),
        F.col("c_acctbal").alias("balance"),
        yes(ck % 2 == 0).alias("housing"),
        yes(F.col("c_mktsegment") == "BUILDING").alias("loan"),
        F.when(F.col("o_orderstatus") == "F", "cellular")
        .when(F.col("o_orderstatus") == "O", "telephone").otherwise("unknown").alias("contact"),
        F.dayofmonth("o_orderdate").cast("int").alias("day"),
        _pick(F.month("o_orderdate") - 1, MONTHS_BUT_LAST, "dec").alias("month"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("duration"),
        (1 + ok % 5).cast("int").alias("campaign"),
        F.when(first_contact, -1).otherwise(1 + ok % 400).cast("int").alias("pdays"),
        F.when(first_contact, 0).otherwise(1 + ok % 4).cast("int").alias("previous"),
        F.when(first_contact, "unknown").when(won_before, "success")
        .when(rank == "3", "other").otherwise("failure").alias("poutcome"),
        yes(signals >= 2).alias("deposit"),
    )


CAMPAIGN_JOBS_BY_INDEX = next(r.documented for r in CAMPAIGN.rules if r.name == "job")[:-1]
MONTHS_BUT_LAST = next(r.documented for r in CAMPAIGN.rules if r.name == "month")[:-1]


def scorecard(df: DataFrame) -> DataFrame:
    """Fixed points score of a contact: label, probability, prediction (tie -> 0)."""
    points = (
        F.when(F.col("duration") >= 2000, 3).otherwise(0)
        + F.when(F.col("poutcome") == "success", 2).otherwise(0)
        + F.when(F.col("contact") == "cellular", 2).otherwise(0)
        + F.when(F.col("age") < 40, 1).otherwise(0)
    )
    return df.select(
        "*",
        F.when(F.col("deposit") == "yes", 1).otherwise(0).alias("label"),
        (points / F.lit(8.0)).alias("p"),
    ).withColumn("prediction", F.when(F.col("p") > 0.5, 1).otherwise(0))


def raw_requests(df: DataFrame, spec: FeatureSpec = CAMPAIGN) -> DataFrame:
    """Contacts as text requests, some of them spoilt by rules on the key.

    Gives validation something to reject: out-of-range ages, numbers that do not parse,
    values outside a domain, missing fields.
    """
    key = F.col(spec.key)
    text = {c: F.col(c).cast("string") for c in spec.inputs}
    text["age"] = F.when(key % 97 == 0, "200").when(key % 89 == 0, "abc").otherwise(text["age"])
    text["balance"] = F.when(key % 61 == 0, "12,5").otherwise(text["balance"])
    text["marital"] = F.when(key % 83 == 0, "widowed").otherwise(text["marital"])
    text["day"] = F.when(key % 71 == 0, "0").otherwise(text["day"])
    text["campaign"] = F.when(key % 79 == 0, "2.5").otherwise(text["campaign"])
    text["job"] = F.when(key % 101 == 0, F.lit(None)).otherwise(text["job"])
    return df.select(key, *[text[c].alias(c) for c in spec.inputs])
