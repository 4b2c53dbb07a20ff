"""A corpus pipeline from the operators in canvass/llm.

Each stage takes the documents its predecessor kept, with all their columns, and returns those
that go on; the last returns what training reads.

1. quality rules: documents that a rule rejects go.
2. line dedup: of lines alike over the corpus one stays; documents keep their other lines, and ``n_chars`` follows.
   A document that loses all of its lines stays with an empty text.
3. near-dedup: one document of each group stays, the one with the smallest id.
4. decontamination: documents that hold a benchmark item go.
5. pieces: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

Null texts are rejected by the first stage.  Repeated rows stay repeated up to near-dedup, which keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import decontaminate, fuzzy_lines, near_dup, pieces, quality
from canvass.llm.store import Store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", leak_stage),
    ("sentencepiece", piece_stage),
]
#: SQL has no piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
