"""From raw documents to token ids: drop poor texts, exact copies, near-duplicates
and benchmark leaks, then encode what is left.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all
but the last return the columns they were given. Every row has a decision of its own
in each filtering stage, also where ids are null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askloom.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from askloom.llm.queries import fresh_index
from askloom.session import land, spread


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_row(docs, fresh_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe encoding and decoding", encode_tokens),
]

# The classifier and the near-duplicate groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, spread(docs), sf_dir)
