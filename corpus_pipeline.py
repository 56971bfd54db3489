"""The stages that turn raw documents into packed training sequences.

Each stage reads what the one before it wrote. Documents in no language that can be told go, then exact copies,
near copies and documents that hold an item of the benchmark; what stays is packed into sequences of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazmeter.llm import common, decontaminate, exact_dedup, language_id, near_copies, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, decontaminate.benchmark(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", clean), ("pack", packed)]

#: Models, fingerprints and tokens are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
