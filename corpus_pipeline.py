"""A corpus pipeline over documents: each stage reads what the stage before it wrote.

Stages keep all columns of their input (the last gives pieces), whatever their names; an empty table gives empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridquarry.llm import dedup, jaccard, language, mixing, packing
from gridquarry.llm.common import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be made out: null, empty and letterless texts, and those of whose n-grams a
    share below 0.1 belongs to the best language. Labels come from documents themselves. Repeated rows fare alike."""
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are equal but for A-Z in capitals: that of the smallest doc_id, null last."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of similar texts join: that of the smallest doc_id, null last."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents to meet the sources' target weights. A null source is one more source, the last."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048 tokens, with their place. Null texts count as empty."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express language identification; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
