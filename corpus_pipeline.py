"""The corpus pipeline: stages that turn raw documents into packed training sequences.

Every stage takes the whole output of the one before and returns the columns of documents, but for the last, which places every document in
training sequences. Documents that the classifier scores as toxic, all but one of each group of near-duplicates, and documents that hold a
benchmark item go; secrets are replaced by a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verseline.llm import decontaminate, packing, secrets, simhash, toxicity
from verseline.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold (operator 6); the model learns from the labelled rows of the raw table."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 4, and bands of minima for the copies it cannot link; links verified exactly)."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 3)."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret (operator 8)."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence (operator 5)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mark_secrets),
    ("packing", pack),
]

#: SQL cannot express a learned classifier or the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
