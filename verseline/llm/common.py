"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.session import cut_lineage

__all__ = ["batches", "checkpointed", "document_columns", "field", "fresh", "held_out", "null_safe", "offsets_of", "row_key", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes: a batch of very long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    # operators of several jobs: a job's shuffle files go when it ends, not when the driver next collects garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def field(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, also beside columns that differ from it in case only or hold dots."""
    exact = [c for c in df.columns if c == name]
    return df[exact[0]] if exact else df[name]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def document_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with nulls as empty texts; whatever else the table holds is left behind."""
    return docs.select(field(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(field(docs, "text").cast("string"), F.lit("")).alias("text"))


def row_key(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.col(text))


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str, keep: list[str] | None = None) -> DataFrame:
    """Join in which null keys meet each other; the right side's key columns go."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        e = left[c].eqNullSafe(renamed[f"__r_{c}"])
        cond = e if cond is None else cond & e
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{c}" for c in on])


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder (never a local checkpoint)."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def offsets_of(lengths) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
