"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The words of a text as the size of a document counts them.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores as keep it clear of the columns of ``df`` (which ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, also where the name holds a dot."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that no model may learn from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, Spark hands ``rows`` rows at a time to Python. For jobs that end inside only."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
