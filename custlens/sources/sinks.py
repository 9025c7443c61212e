"""Writing results: tables as Parquet, CSV or JSON, and fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

# For writing and for reading back.
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\\N"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result as a folder of part files, one per task.

    CSV gets a header, doubles quotes inside values as most readers expect, and writes nulls as ``\\N``, so that empty
    strings differ from them. Read it back with ``CSV_OPTIONS``.
    """
    writer = df.write.mode(mode)
    (writer.options(**CSV_OPTIONS) if fmt == "csv" else writer).format(fmt).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
