"""Table profiles: shape, types, missing values and first rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating-point column."""
    floating = isinstance(df.schema[column].dataType, (DoubleType, FloatType))
    return F.col(column).isNull() | F.isnan(column) if floating else F.col(column).isNull()


def null_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Rows ``(column_name, data_type, position, n_rows, null_count, null_pct)`` from one pass over the table."""
    counts = df.agg(
        F.count("*").alias("n_rows"), *(F.count_if(missing(df, c)).alias(c) for c in df.columns)
    ).unpivot("n_rows", list(df.columns), "column_name", "null_count")
    kinds = F.create_map(*(F.lit(word) for pair in df.dtypes for word in pair))
    places = F.array(*(F.lit(c) for c in df.columns))
    profile = (
        counts.withColumn(
            "null_pct", F.when(F.col("n_rows") > 0, F.col("null_count") * 100.0 / F.col("n_rows")).cast("double")
        )
        .withColumn("data_type", F.element_at(kinds, F.col("column_name")))
        .withColumn("position", F.array_position(places, F.col("column_name")).cast("int"))
    )
    return profile.where(F.col("null_count") > 0) if only_missing else profile


def shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def first_rows(df: DataFrame, *order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows by the given keys (Spark tables have no order of their own)."""
    return df.orderBy(*order).limit(n)


def overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Shape, types and missing values of every column of every table, one scan per table."""
    return reduce(
        DataFrame.unionByName,
        (
            null_profile(df).select(
                F.lit(name).alias("table_name"),
                "n_rows",
                F.lit(len(df.columns)).alias("n_columns"),
                "position",
                "column_name",
                "data_type",
                "null_count",
                "null_pct",
            )
            for name, df in tables.items()
        ),
    )
