"""Assembling feature vectors from numeric and string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from custlens.operators.stages import DropFirstSlot, slot_names


def one_hot_stages(columns: Sequence[str], drop_first: bool = False) -> tuple[list, list[str]]:
    """Stages that encode string columns, levels in alphabetical order, and their output columns.

    Unknown levels and nulls share one extra slot, the last, which the encoder drops: they become
    all zeros. ``drop_first`` drops the alphabetically first level too.
    """
    if not columns:
        return [], []
    indexed = [f"{c}_index" for c in columns]
    encoded = [f"{c}_hot" for c in columns]
    stages = [
        StringIndexer(
            inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
    ]
    if not drop_first:
        return stages, encoded
    rest = [f"{c}_rest" for c in columns]
    stages += [DropFirstSlot(inputCol=a, outputCol=b) for a, b in zip(encoded, rest)]
    return stages, rest


def bin_stages(columns: Sequence[str]) -> tuple[list, list[str]]:
    """Stages that one-hot encode bin numbers, one slot per learned bin. The last bin holds the greatest training value, so
    every bin number that the learned edges can give is known after the fit."""
    encoded = [f"{c}_bin" for c in columns]
    return [OneHotEncoder(inputCols=list(columns), outputCols=encoded, dropLast=False, handleInvalid="error")], encoded


def polynomial_stages(columns: Sequence[str], degree: int = 2) -> tuple[list, list[str]]:
    return [
        VectorAssembler(inputCols=list(columns), outputCol="poly_input"),
        PolynomialExpansion(degree=degree, inputCol="poly_input", outputCol="poly"),
    ], ["poly"]


def polynomial_names(columns: Sequence[str]) -> list[str]:
    """Names of the degree-2 terms in the order the expansion emits them."""
    names = []
    for i, column in enumerate(columns):
        names.append(column)
        names += [f"{other}*{column}" for other in columns[: i + 1]]
    return names


def assemble(inputs: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="error")


def encode(df: DataFrame, columns: Sequence[str], drop_first: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """``df`` with its string columns one-hot encoded, levels taken from ``fit_on``."""
    stages, _ = one_hot_stages(columns, drop_first)
    return Pipeline(stages=stages).fit(fit_on if fit_on is not None else df).transform(df)


def long_form(df: DataFrame, key: str, vector: str, names: Sequence[str] | None = None) -> DataFrame:
    """Non-zero vector slots as rows ``(key, feature, value)``; a null vector gives none.

    Sparse vectors give up their entries as they are, so work follows the filled slots and not the width, and the names come by
    a join on the slot from a table of one row per slot. That table is the one to broadcast: Spark knows no size of it and, left alone,
    takes the file's size for that of the entries, which are many times more.
    """
    parts = F.unwrap_udt(F.col(vector))
    slots = F.coalesce(parts["indices"], F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    entries = F.zip_with(slots, parts["values"], lambda slot, value: F.struct(slot.alias("slot"), value.alias("value")))
    named = df.sparkSession.createDataFrame(
        list(enumerate(names or slot_names(df, vector))), "slot int, feature string"
    )
    filled = df.select(key, F.inline(entries)).where(F.col("value") != 0)
    return filled.join(F.broadcast(named), "slot").select(key, "feature", "value")
