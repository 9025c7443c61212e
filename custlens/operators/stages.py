"""Pipeline stages for what ``pyspark.ml`` lacks: exact medians, string modes, population scaling.

Every estimator learns a few numbers per column with aggregate queries; every model applies them as
plain column expressions, so scoring stays inside generated code.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA, PCAModel, VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.quantiles import collect_quantiles
from custlens.operators.aggregates import most_frequent
from custlens.operators.components import as_model, components_for, leading_components


class _Learned(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose state is one JSON-serialisable mapping per column."""

    learned = Param(Params._dummy(), "learned", "what was learned, by column")

    def __init__(self, inputCols=(), learned=None):
        super().__init__()
        self._set(inputCols=list(inputCols), learned=learned or {})

    def state(self) -> dict:
        return self.getOrDefault("learned")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: self.expression(c) for c in self.getInputCols()})

    def expression(self, column: str) -> Column:
        raise NotImplementedError


class _ColumnEstimator(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _configure(self, inputCols, **params):
        self._set(inputCols=list(inputCols or []), **{k: v for k, v in params.items() if v is not None})


def known(column: str) -> Column:
    """The column in double precision with NaN as null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


class FillMissing(_ColumnEstimator):
    """Fill each column with its ``mean``, exact ``median`` or ``mode``, or with ``fallback`` when it is empty."""

    strategy = Param(Params._dummy(), "strategy", "mean, median or mode", TypeConverters.toString)
    fallback = Param(Params._dummy(), "fallback", "value for a column without any value")

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="median", fallback=None):
        super().__init__()
        self._configure(inputCols, strategy=strategy, fallback=fallback)

    def _fit(self, dataset: DataFrame) -> "FilledMissing":
        columns, strategy = self.getInputCols(), self.getOrDefault("strategy")
        if not columns:
            found = {}
        elif strategy == "mean":
            found = dataset.agg(*(F.avg(known(c)).alias(c) for c in columns)).first().asDict()
        elif strategy == "median":
            found = {c: values[0] for c, values in collect_quantiles(dataset, columns, [0.5]).items()}
        elif strategy == "mode":
            found = {c: (most_frequent(dataset, c).first() or [None])[0] for c in columns}
        else:
            raise ValueError(f"unknown strategy {strategy}")
        fallback = self.getOrDefault("fallback") if self.isDefined("fallback") else None
        return FilledMissing(columns, {c: fallback if v is None else v for c, v in found.items()})


class FilledMissing(_Learned):
    def expression(self, column: str) -> Column:
        fill = self.state().get(column)
        value = F.col(column) if isinstance(fill, str) else known(column)
        return value if fill is None else F.coalesce(value, F.lit(fill))


class ScaleColumns(_ColumnEstimator):
    """``standard``: (x - mean) / population deviation. ``robust``: (x - median) / (Q3 - Q1), exactly.

    A column without spread is divided by one, hence becomes zero under ``standard``.
    """

    method = Param(Params._dummy(), "method", "standard or robust", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, method="standard"):
        super().__init__()
        self._configure(inputCols, method=method)

    def _fit(self, dataset: DataFrame) -> "ScaledColumns":
        columns, method = self.getInputCols(), self.getOrDefault("method")
        if not columns:
            return ScaledColumns(columns, {})
        if method == "standard":
            row = dataset.agg(
                *(F.avg(known(c)).alias(f"m_{c}") for c in columns),
                *(F.stddev_pop(known(c)).alias(f"s_{c}") for c in columns),
                *((F.max(known(c)) > F.min(known(c))).alias(f"v_{c}") for c in columns),
            ).first()
            learned = {c: [row[f"m_{c}"] or 0.0, row[f"s_{c}"] if row[f"v_{c}"] else 1.0] for c in columns}
        elif method == "robust":
            found = collect_quantiles(dataset, columns, [0.25, 0.5, 0.75])
            learned = {}
            for c, (first, middle, third) in found.items():
                spread = (third or 0.0) - (first or 0.0)
                learned[c] = [middle or 0.0, spread if spread > 0 else 1.0]
        else:
            raise ValueError(f"unknown method {method}")
        return ScaledColumns(columns, learned)


class ScaledColumns(_Learned):
    def expression(self, column: str) -> Column:
        centre, spread = self.state()[column]
        return (known(column) - F.lit(centre)) / F.lit(spread)


class QuantileBins(_ColumnEstimator):
    """Replace each value by the number of its quantile bin; equal edges merge into one."""

    bins = Param(Params._dummy(), "bins", "number of bins", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, bins=5):
        super().__init__()
        self._configure(inputCols, bins=bins)

    def _fit(self, dataset: DataFrame) -> "QuantileBinned":
        columns, bins = self.getInputCols(), self.getOrDefault("bins")
        found = collect_quantiles(dataset, columns, [i / bins for i in range(bins + 1)])
        learned = {}
        for c, edges in found.items():
            distinct = [e for i, e in enumerate(edges) if e is not None and (i == 0 or e > edges[i - 1])]
            learned[c] = distinct[1:-1]
        return QuantileBinned(columns, learned)


class QuantileBinned(_Learned):
    def expression(self, column: str) -> Column:
        index = F.lit(0)
        for edge in self.state()[column]:
            index = index + (known(column) >= F.lit(edge)).cast("int")
        return index.cast("double")


class KeepTopLevels(_ColumnEstimator):
    """Keep the most frequent levels of each column and name all others, and nulls, ``other``."""

    top = Param(Params._dummy(), "top", "levels to keep", TypeConverters.toInt)
    others = Param(Params._dummy(), "others", "name of the rest, by column")

    @keyword_only
    def __init__(self, *, inputCols=None, top=10, others=None):
        super().__init__()
        self._configure(inputCols, top=top, others=others or {})

    def _fit(self, dataset: DataFrame) -> "KeptTopLevels":
        learned = {}
        for c in self.getInputCols():
            counts = dataset.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
            kept = counts.orderBy(F.desc("n"), c).limit(self.getOrDefault("top")).collect()
            learned[c] = {"levels": [row[c] for row in kept], "other": self.getOrDefault("others").get(c, "Other")}
        return KeptTopLevels(self.getInputCols(), learned)


class KeptTopLevels(_Learned):
    def expression(self, column: str) -> Column:
        state = self.state()[column]
        return F.when(F.col(column).isin(state["levels"]), F.col(column)).otherwise(state["other"])


class DropFirstSlot(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Drop slot 0, the alphabetically first level, from a one-hot vector."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Transformer:
        size = vector_size(dataset, self.getInputCol())
        return VectorSlicer(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=list(range(min(1, size - 1), size))
        )


class VariancePCA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Principal components that together keep at least ``target`` of the variance, or the first ``components``.

    Projects on the kept directions only; the projection stays uncentred, i.e. shifted by a constant that distances do not
    see. Up to ``gramSlots`` slots one pass gathers the covariance (8 MB for 1,024); beyond, the directions come from block
    subspace iteration, which never holds a slots x slots matrix.
    """

    target = Param(Params._dummy(), "target", "share of variance to keep", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "directions to keep, 0 for as many as target needs", TypeConverters.toInt)
    gramSlots = Param(Params._dummy(), "gramSlots", "slots up to which the covariance is gathered", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, target=0.95, components=0, gramSlots=1024):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(target=0.95, components=0, gramSlots=1024)

    def _fit(self, dataset: DataFrame) -> PCAModel:
        column, target, wanted = self.getInputCol(), self.getOrDefault("target"), self.getOrDefault("components")
        size = vector_size(dataset, column)
        if size <= self.getOrDefault("gramSlots"):
            fitted = PCA(k=min(wanted or size, size), inputCol=column, outputCol=self.getOutputCol()).fit(dataset)
            shares = np.array(fitted.explainedVariance.toArray())
            keep = len(shares) if wanted else components_for(list(shares), target)
            ways, shares = fitted.pc.toArray()[:, :keep], shares[:keep]
        else:
            ways, shares = leading_components(dataset, column, target, wanted or None)
        model = as_model(dataset, ways, shares)
        return model.setInputCol(column).setOutputCol(self.getOutputCol())


def vector_size(dataset: DataFrame, column: str) -> int:
    """Slots of a vector column, from its metadata or else its first row that is not null."""
    declared = dataset.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    if declared:
        return declared
    first = dataset.select(column).where(F.col(column).isNotNull()).first()
    if first is None:
        raise ValueError(f"no rows in {column}")
    return first[0].size


def slot_names(dataset: DataFrame, column: str) -> list[str]:
    """Names of the slots of an assembled vector column, in order."""
    attributes = dataset.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: a.get("name", str(a["idx"])) for group in attributes.values() for a in group}
    # One-hot slots read <column>_<level>, without the name of the intermediate vector.
    named = {i: re.sub(r"_(hot|rest)_", "_", name, count=1) for i, name in named.items()}
    return [named.get(i, str(i)) for i in range(vector_size(dataset, column))]
