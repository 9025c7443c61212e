"""Classifiers with the usual defaults of their kind, as pipeline stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from custlens.operators.boosting import HistogramBoosting, vector_parts
from custlens.operators.forest import fit_trees, slots_tried
from custlens.operators.metrics import ranking_metrics
from custlens.operators.network import Network

LABEL = "label"
SEED = 42
# From so many rows on a forest grows its trees in tasks, which then hold all rows as codes (some 30 bytes a row of 12 entries) ...
ROWS_FOR_TASKS = 20_000
# ... and up to so many rows and entries; beyond, Spark's own passes over dealt rows serve it.
MOST_ROWS, MOST_ENTRIES = 6_000_000, 75_000_000


class _Sized(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator that needs the size of its training set to set up the one it stands for."""

    def _configure(self, given: dict, **defaults):
        self._setDefault(seed=SEED, labelCol=LABEL, featuresCol="features", **defaults)
        self._set(**{name: value for name, value in given.items() if value is not None})


class RidgeLogistic(_Sized):
    """Logistic regression with an L2 penalty given as ``C``, the inverse penalty on the summed loss."""

    C = Param(Params._dummy(), "C", "inverse of the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, C=None, maxIter=None, labelCol=None, featuresCol=None, seed=None):
        super().__init__()
        self._configure(self._input_kwargs, C=1.0, maxIter=1000)

    def _fit(self, dataset: DataFrame):
        # Spark averages the loss over the rows, so the same penalty is 1 / (C * rows).
        penalty = 1.0 / (self.getOrDefault("C") * max(1, dataset.count()))
        return LogisticRegression(
            labelCol=self.getLabelCol(),
            featuresCol=self.getFeaturesCol(),
            maxIter=self.getMaxIter(),
            regParam=penalty,
            elasticNetParam=0.0,
            standardization=False,
        ).fit(dataset)


class Forest(_Sized):
    """Random forest whose minimum leaf and split sizes are shares of the training rows.

    Spark's trees go down to depth 30 at most and their least leaf share is below one half; other values raise a
    ``ValueError`` when the forest is fitted. Few rows, and more than tasks can hold, get Spark's own forest, which makes a pass over
    all rows per level; the others get the same kind of trees, each grown in one task (see ``forest``). The draws of the two
    differ. Rows that Spark's forest refuses, or labels other than 0 and 1, go to Spark's at any size.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "greatest depth", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features tried per split", TypeConverters.toString)
    leafShare = Param(Params._dummy(), "leafShare", "least share of rows in a leaf", TypeConverters.toFloat)
    splitShare = Param(Params._dummy(), "splitShare", "least share of rows in a split node", TypeConverters.toFloat)
    rowsForTasks = Param(Params._dummy(), "rowsForTasks", "least rows whose trees grow in tasks", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        trees=None,
        depth=None,
        subset=None,
        leafShare=None,
        splitShare=None,
        rowsForTasks=None,
        labelCol=None,
        featuresCol=None,
        seed=None,
    ):
        super().__init__()
        self._configure(
            self._input_kwargs,
            trees=100,
            depth=30,
            subset="sqrt",
            leafShare=0.0,
            splitShare=0.0,
            rowsForTasks=ROWS_FOR_TASKS,
        )

    def _fit(self, dataset: DataFrame):
        depth, leaf_share = self.getOrDefault("depth"), self.getOrDefault("leafShare")
        if not 0 <= depth <= 30:
            raise ValueError(f"depth must be from 0 to 30, not {depth}")
        if not 0 <= leaf_share < 0.5:
            raise ValueError(f"leafShare must be at least 0 and below 0.5, not {leaf_share}")
        split_share = self.getOrDefault("splitShare")
        n = dataset.count()
        # A split of at least f * n rows leaves children of f * n / 2 on average.
        least = max(1, -(-int(split_share * n) // 2)) if split_share else 1
        if self.getOrDefault("rowsForTasks") <= n <= MOST_ROWS:
            grown = self._in_tasks(dataset, n, max(least, leaf_share * n))
            if grown is not None:
                return grown
        return RandomForestClassifier(
            labelCol=self.getLabelCol(),
            featuresCol=self.getFeaturesCol(),
            numTrees=self.getOrDefault("trees"),
            maxDepth=depth,
            featureSubsetStrategy=self.getOrDefault("subset"),
            minWeightFractionPerNode=leaf_share,
            minInstancesPerNode=least,
            # The same trees, but no pass walks every row down from the root again.
            cacheNodeIds=True,
            seed=self.getSeed(),
        ).fit(dataset)

    def _in_tasks(self, dataset: DataFrame, n: int, least: float):
        """The forest with trees grown in tasks, or none for rows that it does not know or cannot hold."""
        label, features = F.col(self.getLabelCol()), F.col(self.getFeaturesCol())
        values, trees = F.unwrap_udt(features)["values"], self.getOrDefault("trees")
        odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        width = F.coalesce(F.unwrap_udt(features)["size"], F.size(values))
        found = dataset.agg(
            F.count_if(label.isin(0, 1) & ~odd).alias("known"),
            F.sum(label).alias("ones"),
            F.sum(F.size(values)).alias("entries"),
            F.min(width).alias("least"),
            F.max(width).alias("most"),
        ).first()
        if found["known"] < n or not 0 < found["ones"] < n or found["entries"] > MOST_ENTRIES or found["least"] != found["most"]:
            return None
        tried = slots_tried(self.getOrDefault("subset"), found["most"], trees)
        if tried is None:
            return None
        rows = dataset.select(label.cast("double").alias("label"), *vector_parts(self.getFeaturesCol()))
        model = fit_trees(rows, n, found["most"], trees, self.getOrDefault("depth"), tried, least, self.getSeed())
        return model._set(featuresCol=self.getFeaturesCol())


def boosting(trees: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 255, **options) -> HistogramBoosting:
    return HistogramBoosting(labelCol=LABEL, trees=trees, depth=depth, rate=rate, bins=bins, seed=SEED, **options)


def classifier(
    kind: str, trees: int = 100, depth: int = 30, max_iter: int | None = None, hidden: Sequence[int] = (100,)
) -> Estimator:
    """A model kind by name. ``depth`` is that of the forest; without ``max_iter`` the regression makes at most 1000
    iterations and the network 500."""
    kinds = {
        "Logistic Regression": lambda: RidgeLogistic(maxIter=max_iter),
        "Random Forest": lambda: Forest(trees=trees, depth=depth),
        "Gradient Boosting": lambda: boosting(trees),
        "HistGradientBoosting": lambda: boosting(trees, depth=0, leaves=31, leastRows=20, patience=10),
        "XGBoost": lambda: boosting(trees, depth=6, rate=0.3, l2=1.0),
        "MLPClassifier": lambda: Network(labelCol=LABEL, hidden=list(hidden), maxIter=max_iter),
    }
    if kind not in kinds:
        raise ValueError(f"unknown classifier {kind}")
    return kinds[kind]()


def scores(predicted: DataFrame, *keep: str) -> DataFrame:
    """Label, probability of class 1 and predicted class, plus the columns to keep."""
    return predicted.select(
        *keep,
        F.col(LABEL).cast("int").alias(LABEL),
        F.get(vector_to_array("probability"), F.lit(1)).alias("score"),
        F.col("prediction").cast("double").alias("prediction"),
    )


class RankingEvaluator(Evaluator):
    """Exact ROC-AUC (``auc_roc``) or average precision (``auc_pr``), for ``CrossValidator`` and searches."""

    def __init__(self, metric: str = "auc_pr"):
        super().__init__()
        self.metric = metric

    def _evaluate(self, dataset: DataFrame) -> float:
        row = ranking_metrics(scores(dataset)).first()
        value = row[self.metric] if row else None
        return float("nan") if value is None else value

    def isLargerBetter(self) -> bool:
        return True
