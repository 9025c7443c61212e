"""Customer segments: preparation, component analysis, the k sweep and the description of the winner."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.operators import clustering as cl, encoding as enc
from custlens.operators.kmeans import fit_all
from custlens.operators.stages import FillMissing, KeepTopLevels, ScaleColumns, VariancePCA, vector_size
from custlens.plans import features as feat
from custlens.session import in_parallel, materialize

# Names of the rest levels.
OTHERS = {"customer_state": "Other_State", "customer_city": "Other_City"}


def preparation(
    numeric: Sequence[str] = tuple(feat.SEGMENT_NUMERIC),
    strings: Sequence[str] = tuple(feat.GEOGRAPHY),
    top: int | None = 10,
    variance: float | None = 0.95,
    components: int | None = None,
    scale_all: bool = True,
) -> Pipeline:
    """Stages from customer rows to ``features``.

    ``scale_all`` scales dummies too, at unit deviation and without centring, which keeps one-hot vectors
    sparse and moves all points alike; otherwise only the numbers are z-scored. ``variance`` or ``components``
    adds principal components. Sample instead of population deviation stretches all axes by one
    factor, to which k-means, the variance shares and all three scores are indifferent.
    """
    stages: list = [
        FillMissing(inputCols=list(numeric), strategy="median", fallback=0.0),
        FillMissing(inputCols=list(strings), strategy="mode", fallback="missing"),
    ]
    if top:
        stages.append(KeepTopLevels(inputCols=list(strings), top=top, others=OTHERS))
    if not scale_all:
        stages.append(ScaleColumns(inputCols=list(numeric), method="standard"))
    hot, encoded = enc.one_hot_stages(strings, drop_first=True)
    reduce = variance is not None or components is not None
    last = "scaled" if reduce else "features"
    stages += [*hot, enc.assemble([*numeric, *encoded], "raw" if scale_all else last)]
    if scale_all:
        stages.append(StandardScaler(inputCol="raw", outputCol=last, withMean=False, withStd=True))
    if components is not None:
        stages.append(VariancePCA(inputCol=last, outputCol="features", components=components))
    elif variance is not None:
        stages.append(VariancePCA(inputCol=last, outputCol="features", target=variance))
    return Pipeline(stages=stages)


@dataclass
class Segmentation:
    labelled: DataFrame  # customer rows with their cluster
    sweep: DataFrame  # k and its three scores
    pca: DataFrame  # features in, components kept, variance kept
    best_k: int
    preparation: PipelineModel


def segment(
    rows: DataFrame,
    ks: Iterable[int] = range(2, 7),
    pipeline: Pipeline | None = None,
    starts: int = 1,
    max_iter: int = 100,
    parallelism: int = 4,
) -> Segmentation:
    """Fit k-means for every ``k`` on the prepared rows and keep the first with the best silhouette.

    The rows and their vectors are written once. All fits are one job over the vectors, and their labels are written
    side by side. Up to ``parallelism`` values of ``k`` are scored at a time.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "rows")
    fitted = (pipeline or preparation()).fit(rows)
    prepared = materialize(fitted.transform(rows).select(*rows.columns, "features"), "vectors")
    vectors = prepared.select("features")
    models = fit_all(vectors, list(ks), starts, max_iter)
    labels = vectors
    for k, model in models.items():
        labels = model.transform(labels).withColumnRenamed("cluster", f"cluster_{k}")
    labels = materialize(labels, "labels")

    def score(k: int) -> tuple:
        s = cl.cluster_scores(labels, cluster=f"cluster_{k}")
        return k, s["silhouette"], s["calinski_harabasz"], s["davies_bouldin"], models[k].summary.trainingCost

    scored = in_parallel([lambda k=k: score(k) for k in models], parallelism)
    best_k = max(scored, key=lambda row: (row[1], -row[0]))[0]
    sweep = spark.createDataFrame(
        scored, "k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double"
    )
    labelled = models[best_k].transform(prepared).drop("features")
    return Segmentation(labelled, sweep, pca_summary(spark, fitted), best_k, fitted)


def pca_summary(spark: SparkSession, fitted: PipelineModel) -> DataFrame:
    """Features in, components kept and the variance share they keep; no row without components."""
    rows = []
    for stage in fitted.stages:
        if hasattr(stage, "explainedVariance"):
            shares = list(stage.explainedVariance)
            rows.append((stage.pc.numRows, len(shares), float(sum(shares))))
    return spark.createDataFrame(rows, "features int, components int, explained double")


def describe(result: Segmentation) -> dict[str, DataFrame]:
    """Sizes, means of the numeric features that the recipe has, and usual states and cities of the segments."""
    numeric = [c for c in feat.SEGMENT_NUMERIC if c in result.labelled.columns]
    return {
        "sizes": cl.cluster_sizes(result.labelled),
        "means": cl.cluster_means(result.labelled, numeric),
        "states": cl.top_levels(result.labelled, "customer_state"),
        "cities": cl.top_levels(result.labelled, "customer_city"),
    }
