"""K-means, cluster quality scores and cluster descriptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from custlens.functions.quantiles import exact_quantiles
from custlens.operators.kmeans import Centres, fit_all


def fit_kmeans(
    df: DataFrame, k: int, starts: int = 1, max_iter: int = 100, seed: int = 42, features: str = "features"
) -> Centres:
    """The cheapest of ``starts`` k-means fits, each from its own k-means++ start."""
    return fit_all(df, [k], starts, max_iter, seed, features)[k]


def nearest_centroid(df: DataFrame, centroids: Sequence[Mapping[str, float]], out: str = "cluster") -> DataFrame:
    """Label every row with the closest of a few given centroids over named columns (first on a tie)."""
    candidates = [
        F.struct(
            sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in centroid.items()), F.lit(0.0)),
            F.lit(i),
        )
        for i, centroid in enumerate(centroids)
    ]
    return df.withColumn(out, F.array_min(F.array(*candidates))["col2"])


def silhouette_squared(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean silhouette under squared Euclidean distance, in time linear in the rows."""
    return ClusteringEvaluator(
        predictionCol=cluster, featuresCol=features, metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(df)


def cluster_scores(df: DataFrame, features: str = "features", cluster: str = "cluster") -> dict[str, float]:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin of a labelling.

    Only one summary per cluster (count, mean and variance vectors) reaches the driver.
    """
    rows = (
        df.groupBy(cluster)
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col(features)).alias("s"))
        .orderBy(cluster)
        .collect()
    )
    n = np.array([row["s"]["count"] for row in rows], dtype=float)
    means = np.array([row["s"]["mean"].toArray() for row in rows])
    variances = np.array([row["s"]["variance"].toArray() for row in rows])
    within = float(((n - 1) * variances.sum(axis=1)).sum())
    centre = (n[:, None] * means).sum(axis=0) / n.sum()
    between = float((n * ((means - centre) ** 2).sum(axis=1)).sum())
    k, total = len(rows), float(n.sum())
    return {
        "silhouette": silhouette_squared(df, features, cluster) if k > 1 else float("nan"),
        "calinski_harabasz": (between / (k - 1)) / (within / (total - k)) if k > 1 and within > 0 else 1.0,
        "davies_bouldin": _davies_bouldin(df, features, cluster, [row[cluster] for row in rows], means),
    }


def _davies_bouldin(df: DataFrame, features: str, cluster: str, labels: list, means: np.ndarray) -> float:
    centroids = df.sparkSession.createDataFrame(
        list(zip(labels, means.tolist())), f"{cluster} {df.schema[cluster].dataType.simpleString()}, centroid array<double>"
    )
    gap = F.zip_with(vector_to_array(features), "centroid", lambda a, b: (a - b) * (a - b))
    spreads = (
        df.join(F.broadcast(centroids), cluster)
        .groupBy(cluster)
        .agg(F.avg(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, b: a + b))).alias("spread"))
        .collect()
    )
    spread = dict((row[cluster], row["spread"]) for row in spreads)
    s = np.array([spread[label] for label in labels])
    distance = np.sqrt(((means[:, None, :] - means[None, :, :]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        similarity = np.where(distance > 0, (s[:, None] + s[None, :]) / distance, 0.0)
    return float(similarity.max(axis=1).mean()) if len(labels) > 1 else 0.0


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    counts = df.groupBy(cluster).agg(F.count("*").alias("size"))
    total = counts.agg(F.sum("size")).scalar()
    return counts.withColumn("percentage", F.col("size") * 100.0 / total).orderBy(cluster)


def cluster_means(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Rows ``(cluster, feature, mean)``; ``pivot_means`` lays them out with one column per cluster."""
    return (
        df.groupBy(cluster)
        .agg(*(F.avg(c).alias(c) for c in columns))
        .unpivot(cluster, list(columns), "feature", "mean")
    )


def pivot_means(means: DataFrame, clusters: Sequence[int], cluster: str = "cluster") -> DataFrame:
    return means.groupBy("feature").pivot(cluster, list(clusters)).agg(F.round(F.first("mean"), 2))


def top_levels(df: DataFrame, column: str, n: int = 2, cluster: str = "cluster") -> DataFrame:
    """The ``n`` most frequent levels per cluster with their share of the cluster."""
    counts = df.groupBy(cluster, column).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(cluster).agg(F.sum("n").alias("size"))
    # Nulls rank last instead of being filtered first, so that both uses share one set of counts.
    place = F.row_number().over(W.partitionBy(cluster).orderBy(F.col(column).isNull(), F.desc("n"), column))
    return (
        counts.withColumn("place", place)
        .where((F.col("place") <= n) & F.col(column).isNotNull())
        .join(sizes, cluster)
        .select(cluster, column, "n", "place", (F.col("n") * 100.0 / F.col("size")).alias("percentage"))
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50, cluster: str = "cluster") -> DataFrame:
    """Points per cluster and grid cell: the picture of a scatter plot at any number of points."""

    def cell(column: str):
        low, high = (df.agg(f(F.col(column).cast("double"))).scalar() for f in (F.min, F.max))
        step = (F.col(column).cast("double") - low) / F.nullif(high - low, F.lit(0.0)) * bins
        return F.least(F.coalesce(F.floor(step), F.lit(0)), F.lit(bins - 1)).cast("int")

    return df.groupBy(cluster, cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(F.count("*").alias("n"))


def boxplot_stats(df: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR of the box) and outlier count per cluster."""
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75], by=[cluster])
    boxes = q.groupBy(cluster).agg(
        *(
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        )
    )
    value = F.col(column).cast("double")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    return (
        df.where(value.isNotNull())
        .join(F.broadcast(boxes), cluster)
        .groupBy(cluster, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
