"""Block comparison of nearest neighbours: against all distances, and how its points are joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import neighbours as nb
from custlens.operators.models import classifier
from custlens.operators.neighbours import closest_pairs
from custlens.plans import classification as cls


def brute(here, there, k, limits=None):
    far = np.zeros((len(here), len(there)))
    for axis in range(here.shape[1]):
        far += (here[:, axis, None] - there[None, :, axis]) ** 2
    out = []
    for i, row in enumerate(far):
        out += [(i, int(j), row[j]) for j in np.argsort(row, kind="stable")[:k] if limits is None or row[j] <= limits[i] ** 2]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("lines", [3, 700])
def test_closest_pairs_are_those_of_all_distances(scale, ties, lines):
    rng = np.random.default_rng(3)
    here, there = rng.normal(size=(1100, 20)), rng.normal(size=(lines, 20)) + 50
    here += 50
    if ties:
        here, there = np.round(here / 2) * 2, np.round(there / 2) * 2
        here[:5], there[: min(9, lines)] = 50, 50
    here, there = here * scale, there * scale
    assert list(zip(*(part.tolist() for part in closest_pairs(here, there, 5)))) == brute(here, there, 5)
    limits = np.sqrt(np.array([max(d for j, _, d in brute(here[i : i + 1], there, 3)) for i in range(50)]))
    got = list(zip(*(part.tolist() for part in closest_pairs(here[:50], there, 5, limits * (1 + 1e-12)))))
    assert set(brute(here[:50], there, 5, limits)) <= set(got) <= set(brute(here[:50], there, 5))


def test_points_that_doubles_cannot_square_are_kept():
    here, there = np.array([[1e200, 0.0]]), np.array([[1e200, 1.0], [-1e200, 0.0], [1e200, 0.5]])
    query, line, far = closest_pairs(here, there, 2)
    assert line.tolist() == [2, 0] and far.tolist() == [0.25, 1.0]


def test_points_are_merged_and_never_broadcast(spark):
    """Points of few different values lie in files far below the size that Spark broadcasts, at any number of rows."""
    point = F.array(*(F.lit(1.0) * (F.col("id") % (i + 2)) for i in range(12)))
    rows = spark.range(1500).select(F.col("id").alias("neighbour"), point.alias("point"), F.col("id").alias("line")).localCheckpoint()
    asked = rows.where("line % 7 = 0").select(F.col("neighbour").alias("key"), F.col("point").alias("query"), F.col("line").alias("ask"))
    found = nb._by_hashes(rows, asked, "key", 5, 1500, 100, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [line" in plan and "SortMergeJoin [ask" in plan
    assert found.where("place = 1").count() > 0


def test_regressions_and_neighbours_go_first():
    kinds = ["Random Forest", None, "Gradient Boosting", "Logistic Regression"]
    cells = [cls.Cell("c", str(kind), [], classifier(kind) if kind else None) for kind in kinds]
    assert [c.model for c in sorted(cells, key=cls._turn)] == ["Logistic Regression", "None", "Random Forest", "Gradient Boosting"]
