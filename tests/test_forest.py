"""Forests whose trees grow in tasks: against Spark's own tree, planted structure, and the number of jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F
from test_boosting import chances, frame, planted

from custlens.operators.boosting import vector_parts
from custlens.operators.forest import GrownForest, fit_trees, slots_tried
from custlens.operators.models import Forest
from custlens.session import scratch_path


def coarse(n=400, seed=0):
    """Few distinct values, so that every cut between two of them is tried, and labels that no tree gets right."""
    x, y = planted(n, seed)
    x = np.round(x * 2) / 2
    x[:, 3] = np.random.default_rng(seed).random(n) < 0.1  # a slot that few rows fill
    return x, np.where(np.random.default_rng(seed + 1).random(n) < 0.2, 1 - y, y)


@pytest.mark.parametrize("depth, share", [(1, 0.0), (4, 0.0), (12, 0.0), (12, 0.05)])
@pytest.mark.parametrize("sparse", [False, True])
def test_one_tree_is_the_tree_of_spark(spark, depth, share, sparse):
    df = frame(spark, *coarse(), sparse=sparse)
    plain = DecisionTreeClassifier(labelCol="label", maxDepth=depth, minWeightFractionPerNode=share).fit(df)
    rows = df.select("label", *vector_parts("features"))
    grown = fit_trees(rows, 400, 4, 1, depth, 4, max(1, share * 400), 42, bootstrap=False)
    assert np.allclose(chances(grown, df), chances(plain, df))
    assert np.allclose(grown.featureImportances.toArray(), plain.featureImportances.toArray())
    a, b = ([r["prediction"] for r in m.transform(df).collect()] for m in (grown, plain))
    assert a == b


def test_forest_learns_as_well_as_that_of_spark(spark):
    train, test = frame(spark, *coarse(2000)), frame(spark, *coarse(1000, seed=5))
    truth = coarse(1000, seed=5)[1]
    grown, plain = (Forest(trees=30, rowsForTasks=n).fit(train) for n in (0, 10**6))
    assert isinstance(grown, GrownForest) and not isinstance(plain, GrownForest) and grown.getNumTrees == 30
    a, b = (((chances(m, test) > 0.5) == truth).mean() for m in (grown, plain))
    assert a > 0.7 and abs(a - b) < 0.03


def test_a_deeper_forest_needs_no_more_jobs(spark):
    df = frame(spark, *coarse()).localCheckpoint()
    counts = []
    for depth in (2, 20):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        Forest(trees=5, depth=depth, rowsForTasks=0).fit(df)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] < 10


def test_grown_forest_is_saved_and_seeded(spark):
    df = frame(spark, *coarse(), sparse=True).localCheckpoint()
    a, b, other = (Forest(trees=7, seed=seed, rowsForTasks=0).fit(df) for seed in (1, 1, 2))
    assert np.array_equal(chances(a, df), chances(b, df)) and not np.array_equal(chances(a, df), chances(other, df))
    path = scratch_path(spark, "forest")
    a.save(path)
    assert np.array_equal(chances(GrownForest.load(path), df), chances(a, df))
    assert a.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_leaves_hold_their_share(spark):
    df = frame(spark, *coarse())
    nodes, roots = Forest(trees=1, subset="all", leafShare=0.2, rowsForTasks=0).fit(df).nodes()
    assert len(roots) == 1 and 1 <= (nodes["slot"] < 0).sum() <= 5
    nodes, _ = Forest(trees=1, subset="all", splitShare=1.0, rowsForTasks=0).fit(df).nodes()
    assert (nodes["slot"] < 0).sum() <= 2


def test_other_rows_get_the_forest_of_spark(spark):
    x, y = coarse()
    three = frame(spark, x, y).withColumn("label", F.when(F.rand(1) < 0.2, 2.0).otherwise(F.col("label")))
    assert not isinstance(Forest(trees=2, depth=3, rowsForTasks=0).fit(three), GrownForest)
    ones = frame(spark, x, np.ones(len(y)))
    assert not isinstance(Forest(trees=2, depth=3, rowsForTasks=0).fit(ones), GrownForest)
    with pytest.raises(Exception):
        Forest(trees=2, depth=3, rowsForTasks=0).fit(frame(spark, x, y).withColumn("label", F.lit(None).cast("double")))


def test_settings_are_read_as_by_spark():
    assert [slots_tried(s, 160, 100) for s in ("sqrt", "all", "auto", "0.600000", "1.000000")] == [13, 160, 13, 96, 160]
    assert slots_tried("third", 160, 100) is None and slots_tried("1.5", 160, 100) is None
