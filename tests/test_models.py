import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from custlens.functions.hashing import split_by_hash
from custlens.operators import clustering as cl, encoding as enc, kmeans, metrics as met, neighbours
from custlens.operators.joins import PERSON
from custlens.operators.models import Forest, RankingEvaluator, RidgeLogistic, classifier
from custlens.operators.neighbours import nearest_neighbours, vote
from custlens.plans import classification as cls, features as feat, segmentation as seg, studies
from custlens.session import scratch_path
from custlens.sources import read_star_shop
from custlens.sources.sinks import load_model, save_model


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double").repartition(3)


def brute_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb]
    return sum(pairs) / len(pairs)


def brute_ap(y, s):
    total, hits, seen, area = sum(y), 0, 0, 0.0
    for value in sorted(set(s), reverse=True):
        group = [label for label, x in zip(y, s) if x == value]
        hits, seen = hits + sum(group), seen + len(group)
        area += sum(group) / total * hits / seen
    return area


def test_textbook_scores(spark):
    row = met.ranking_metrics(scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])).first()
    assert row["auc_roc"] == 0.75
    assert row["auc_pr"] == pytest.approx(0.8333, abs=1e-4)


@pytest.mark.parametrize("seed,ties,tasks", [(0, 3, None), (1, 50, 7), (2, 10_000, None), (2, 10_000, 13)])
def test_ranking_metrics_against_brute_force(spark, seed, ties, tasks):
    rng = np.random.default_rng(seed)
    s = np.floor(rng.random(400) * ties) / ties
    s[rng.random(400) < 1 / 3] = 0.5  # a third of the rows share one score
    y = (rng.random(400) < s).astype(int)
    rows = [(int(a), float(b)) for a, b in zip(y, s)]
    row = met.ranking_metrics(scored(spark, rows), tasks=tasks).first()
    assert row["auc_roc"] == pytest.approx(brute_auc(y, s))
    assert row["auc_pr"] == pytest.approx(brute_ap(list(y), list(s)))
    points = sorted((r["fpr"], r["tpr"]) for r in met.roc_points(scored(spark, rows), tasks=tasks).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert area == pytest.approx(row["auc_roc"])


def test_ranges_do_not_matter(spark):
    rng = np.random.default_rng(3)
    s, y, g = rng.integers(0, 300, 2000) / 300, rng.integers(0, 2, 2000), rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(f"m{c}", int(a), float(b)) for a, b, c in zip(y, s, g)], "model string, label int, score double")
    one, many = (met.score_curve(df, by=["model"], tasks=tasks) for tasks in (1, 11))
    assert many.select("model", "bucket").distinct().count() > 11 > one.select("bucket").distinct().count()
    drop = lambda curve: sorted(map(tuple, curve.drop("bucket").collect()), key=str)
    assert drop(one) == drop(many)
    for model in range(3):
        own = [(r["score"], r["cum_pos"], r["cum_neg"]) for r in many.where(F.col("model") == f"m{model}").collect()]
        for score, p, n in own:
            at_least = (s >= score) & (g == model)
            assert (p, n) == (int(y[at_least].sum()), int((1 - y[at_least]).sum()))


def test_roc_drops_straight_runs(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)]
    points = sorted((r["fpr"], r["tpr"]) for r in met.roc_points(scored(spark, rows)).collect())
    assert points == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_metrics_by_model_and_single_class(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.1), ("b", 0, 0.9), ("c", 1, 0.5)], "model string, label int, score double"
    )
    rows = {r["model"]: r["auc_roc"] for r in met.ranking_metrics(df, by=["model"]).collect()}
    assert rows == {"a": 1.0, "b": 0.0, "c": None}


def test_no_predicted_positive_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.0)], "label int, prediction double")
    assert met.binary_metrics(df).first().asDict() == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    report = met.weighted_report(df).first()
    assert report["precision"] == pytest.approx(0.25) and report["recall"] == pytest.approx(0.5)


def vectors(spark, points, labels):
    rows = [(*map(float, p), int(c)) for p, c in zip(points, labels)]
    return enc.assemble(["x", "y"]).transform(spark.createDataFrame(rows, "x double, y double, cluster int"))


def test_cluster_scores_against_brute_force(spark):
    points = np.array([[0, 0], [0, 1], [1, 0], [8, 8], [8, 9], [30, 0]], dtype=float)
    labels = np.array([0, 0, 0, 1, 1, 2])
    got = cl.cluster_scores(vectors(spark, points, labels))
    sq = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    values = []
    for i, c in enumerate(labels):
        own = (labels == c) & (np.arange(len(labels)) != i)
        if not own.any():
            values.append(0.0)
            continue
        a = sq[i, own].mean()
        b = min(sq[i, labels == other].mean() for other in set(labels) - {c})
        values.append((b - a) / max(a, b))
    assert got["silhouette"] == pytest.approx(np.mean(values))
    means = np.array([points[labels == c].mean(axis=0) for c in range(3)])
    within = sum(((points[labels == c] - means[c]) ** 2).sum() for c in range(3))
    between = sum((labels == c).sum() * ((means[c] - points.mean(axis=0)) ** 2).sum() for c in range(3))
    assert got["calinski_harabasz"] == pytest.approx((between / 2) / (within / 3))
    spread = [np.linalg.norm(points[labels == c] - means[c], axis=1).mean() for c in range(3)]
    worst = [
        max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)
    ]
    assert got["davies_bouldin"] == pytest.approx(np.mean(worst))


def test_kmeans_assigns_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(m, 0.5, size=(40, 2)) for m in (0, 5, 10)])
    df = vectors(spark, points, np.zeros(len(points)))
    model = cl.fit_kmeans(df.drop("cluster"), 3, starts=2, max_iter=20)
    centres = np.array(model.clusterCenters())
    for row in model.transform(df.drop("cluster")).collect():
        assert row["cluster"] == ((centres - row["features"].toArray()) ** 2).sum(axis=1).argmin()
    assert model.summary.trainingCost < 200


def test_kmeans_starts_share_their_passes(spark):
    """Ten starts are one job on the rows, in one task or several, and no fit is left by a better neighbour."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(m, 0.3, size=(60, 2)) for m in ((0, 0), (0, 6), (6, 0), (6, 6))])
    df = vectors(spark, points, np.zeros(len(points))).select("features").localCheckpoint()
    spark.sparkContext.setJobGroup("ten starts", "")
    model = cl.fit_kmeans(df, 4, starts=10)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ten starts")) < 8
    spark.sparkContext.setJobGroup("", "")
    groups = points.reshape(4, 60, 2)
    least = ((groups - groups.mean(axis=1, keepdims=True)) ** 2).sum()
    assert model.summary.trainingCost == pytest.approx(least)
    several = kmeans.fit_all(df, [2, 4], starts=10, rows_per_task=100)
    assert several[4].summary.trainingCost == pytest.approx(least)
    assert several[2].summary.trainingCost > least
    found = several[4].transform(df).groupBy("cluster").count().collect()
    assert sorted((row["cluster"], row["count"]) for row in found) == [(i, 60) for i in range(4)]


def test_kmeans_with_fewer_points_than_clusters(spark):
    df = vectors(spark, np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]]), np.zeros(3)).select("features")
    model = cl.fit_kmeans(df, 4, starts=2)
    assert sorted(c.tolist() for c in model.clusterCenters()) == [[1, 2], [3, 4]]
    assert model.summary.trainingCost == pytest.approx(0)


def test_pivot_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.123)], "cluster int, v double")
    row = cl.pivot_means(cl.cluster_means(df, ["v"]), [0, 1]).first()
    assert row.asDict() == {"feature": "v", "0": 1.5, "1": 5.12}


@pytest.mark.parametrize("pivots,block,crowded", [(1, 7, 512), (5, 3, 512), (12, 1000, 512), (5, 4, 8)])
def test_neighbours_against_brute_force(spark, pivots, block, crowded):
    rng = np.random.default_rng(pivots)
    points = rng.normal(size=(90, 2)).round(1)
    points[rng.random(90) < 1 / 3] = [0.5, 0.5]  # a third of all rows are copies
    queries = np.concatenate([rng.normal(size=(25, 2)).round(1), [[40.0, -3.0]], [[0.5, 0.5]]])
    train = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, p array<double>")
    test = spark.createDataFrame([(1000 + i, q.tolist()) for i, q in enumerate(queries)], "id long, p array<double>")
    found = {}
    for r in nearest_neighbours(train, test, "id", "p", 5, pivots, block, crowded, hashed=True).collect():
        found.setdefault(r["id"], {})[r["place"]] = (r["distance_sq"], r["neighbour"])
    for i, q in enumerate(queries):
        order = sorted(((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, j) for j, p in enumerate(points))[:5]
        assert [found[1000 + i][place] for place in range(1, 6)] == order


@pytest.fixture(scope="module")
def mixed_points():
    """Customers as wide vectors: eight numbers that follow four hidden ones, and 152 dummy slots with unequal shares."""
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(4, 8))
    numbers = rng.normal(size=(3300, 4)) @ hidden + 0.1 * rng.normal(size=(3300, 8))
    dummies = np.zeros((3300, 152))
    dummies[np.arange(3300), np.minimum(rng.geometric(0.4, 3300) - 1, 151)] = 1.0
    return np.hstack([numbers, dummies])


@pytest.mark.parametrize("exact", [True, False])
def test_hashed_neighbours_on_160_slots(spark, mixed_points, exact):
    points, queries = mixed_points[:3000], mixed_points[3000:]
    train = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, p array<double>")
    test = spark.createDataFrame([(10000 + i, q.tolist()) for i, q in enumerate(queries)], "id long, p array<double>")
    found = {}
    for r in nearest_neighbours(train, test, "id", "p", 5, crowded=400, exact=exact).collect():
        found.setdefault(r["id"], []).append((r["distance_sq"], r["neighbour"], r["proven"]))
    hits = proven = 0
    for i, q in enumerate(queries):
        true = np.argsort(((points - q) ** 2).sum(axis=1), kind="stable")[:5].tolist()
        got = [neighbour for _, neighbour, _ in sorted(found[10000 + i])]
        assert len(got) == 5
        if found[10000 + i][0][2]:
            assert got == true
            proven += 1
        hits += len(set(got) & set(true))
    assert proven == len(queries) if exact else proven < len(queries)
    assert hits >= 0.9 * 5 * len(queries)


def test_hash_walls_are_lower_bounds():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 3))
    ids, walls = neighbours._HashTables(points, 50.0).buckets(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    for column in range(0, ids.shape[1], 3):
        apart = ids[:, None, column] != ids[None, :, column]
        assert (far >= walls[:, column, None] - 1e-12)[apart].all()


def test_vote_with_fewer_points_than_k(spark):
    train = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 1), (3, [2.0], 0)], "id long, p array<double>, y int")
    test = spark.createDataFrame([(9, [0.0])], "id long, p array<double>")
    row = vote(train, test, "id", "p", "y").first()
    assert row["score"] == pytest.approx(2 / 3) and row["prediction"] == 1.0


@pytest.fixture(scope="module")
def people(spark):
    """Customer rows whose label follows from two of the features."""
    n = 400
    df = spark.range(n).withColumn("u", F.rand(7)).withColumn("v", F.rand(8))
    numbers = {c: (F.rand(i + 20) * 10).alias(c) for i, c in enumerate(feat.RFM + feat.BEHAVIOUR)}
    numbers["avg_monetary"] = (F.col("u") * 100).alias("avg_monetary")
    numbers["avg_review_score"] = F.when(F.col("id") % 5 != 0, F.col("v")).alias("avg_review_score")
    return df.select(
        F.col("id").alias(PERSON),
        *numbers.values(),
        F.when(F.col("u") + F.col("v") / 4 > 0.6, "SP").otherwise("RJ").alias("customer_state"),
        F.concat(F.lit("city"), F.col("id") % 7).alias("customer_city"),
        (F.col("u") + F.col("v") / 4 > 0.6).cast("int").alias(feat.LABEL),
    )


@pytest.mark.parametrize("kind", ["Logistic Regression", "Random Forest", "Gradient Boosting", "HistGradientBoosting", "XGBoost", "MLPClassifier"])
def test_every_classifier_learns(spark, people, kind):
    train, test = cls.split(people)
    stages = cls.preprocessing(feat.FEATURE_SETS["B"], train, scale="standard")
    result = cls.run_grid(train, test, [cls.Cell("B", kind, stages, classifier(kind, trees=10, depth=8, max_iter=50))])
    row = result.results.first()
    assert row["error"] is None and row["auc_roc"] > 0.8


def test_grid_records_failures_and_ranks(spark, people):
    train, test = cls.split(people)
    good = cls.preprocessing(feat.RFM + ["avg_monetary"], train, scale="standard")
    broken = cls.preprocessing(["no_such_column"], train.withColumn("no_such_column", F.lit(1.0)))
    cells = [
        cls.Cell("good", "Logistic Regression", good, classifier("Logistic Regression", max_iter=50)),
        cls.Cell("good", "KNeighbors_5", good, None),
        cls.Cell("broken", "Logistic Regression", broken, classifier("Logistic Regression", max_iter=50)),
    ]
    result = cls.run_grid(train, test, cells)
    rows = {(r["config"], r["model"]): r for r in result.results.collect()}
    assert rows["broken", "Logistic Regression"]["error"] and rows["broken", "Logistic Regression"]["auc_pr"] is None
    assert rows["good", "KNeighbors_5"]["auc_roc"] > 0.7
    assert [r["config"] for r in cls.rank(result.results).collect()] == ["good", "good"]
    assert set(result.models) == {("good", "Logistic Regression")}


def test_split_is_disjoint_and_stratified(spark, people):
    train, test = cls.split(people)
    assert train.join(test, PERSON).count() == 0
    assert train.count() + test.count() == people.count()
    ones = people.agg(F.sum(feat.LABEL)).first()[0]
    assert test.agg(F.sum("label")).first()[0] == round(0.2 * ones)


def test_saved_model_scores_alike(spark, people):
    best = cls.best_model(people, 1.0, trees=3)
    path = scratch_path(spark, "test-model")
    save_model(best.model, path)
    rows = people.withColumnRenamed(feat.LABEL, "label")
    a, b = (m.transform(rows).select(PERSON, "probability") for m in (best.model, load_model(path)))
    assert a.exceptAll(b).count() == 0
    weights = best.importances.collect()
    assert sum(r["importance"] for r in weights) == pytest.approx(1.0)
    names = {r["feature"] for r in weights}
    assert {"recency", "customer_state_SP", "customer_city_city3"} <= names
    card = best.card.first()
    assert card["n_features"] == len(weights) == 10 + 2 + 7 and card["sample_size"] == 400


def test_draws_are_seeded_and_in_range():
    a, b = (cls.draw_candidates("Random Forest", 20) for _ in range(2))
    assert a == b
    assert all(100 <= c["trees"] < 500 and 5 <= c["depth"] < 30 and 0.01 <= c["leafShare"] <= 0.49 for c in a)
    assert all(0.01 <= c["C"] <= 10 for c in cls.draw_candidates("Logistic Regression", 20))


def test_random_search_reports_the_best(spark, people):
    train, test = cls.split(people)
    stages = cls.preprocessing(feat.FEATURE_SETS["B"], train, fill="median", scale="robust")
    report, trials = cls.random_search(train, test, ["Logistic Regression"], n_iter=2, folds=2, max_iter=20, stages=stages)
    row = report.first()
    assert row["best_cv"] == max(r["cv_score"] for r in trials.collect())
    assert row["improvement"] == pytest.approx(row["test_auc_pr"] - row["default_auc_pr"])


def test_search_improves_on_the_searched_metric(spark, people):
    train, test = cls.split(people)
    stages = cls.preprocessing(feat.FEATURE_SETS["B"], train, fill="median", scale="robust")
    report, _ = cls.random_search(
        train, test, ["Logistic Regression"], n_iter=1, folds=2, metric="auc_roc", max_iter=20, stages=stages
    )
    row = report.first()
    assert row["improvement"] == pytest.approx(row["test_auc_roc"] - row["default_auc_roc"])
    assert 0 < row["train_time"] < row["search_time"] + row["train_time"]


@pytest.mark.parametrize("wrong", [{"depth": 31}, {"leafShare": 0.5}])
def test_forest_refuses_what_its_trees_cannot_do(spark, people, wrong):
    with pytest.raises(ValueError):
        Forest(**wrong).fit(people)


def test_forest_keeps_the_node_of_each_row(spark, people):
    known = people.withColumnRenamed(feat.LABEL, "label").fillna(0.0, ["monetary", "avg_monetary"])
    rows = enc.assemble(["recency", "monetary", "avg_monetary"]).transform(known).select("features", "label").localCheckpoint()
    plain = RandomForestClassifier(labelCol="label", numTrees=5, maxDepth=12, seed=42, featureSubsetStrategy="sqrt").fit(rows)
    model = Forest(trees=5, depth=12).fit(rows)
    assert model.getCacheNodeIds()
    assert [t.toDebugString.split("\n")[1:] for t in model.trees] == [t.toDebugString.split("\n")[1:] for t in plain.trees]


def test_segment_finds_planted_groups(spark):
    rows = spark.range(300).select(
        F.col("id").alias(PERSON),
        *((F.col("id") % 3 * 50 + F.rand(i)).alias(c) for i, c in enumerate(feat.SEGMENT_NUMERIC)),
        F.when(F.col("id") % 3 == 0, "SP").when(F.col("id") % 3 == 1, "RJ").otherwise("MG").alias("customer_state"),
        F.lit("x").alias("customer_city"),
    )
    result = seg.segment(rows, range(2, 5), max_iter=20)
    assert result.best_k == 3
    sizes = cl.cluster_sizes(result.labelled).collect()
    assert sorted(r["size"] for r in sizes) == [100, 100, 100]
    parts = seg.describe(result)
    assert all(r["percentage"] == 100.0 for r in parts["states"].collect())
    summary = result.pca.first()
    assert summary["components"] <= summary["features"] and summary["explained"] >= 0.95
    costs = [r["inertia"] for r in result.sweep.orderBy("k").collect()]
    assert costs == sorted(costs, reverse=True)


def test_named_segmentations_run(spark):
    shop = read_star_shop(spark, "/root/testdata/sf0.001")
    for name in ("base", "quick", "5pct", "clean"):
        result = studies.segment_customers(shop, name, ks=range(2, 4), starts=1, max_iter=5)
        assert result.labelled.count() > 0 and result.sweep.count() == 2
    assert result.labelled.count() == 150


def test_sampled_study_runs(spark):
    shop = read_star_shop(spark, "/root/testdata/sf0.001")
    rows = studies.labelled_customers(shop, 0.05)
    assert 0 < rows.count() < 150
    result = studies.comparison_study(shop, fraction=1.0, trees=2, depth=8, max_iter=10)
    assert result.results.where("error IS NOT NULL").count() == 0
    assert result.results.count() == 5


def test_evaluator_works_in_cross_validator(spark, people):
    rows = split_by_hash(people.withColumnRenamed(feat.LABEL, "label"), PERSON, "label", [1 / 3] * 3, "fold")
    stages = cls.preprocessing(feat.FEATURE_SETS["A"] + ["avg_monetary"], people, scale="standard")
    model = RidgeLogistic(maxIter=20)
    search = CrossValidator(
        estimator=Pipeline(stages=[*stages, model]),
        estimatorParamMaps=[{model.C: 0.001}, {model.C: 1.0}],
        evaluator=RankingEvaluator("auc_pr"),
        foldCol="fold",
        numFolds=3,
    ).fit(rows)
    assert len(search.avgMetrics) == 2 and max(search.avgMetrics) > 0.8
