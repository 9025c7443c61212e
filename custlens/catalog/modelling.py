"""Queries that fit something: components, segments, classifiers, searches; and the sinks.

Every query reads all rows and fits models of full size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from custlens.catalog.base_sql import with_views
from custlens.catalog.preparation import _CLUSTERED, _HASH, _clean, _clustered
from custlens.catalog.registry import query
from custlens.functions.hashing import in_sample
from custlens.operators import clustering as cl, encoding as enc, neighbours
from custlens.operators.joins import PERSON
from custlens.operators.models import classifier, scores
from custlens.operators.stages import slot_names
from custlens.plans import classification as cls, features as feat, segmentation as seg
from custlens.session import materialize, scratch_path
from custlens.sources import read_star_shop
from custlens.sources.sinks import CSV_OPTIONS, load_model, save_model, write_table


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(feat.bnpl_features(read_star_shop(spark, folder)), "labelled")


# --- components and segments -----------------------------------------------------------------------------


def _reduced(column: str) -> str:
    """The column with its ten most frequent levels, the rest under one name, as SQL."""
    return f"""CASE WHEN {column} IN (SELECT {column} FROM fc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
               THEN {column} ELSE '{seg.OTHERS[column]}' END"""


@query(
    "assemble",
    with_views(
        "fc",
        "reduced AS (SELECT *, " + ", ".join(f"{_reduced(c)} AS r_{c}" for c in feat.GEOGRAPHY) + " FROM fc)",
        query="SELECT customer_unique_id, CAST("
        + " + ".join(
            [
                f"""CAST(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM fc)) <> 0
                    AND (SELECT count(DISTINCT {c}) FROM fc) > 1 AS INTEGER)"""
                for c in feat.SEGMENT_NUMERIC
            ]
            + [f"CAST(r_{c} > (SELECT min(r_{c}) FROM reduced) AS INTEGER)" for c in feat.GEOGRAPHY]
        )
        + " AS INTEGER) AS filled FROM reduced",
    ),
)
def assemble(spark: SparkSession, folder: str) -> DataFrame:
    """Assembled vectors: how many slots each has filled."""
    rows = _clean(spark, folder)
    ready = seg.preparation(variance=None).fit(rows).transform(rows)
    filled = F.filter(vector_to_array("features"), lambda v: v != 0)
    return ready.select(PERSON, F.size(filled).alias("filled"))


_NAMED = feat.RFM + feat.BEHAVIOUR


@query(
    "feature_names",
    with_views(
        "f3",
        query="SELECT feature, filled FROM ("
        + " UNION ALL ".join(
            [
                f"""SELECT '{c}' AS feature, count(*) FILTER (coalesce({c}, m) <> m) AS filled
                    FROM f3 CROSS JOIN (SELECT quantile_cont({c}, 0.5) AS m FROM f3)"""
                for c in _NAMED
            ]
            + [f"SELECT '{c}_' || {c}, count(*) FROM f3 GROUP BY {c}" for c in feat.GEOGRAPHY]
        )
        + ") WHERE filled > 0",
    ),
)
def feature_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each slot of the assembled training vector by name, with how many rows fill it."""
    rows = _labelled(spark, folder).withColumnRenamed(feat.LABEL, "label")
    stages = cls.preprocessing(feat.FEATURE_SETS["C"], rows, fill="median", scale="robust")
    _, ready, _ = cls._prepare(stages, rows, rows)
    long = enc.long_form(ready, PERSON, "features", slot_names(ready, "features"))
    return long.groupBy("feature").agg(F.count("*").alias("filled"))


@query("pca_variance")
def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    ready = seg.preparation(variance=0.9).fit(rows).transform(rows)
    return ready.select(PERSON, vector_to_array("features").alias("components"))


@query("pca_fixed")
def pca_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    ready = seg.preparation(variance=None, components=10).fit(rows).transform(rows)
    return ready.select(PERSON, vector_to_array("features").alias("components"))


@query("pca_summary")
def pca_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    summaries = [seg.pca_summary(spark, seg.preparation(variance=v).fit(rows)) for v in (0.9, 0.95)]
    return summaries[0].unionByName(summaries[1])


@query("pca_train_test")
def pca_train_test(spark: SparkSession, folder: str) -> DataFrame:
    train, test = cls.split(_labelled(spark, folder))
    stages = cls.preprocessing(feat.FEATURE_SETS["D"], train, scale="standard", top=10, variance=0.95)
    _, _, ready = cls._prepare(stages, train, test)
    return ready.select(PERSON, "label", vector_to_array("features").alias("components"))


@query(
    "pca_check",
    with_views(
        "fc",
        query="SELECT unnest(['0.9', '10']) AS kept, (SELECT count(*) FROM fc) AS n_rows, true AS uncorrelated, "
        "true AS ordered, true AS share",
    ),
)
def pca_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether components are uncorrelated, come by falling variance, and keep the share asked for (nothing less would)."""
    rows, out = _clean(spark, folder), None
    for kept, settings in (("0.9", {"variance": 0.9}), ("10", {"variance": None, "components": 10})):
        fitted = seg.preparation(**settings).fit(rows)
        ratios = list(fitted.stages[-1].explainedVariance)
        n = seg.pca_summary(spark, fitted).first()["components"]
        share = sum(ratios[:n]) >= 0.9 > sum(ratios[: n - 1]) if kept == "0.9" else n == 10
        point = vector_to_array("features")
        wide = fitted.transform(rows).select(*(point[i].alias(f"c{i}") for i in range(n)))
        pairs = [(i, j) for i in range(n) for j in range(i)]
        variances = [F.var_pop(f"c{i}") for i in range(n)]
        small = [F.abs(F.covar_pop(f"c{i}", f"c{j}")) <= 1e-6 * F.var_pop("c0") for i, j in pairs]
        falling = [a >= b * (1 - 1e-9) for a, b in zip(variances, variances[1:])]
        part = wide.agg(
            F.lit(kept).alias("kept"),
            F.count("*").alias("n_rows"),
            reduce(and_, small).alias("uncorrelated"),
            reduce(and_, falling).alias("ordered"),
            F.lit(bool(share)).alias("share"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "kmeans_check",
    with_views(
        "fc",
        query="SELECT unnest(range(2, 7))::INTEGER AS k, (SELECT count(*) FROM fc) AS n_rows, "
        "true AS nearest, true AS cost, true AS falling, true AS least",
    ),
)
def kmeans_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per k: whether labels are the nearest centres, the cost is that of the labels, falls with k, and is the least of the starts."""
    rows = _clean(spark, folder)
    vectors = materialize(seg.preparation(variance=0.95).fit(rows).transform(rows).select(PERSON, "features"), "vectors")
    point, out, before = vector_to_array("features"), None, float("inf")
    for k in range(2, 7):
        model = cl.fit_kmeans(vectors, k, 3, 100)
        single = cl.fit_kmeans(vectors, k, 1, 100).summary.trainingCost
        centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
        square = lambda c: F.aggregate(F.zip_with(point, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
        far = model.transform(vectors).withColumn("far", F.transform(centres, square))
        own = F.get("far", F.col("cluster"))
        cost = model.summary.trainingCost
        part = far.agg(
            F.lit(k).alias("k"),
            F.count("*").alias("n_rows"),
            F.bool_and(own <= F.array_min("far") * (1 + 1e-6) + 1e-9).alias("nearest"),
            (F.abs(F.sum(own) - cost) <= 1e-6 * cost).alias("cost"),
            F.lit(cost <= before * 1.02).alias("falling"),
            F.lit(cost <= single * (1 + 1e-9)).alias("least"),
        )
        before, out = cost, part if out is None else out.unionByName(part)
    return out


@query("kmeans_full")
def kmeans_full(spark: SparkSession, folder: str) -> DataFrame:
    """The first recipe: z-scored numbers beside plain state dummies, ten starts per k, no components."""
    rows = feat.features_v1(read_star_shop(spark, folder))
    pipeline = seg.preparation(
        feat.SEGMENT_NUMERIC[:9], ["customer_state"], top=None, variance=None, scale_all=False
    )
    return seg.segment(rows, range(2, 7), pipeline, starts=10, max_iter=300).sweep


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_v2(read_star_shop(spark, folder))
    return seg.segment(rows, range(2, 7), seg.preparation(variance=0.95), max_iter=100).sweep


@query("kmeans_best_k")
def kmeans_best_k(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the segment of the best k, over top-10 buckets and 90 % of the variance."""
    rows = feat.features_v3(read_star_shop(spark, folder))
    result = seg.segment(rows, range(2, 5), seg.preparation(variance=0.9), max_iter=30)
    return result.labelled.select(PERSON, "cluster", F.lit(result.best_k).alias("k"))


# --- neighbours --------------------------------------------------------------------------------------------

_POINT = ["recency", "frequency", "spend"]
_IS_TEST = f"{_HASH} < {int(0.2 * 2**60)}"


@query(
    "knn5",
    with_views(
        "fc",
        f"""points AS (SELECT customer_unique_id AS id, bnpl_target AS label, recency::DOUBLE AS x, frequency::DOUBLE AS y,
             monetary / 100000 AS z, {_IS_TEST} AS is_test FROM fc)""",
        query="""SELECT id AS customer_unique_id, avg(label) AS score,
                   CASE WHEN avg(label) > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM (
          SELECT q.id, p.label, row_number() OVER (PARTITION BY q.id ORDER BY
            (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z), p.id) AS place
          FROM points q JOIN points p ON q.is_test AND NOT p.is_test) WHERE place <= 5 GROUP BY 1""",
    ),
)
def knn5(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).withColumn("spend", F.col("monetary") / 100000)
    points = rows.select(
        PERSON, F.col(feat.LABEL).alias("label"), F.array(*(F.col(c).cast("double") for c in _POINT)).alias("point")
    )
    is_test = in_sample(PERSON, 0.2)
    voted = neighbours.vote(points.where(~is_test), points.where(is_test), PERSON, "point", "label")
    return voted.select(PERSON, "score", "prediction")


# --- classifiers -------------------------------------------------------------------------------------------


_made: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable):
    """What ``make`` gives, made once for a folder in an application: queries that look at one fit share it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _feature_grid(spark: SparkSession, folder: str) -> cls.GridResult:
    def make() -> cls.GridResult:
        train, test = cls.split(_labelled(spark, folder))
        return cls.run_grid(train, test, cls.grid_cells(train, list("ABCD"), cls.GRID_MODELS))

    return _once(spark, folder, "feature sets", make)


def _preprocessing_grid(spark: SparkSession, folder: str) -> cls.GridResult:
    def make() -> cls.GridResult:
        train, test = cls.split(_labelled(spark, folder))
        return cls.run_grid(train, test, cls.experiment_cells(train))

    return _once(spark, folder, "preprocessings", make)


def _comparison(spark: SparkSession, folder: str) -> cls.GridResult:
    def make() -> cls.GridResult:
        train, test = cls.split(_labelled(spark, folder))
        stages = cls.preprocessing(feat.FEATURE_SETS["C"], train, fill="median", scale="robust")
        cells = [cls.Cell("C", name, stages, classifier(name)) for name in [*cls.COMPARED_MODELS, "XGBoost"]]
        return cls.run_grid(train, test, cells)

    return _once(spark, folder, "models", make)


def _best(spark: SparkSession, folder: str) -> cls.BestModel:
    return _once(spark, folder, "best", lambda: cls.best_model(_labelled(spark, folder), fraction=1.0))


def _search(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Report and trials of the search."""

    def make() -> tuple[DataFrame, DataFrame]:
        train, test = cls.split(_labelled(spark, folder))
        report, trials = cls.random_search(train, test, cls.SEARCHED_MODELS)
        return materialize(report, "search-report"), materialize(trials, "search-trials")

    return _once(spark, folder, "search", make)


@query("grid_feature_sets")
def grid_feature_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _feature_grid(spark, folder).results.withColumnsRenamed({"config": "feature_set", "auc_roc": "auc"})


@query("grid_preprocessing")
def grid_preprocessing(spark: SparkSession, folder: str) -> DataFrame:
    return _preprocessing_grid(spark, folder).results


@query("rank_experiments")
def rank_experiments(spark: SparkSession, folder: str) -> DataFrame:
    return cls.rank(_feature_grid(spark, folder).results, "auc_pr", 10)


@query("model_comparison")
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Five models and the boosting preset over all features, with the ROC points of each."""
    result = _comparison(spark, folder)
    points = cls.met.roc_points(result.scored, by=["model"])
    return points.join(result.results.select("model", "auc_roc", "auc_pr", "train_time"), "model")


_TESTED = """labels_only AS (SELECT customer_unique_id, max(payment_installments) AS most FROM w3 GROUP BY 1),
tested AS (
  SELECT label, round(0.2 * count(*)) AS n
  FROM (SELECT CAST(most >= 2 AS INTEGER) AS label FROM f3 JOIN labels_only USING (customer_unique_id)) GROUP BY label)"""


@query(
    "grid_check",
    with_views(
        "f3",
        _TESTED,
        query="SELECT study, cells::BIGINT AS cells, 0::BIGINT AS failed, "
        "CAST(cells * (SELECT sum(n) FROM tested) AS BIGINT) AS scored_rows, true AS auc, true AS accuracy FROM "
        "(VALUES ('feature sets', 12), ('preprocessings', 20), ('models', 6)) v(study, cells)",
    ),
)
def grid_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per study: cells, failures, scored test rows, and whether AUC (by ranks) and accuracy follow from those rows."""
    by, out = ["config", "model"], None
    for study, grid in (
        ("feature sets", _feature_grid(spark, folder)),
        ("preprocessings", _preprocessing_grid(spark, folder)),
        ("models", _comparison(spark, folder)),
    ):
        ranked = grid.scored.withColumn("below", F.rank().over(W.partitionBy(*by).orderBy("score")) - 1)
        ranked = ranked.withColumn("ties", F.count("*").over(W.partitionBy(*by, "score")))
        ones = F.sum("label")
        auc = (F.sum(F.col("label") * (F.col("below") + (F.col("ties") + 1) / 2)) - ones * (ones + 1) / 2) / (
            ones * (F.count("*") - ones)
        )
        again = ranked.groupBy(*by).agg(
            F.count("*").alias("rows"),
            auc.alias("auc_again"),
            F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy_again"),
        )
        near = lambda a, b: F.bool_and(F.abs(F.col(a) - F.col(b)) < 1e-9)
        part = grid.results.join(again, by, "left").agg(
            F.lit(study).alias("study"),
            F.count("*").alias("cells"),
            F.count("error").alias("failed"),
            F.sum("rows").alias("scored_rows"),
            near("auc_roc", "auc_again").alias("auc"),
            near("accuracy", "accuracy_again").alias("accuracy"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("random_search")
def random_search(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder)[1]


@query("tuning_report")
def tuning_report(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder)[0]


@query(
    "search_check",
    "SELECT unnest(['Gradient Boosting', 'Random Forest', 'Logistic Regression', 'MLPClassifier']) AS model, "
    "5::BIGINT AS draws, 5::BIGINT AS settings, 1::BIGINT AS best, true AS scored, true AS improvement",
)
def search_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per model of the search: its draws, how many of them are the reported best, and whether the report adds up."""
    report, trials = _search(spark, folder)
    rows = trials.join(report, "model")
    is_best = (F.col("params") == F.col("best_params")) & (F.col("cv_score") == F.col("best_cv"))
    shares = [F.col(c).between(0, 1) for c in ("cv_score", "test_auc_roc", "test_auc_pr", "default_auc_roc", "default_auc_pr")]
    return rows.groupBy("model").agg(
        F.count("*").alias("draws"),
        F.count_distinct("params").alias("settings"),
        F.count_if(is_best & (F.col("cv_score") == F.col("best_cv"))).alias("best"),
        F.bool_and(reduce(and_, shares) & (F.col("cv_score") <= F.col("best_cv"))).alias("scored"),
        F.bool_and(F.col("improvement") == F.col("test_auc_pr") - F.col("default_auc_pr")).alias("improvement"),
    )


@query("model_card")
def model_card(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics record of the best model, as read back from its JSON file."""
    card = _best(spark, folder).card
    path = scratch_path(spark, "card")
    write_table(card, path, "json")
    return spark.read.schema(card.schema).json(path)


@query("feature_importance")
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder).importances


@query("topk_importances")
def topk_importances(spark: SparkSession, folder: str) -> DataFrame:
    return cls.top_importances(_best(spark, folder).importances, 20)


@query(
    "best_model_check",
    with_views(
        "f3",
        _TESTED,
        query="SELECT (SELECT count(*) FROM f3) AS sample_size, CAST((SELECT sum(n) FROM tested) AS BIGINT) AS scored_rows, "
        "20::BIGINT AS top, true AS names, true AS weights, true AS area",
    ),
)
def best_model_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the best model's record, importances and ROC points agree with each other and with the scored rows."""
    best = _best(spark, folder)
    step = W.orderBy("fpr", "tpr")
    strip = (F.col("fpr") - F.lag("fpr").over(step)) * (F.col("tpr") + F.lag("tpr").over(step)) / 2
    area = best.roc.select(strip.alias("strip")).agg(F.sum("strip").alias("area"))
    weights = best.importances.agg(
        F.sum("importance").alias("total"), F.min("importance").alias("least"), F.count_distinct("feature").alias("names")
    )
    top = cls.top_importances(best.importances, 20).agg(F.count("*").alias("top"))
    counted = best.scored.agg(F.count("*").alias("scored_rows"))
    return best.card.crossJoin(area).crossJoin(weights).crossJoin(top).crossJoin(counted).select(
        F.col("sample_size").cast("long").alias("sample_size"),
        "scored_rows",
        "top",
        (F.col("names") == F.col("n_features")).alias("names"),
        ((F.abs(F.col("total") - 1) < 1e-9) & (F.col("least") >= 0)).alias("weights"),
        (F.abs(F.col("area") - F.col("auc_roc")) < 1e-9).alias("area"),
    )


# --- sinks -------------------------------------------------------------------------------------------------


@query(
    "sink_roundtrip",
    with_views(
        "fc",
        _CLUSTERED,
        query=" UNION ALL ".join(
            f"""SELECT '{fmt}' AS format, count(*) AS n_rows, CAST(sum(frequency) AS BIGINT) AS frequency,
                CAST(sum(recency) AS BIGINT) AS recency, CAST(sum(cluster) AS BIGINT) AS cluster,
                count(DISTINCT monetary) AS amounts, count(avg_review_score) AS scored, count(customer_city) AS cities,
                min(customer_city) AS first_city, max(customer_unique_id) AS last_person FROM clustered"""
            for fmt in ("parquet", "csv", "json")
        ),
    ),
)
def sink_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clustered(spark, folder)
    result = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"sink-{fmt}")
        write_table(rows, path, fmt)
        reader = spark.read.schema(rows.schema).format(fmt)
        back = (reader.options(**CSV_OPTIONS) if fmt == "csv" else reader).load(path)
        part = back.agg(
            F.lit(fmt).alias("format"),
            F.count("*").alias("n_rows"),
            F.sum("frequency").alias("frequency"),
            F.sum("recency").alias("recency"),
            F.sum("cluster").alias("cluster"),
            F.count_distinct("monetary").alias("amounts"),
            F.count("avg_review_score").alias("scored"),
            F.count("customer_city").alias("cities"),
            F.min("customer_city").alias("first_city"),
            F.max(PERSON).alias("last_person"),
        )
        result = part if result is None else result.unionByName(part)
    return result


@query("sink_results")
def sink_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result, importance and ROC tables of one best model, written as CSV and counted on return."""
    best = _best(spark, folder)
    result = None
    for name, table in {"card": best.card, "importances": best.importances, "roc": best.roc}.items():
        path = scratch_path(spark, name)
        write_table(table, path, "csv")
        back = spark.read.schema(table.schema).options(**CSV_OPTIONS).csv(path)
        part = back.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        result = part if result is None else result.unionByName(part)
    return result


@query("model_roundtrip", with_views("f3", query="SELECT count(*) AS n_rows, count(*) AS n_equal FROM f3"))
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a pipeline before and after it was saved and loaded."""
    rows = _labelled(spark, folder).withColumnRenamed(feat.LABEL, "label")
    model = _best(spark, folder).model
    path = scratch_path(spark, "model")
    save_model(model, path)
    before = scores(model.transform(rows), PERSON)
    after = scores(load_model(path).transform(rows), PERSON).withColumnRenamed("score", "loaded_score")
    return before.join(after.select(PERSON, "loaded_score"), PERSON).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("score") == F.col("loaded_score")).alias("n_equal")
    )
