"""Predicting who pays in instalments: preprocessing, model grids, random search and the best model."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.functions.hashing import split_by_hash
from custlens.functions.scalars import columns_of
from custlens.operators import encoding as enc, metrics as met, neighbours
from custlens.operators.joins import PERSON
from custlens.operators.models import LABEL, boosting, classifier, scores, Forest, RidgeLogistic
from custlens.operators.network import Network
from custlens.operators.stages import FillMissing, KeepTopLevels, QuantileBins, ScaleColumns, VariancePCA, slot_names
from custlens.plans import features as feat
from custlens.session import in_parallel, materialize, scratch_path

TEST_SHARE = 0.2

# Models of the three experiments, names of the best model and of the preprocessing variants.
GRID_MODELS = ["Logistic Regression", "Random Forest", "Gradient Boosting"]
COMPARED_MODELS = [*GRID_MODELS, "HistGradientBoosting", "MLPClassifier"]
EXPERIMENT_MODELS = [*GRID_MODELS, "KNeighbors_5"]
SEARCHED_MODELS = ["Gradient Boosting", "Random Forest", "Logistic Regression", "MLPClassifier"]
BEST_MODEL, BEST_FEATURES = "Gradient Boosting", "C (RFM + behavioral + geographic)"
PREPROCESSINGS = {
    "StandardScale_OneHot": {"scale": "standard"},
    "RobustScale_OneHot": {"scale": "robust"},
    "StandardScale_OneHotDropFirst": {"scale": "standard", "drop_first": True},
    "KBinsDiscretizer_OneHot": {"bins": 5},
    "Poly2_OneHot": {"degree": 2},
}

# What a cell of a grid may fail with: its columns, parameters or values. A lost cluster is not a cell's failure.
CELL_ERRORS = (AnalysisException, IllegalArgumentException, SparkRuntimeException, ValueError, TypeError, KeyError)

RESULT_SCHEMA = "config string, model string, prepare_time double, train_time double, error string"


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test rows, written once, with the label column named for the models."""
    parts = split_by_hash(rows, PERSON, feat.LABEL, [TEST_SHARE, 1 - TEST_SHARE], "part")
    parts = materialize(parts.withColumnRenamed(feat.LABEL, LABEL), "split")
    return parts.where("part = 1").drop("part"), parts.where("part = 0").drop("part")


def preprocessing(
    columns: Sequence[str],
    rows: DataFrame,
    fill: str = "mean",
    scale: str | None = None,
    drop_first: bool = False,
    bins: int | None = None,
    degree: int | None = None,
    top: int | None = None,
    variance: float | None = None,
) -> list:
    """Stages from raw columns to ``features``, every statistic fitted on the training rows only."""
    numeric = [c for c in columns if c in columns_of(rows, numeric=True)]
    strings = [c for c in columns if c in columns_of(rows, numeric=False)]
    stages: list = [FillMissing(inputCols=numeric, strategy=fill, fallback=0.0)]
    if strings:
        stages.append(FillMissing(inputCols=strings, strategy="mode", fallback="Unknown"))
    if strings and top:
        stages.append(KeepTopLevels(inputCols=strings, top=top))
    if scale:
        stages.append(ScaleColumns(inputCols=numeric, method=scale))
    blocks = list(numeric)
    if bins:
        stages.append(QuantileBins(inputCols=numeric, bins=bins))
        more, blocks = enc.bin_stages(numeric)
        stages += more
    if degree:
        more, blocks = enc.polynomial_stages(numeric, degree)
        stages += more
    more, encoded = enc.one_hot_stages(strings, drop_first)
    stages += [*more, enc.assemble([*blocks, *encoded], "assembled" if variance else "features")]
    if variance:
        stages.append(VariancePCA(inputCol="assembled", outputCol="features", target=variance))
    return stages


@dataclass(frozen=True)
class Cell:
    """One experiment: a name for its inputs, a model name, and how to score the test rows."""

    config: str
    model: str
    stages: list
    estimator: Estimator | None  # None: nearest neighbours, which have nothing to fit


def grid_cells(
    rows: DataFrame, feature_sets: Sequence[str], models: Sequence[str], top: int | None = None, **settings
) -> list[Cell]:
    """Feature sets by models; set D adds principal components to the columns of set C. ``settings`` go to the models."""
    return [
        Cell(
            name,
            model,
            preprocessing(
                feat.FEATURE_SETS[name],
                rows,
                scale="standard",
                top=10 if name == "D" else top,
                variance=0.95 if name == "D" else None,
            ),
            classifier(model, **settings),
        )
        for name in feature_sets
        for model in models
    ]


def experiment_cells(
    rows: DataFrame,
    configs: Sequence[str] = tuple(PREPROCESSINGS),
    models: Sequence[str] = tuple(EXPERIMENT_MODELS),
    **settings,
) -> list[Cell]:
    """Preprocessing variants by models, over all features. ``settings`` go to the models."""
    return [
        Cell(
            config,
            model,
            preprocessing(feat.FEATURE_SETS["C"], rows, **PREPROCESSINGS[config]),
            None if model == "KNeighbors_5" else classifier(model, **settings),
        )
        for config in configs
        for model in models
    ]


@dataclass
class GridResult:
    results: DataFrame  # one row per cell, failed ones with their error
    scored: DataFrame  # config, model, label, score, prediction of every test row
    models: dict[tuple[str, str], PipelineModel]


def run_grid(train: DataFrame, test: DataFrame, cells: Sequence[Cell], parallelism: int = 4) -> GridResult:
    """Fit every cell and score the test rows; a failing cell is recorded and the rest go on.

    Cells with the same inputs share one fitted preprocessing and one written copy of its
    output. ``parallelism`` cells are fitted at a time, so that small stages of one fill the gaps of
    another; see ``_turn`` for their order. All predictions meet in one table, and one job computes every cell's metrics. ``train_time``
    is that of the fit alone (null where none ended, 0 for neighbours), ``prepare_time`` that of the shared inputs.
    """
    spark = train.sparkSession
    stages = {cell.config: cell.stages for cell in cells}
    prepared = dict(
        zip(
            stages,
            in_parallel(
                [lambda s=s: _timed(lambda: _attempt(lambda: _prepare(s, train, test))) for s in stages.values()],
                parallelism,
            ),
        )
    )

    def run(cell: Cell):
        (ready, error), preparing = prepared[cell.config]
        if error is not None:
            return cell, preparing, (None, error)
        return cell, preparing, _attempt(lambda: _fit_and_score(cell, *ready))

    turns = sorted(range(len(cells)), key=lambda i: _turn(cells[i]))
    ran = dict(zip(turns, in_parallel([lambda c=cells[i]: run(c) for i in turns], parallelism)))
    outcomes, tables, models = [], [], {}
    for cell, preparing, (result, error) in (ran[i] for i in range(len(cells))):
        outcomes.append((cell.config, cell.model, preparing, None if result is None else result[2], error))
        if error is None:
            table, model, _ = result
            tables.append(table)
            if model is not None:
                models[cell.config, cell.model] = model
    if not tables:
        raise RuntimeError(f"every cell failed, the first with: {outcomes[0][3]}")
    scored = reduce(DataFrame.unionByName, tables)
    by = ["config", "model"]
    weighted = met.weighted_report(scored, by=by).withColumnsRenamed(
        {c: f"weighted_{c}" for c in ("precision", "recall", "f1")}
    )
    results = (
        spark.createDataFrame(outcomes, RESULT_SCHEMA)
        .join(met.ranking_metrics(scored, by=by), by, "left")
        .join(met.binary_metrics(scored, by=by), by, "left")
        .join(weighted, by, "left")
    )
    return GridResult(results, scored, models)


def _turn(cell: Cell) -> int:
    """Place of a cell in the order of the fits.

    A regression is many short jobs, each of which waits for the tasks that others have queued before it, so it goes first; then come
    the neighbours, which take the longest, then the rest.
    """
    return 0 if isinstance(cell.estimator, RidgeLogistic) else 1 if cell.estimator is None else 2


def _attempt(task: Callable) -> tuple:
    """``(result, None)``, or ``(None, first line of the error)``: a failure belongs to its cell only."""
    try:
        return task(), None
    except CELL_ERRORS as failure:
        return None, (str(failure).splitlines() or [type(failure).__name__])[0]


def _timed(task: Callable) -> tuple:
    """The task's result and the seconds it took."""
    started = time.perf_counter()
    return task(), time.perf_counter() - started


def _fit_and_score(cell: Cell, prep: PipelineModel, train: DataFrame, test: DataFrame) -> tuple:
    if cell.estimator is None:
        model, predicted, elapsed = None, _neighbour_scores(train, test), 0.0
    else:
        fitted, elapsed = _timed(lambda: cell.estimator.fit(train))
        model, predicted = PipelineModel([*prep.stages, fitted]), scores(fitted.transform(test))
    names = [F.lit(cell.config).alias("config"), F.lit(cell.model).alias("model")]
    return materialize(predicted.select(*names, "*"), "scored"), model, elapsed


def rank(results: DataFrame, metric: str = "auc_pr", n: int = 10) -> DataFrame:
    """The best ``n`` successful cells, names breaking ties."""
    return results.where("error IS NULL").orderBy(F.desc(metric), "config", "model").limit(n)


def _prepare(stages: list, train: DataFrame, test: DataFrame) -> tuple[PipelineModel, DataFrame, DataFrame]:
    prep = Pipeline(stages=stages).fit(train)
    keep = [PERSON, LABEL, "features"]
    # The written copies keep the slot names of the vector, which are part of the schema.
    ready = [materialize(prep.transform(part).select(*keep), "prepared") for part in (train, test)]
    return prep, ready[0], ready[1]


def _neighbour_scores(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    train, test = (part.withColumn("point", vector_to_array("features")) for part in (train, test))
    voted = neighbours.vote(train, test, PERSON, "point", LABEL, k)
    return voted.select(F.col(LABEL).cast("int").alias(LABEL), "score", "prediction")


# --- random search --------------------------------------------------------------------------------------


def draw_candidates(kind: str, n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded draws of a model's parameters.

    The solver of the regression, which does not change its optimum, is not drawn. Leaf shares end at 0.49, as
    Spark's must be below one half.
    """
    rng = random.Random(seed)

    def uniform(low: float, width: float) -> float:
        return rng.uniform(low, low + width)

    def log_uniform(low: float, high: float) -> float:
        return math.exp(rng.uniform(math.log(low), math.log(high)))

    # Ranges of the search.
    spaces: dict[str, Callable[[], dict]] = {
        "Gradient Boosting": lambda: {
            "rate": uniform(0.01, 0.2),
            "trees": rng.randrange(100, 500),
            "depth": rng.randrange(3, 10),
            "subsample": uniform(0.6, 0.4),
            "subset": uniform(0.6, 0.4),
        },
        "Random Forest": lambda: {
            "trees": rng.randrange(100, 500),
            "depth": rng.randrange(5, 30),
            "splitShare": uniform(0.01, 0.5),
            "leafShare": uniform(0.01, 0.48),
            "subset": uniform(0.6, 0.4),
        },
        "Logistic Regression": lambda: {"C": log_uniform(0.01, 10.0)},
        "MLPClassifier": lambda: {
            "hidden": rng.choice([[50], [100], [50, 50]]),
            "activation": rng.choice(["relu", "tanh"]),
            "decay": log_uniform(1e-5, 1e-1),
            "rate": log_uniform(1e-4, 1e-1),
        },
    }
    return [spaces[kind]() for _ in range(n)]


def build(kind: str, params: Mapping, max_iter: int | None = None) -> Estimator:
    """The model with drawn parameters; ``max_iter`` as for ``classifier``."""
    if kind == "Gradient Boosting":
        return boosting(**params)
    if kind == "Random Forest":
        return Forest(**{**params, "subset": f"{params['subset']:.6f}"})
    if kind == "Logistic Regression":
        return RidgeLogistic(C=params["C"], maxIter=max_iter)
    if kind == "MLPClassifier":
        return Network(labelCol=LABEL, maxIter=max_iter, **params)
    raise ValueError(f"no search space for {kind}")


SEARCH_SCHEMA = """model string, best_params string, best_cv double, test_auc_roc double, test_auc_pr double,
    default_auc_roc double, default_auc_pr double, improvement double, train_time double, search_time double"""


def random_search(
    train: DataFrame,
    test: DataFrame,
    kinds: Sequence[str],
    n_iter: int = 5,
    folds: int = 3,
    metric: str = "auc_pr",
    stages: list | None = None,
    parallelism: int | None = None,
    max_iter: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Best drawn parameters per model against its defaults on the test rows, and every trial.

    Folds are stratified. Preprocessing is fitted inside each fold, once for all candidates, so nothing leaks from the
    validation rows and no candidate repeats it. All (model, draw, fold) trials stand in one queue, the longest first, of
    which ``parallelism`` run at a time (one per core without it). Their predictions meet in one table, and one query
    scores all of them. ``train_time`` is the fit of the best parameters on all training rows, ``search_time`` the
    seconds that the fits of a model's trials took in all; ``max_iter`` holds for tuned and default models.
    """
    spark = train.sparkSession
    parallelism = parallelism or spark.sparkContext.defaultParallelism
    stages = stages or preprocessing(feat.FEATURE_SETS["C"], train, fill="median", scale="robust")
    folded = materialize(split_by_hash(train, PERSON, LABEL, [1 / folds] * folds, "fold"), "folds")
    parts = [(folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)) for i in range(folds)]
    ready = in_parallel([lambda p=p: _prepare(stages, *p)[1:] for p in [*parts, (train, test)]], parallelism)
    draws = {(kind, i): params for kind in kinds for i, params in enumerate(draw_candidates(kind, n_iter))}
    queue = [(kind, i, fold) for kind, i in draws for fold in range(folds)]
    estimators = {trial: build(trial[0], draws[trial[:2]], max_iter) for trial in queue}
    queue.sort(key=lambda trial: -_work(draws[trial[:2]]))
    values, seconds = _run_trials(queue, estimators, ready[:folds], metric, parallelism)

    means = {key: sum(values[(*key, fold)][metric] for fold in range(folds)) / folds for key in draws}
    # A fold with one class has no score: such a candidate is the worst, not the best.
    worth = {key: -math.inf if math.isnan(mean) else mean for key, mean in means.items()}
    best = {kind: max(range(n_iter), key=lambda i: worth[kind, i]) for kind in kinds}
    finals = {(kind, "tuned", 0): build(kind, draws[kind, best[kind]], max_iter) for kind in kinds}
    finals |= {(kind, "default", 0): classifier(kind, max_iter=max_iter) for kind in kinds}
    tests, training = _run_trials(list(finals), finals, ready[folds:], metric, parallelism)
    reports = []
    for kind in kinds:
        tuned, default = tests[kind, "tuned", 0], tests[kind, "default", 0]
        reports.append(
            (
                kind,
                json.dumps(draws[kind, best[kind]], sort_keys=True),
                means[kind, best[kind]],
                tuned["auc_roc"],
                tuned["auc_pr"],
                default["auc_roc"],
                default["auc_pr"],
                tuned[metric] - default[metric],
                training[kind, "tuned", 0],
                sum(spent for trial, spent in seconds.items() if trial[0] == kind),
            )
        )
    trials = [(kind, json.dumps(draws[kind, i], sort_keys=True), mean) for (kind, i), mean in means.items()]
    return (
        spark.createDataFrame(reports, SEARCH_SCHEMA),
        spark.createDataFrame(trials, "model string, params string, cv_score double"),
    )


def _work(params: Mapping) -> float:
    """Rough size of a fit, to start long ones first."""
    return params.get("trees", 1) * params.get("depth", 1) + 50 * sum(params.get("hidden", []))


def _run_trials(queue: list, estimators: Mapping, ready: list, metric: str, parallelism: int) -> tuple[dict, dict]:
    """Metrics and seconds of fitting of each (model, draw, fold); ``ready`` has the rows of each fold."""
    path = scratch_path(SparkSession.active(), "trials")

    def run(place: int, trial: tuple) -> float:
        rows, held = ready[trial[2]]
        model, spent = _timed(lambda: estimators[trial].fit(rows))
        scores(model.transform(held)).write.parquet(f"{path}/trial={place}")
        return spent

    spent = in_parallel([lambda p=p, t=t: run(p, t) for p, t in enumerate(queue)], parallelism)
    scored = SparkSession.active().read.parquet(path)
    found = {row["trial"]: row for row in met.ranking_metrics(scored, by=["trial"]).collect()}
    number = lambda row, name: math.nan if row is None or row[name] is None else row[name]
    values = {t: {name: number(found.get(p), name) for name in ("auc_roc", "auc_pr")} for p, t in enumerate(queue)}
    return values, dict(zip(queue, spent))


# --- the best model -------------------------------------------------------------------------------------


@dataclass
class BestModel:
    model: PipelineModel
    scored: DataFrame
    card: DataFrame
    importances: DataFrame
    roc: DataFrame


def best_model(rows: DataFrame, fraction: float, trees: int = 100) -> BestModel:
    """Gradient boosting over all features: its metrics record, importances and ROC points."""
    train, test = split(rows)
    columns = feat.FEATURE_SETS["C"]
    stages = preprocessing(columns, train, fill="median", scale="robust")
    prep, ready_train, ready_test = _prepare(stages, train, test)
    fitted = classifier(BEST_MODEL, trees).fit(ready_train)
    scored = materialize(scores(fitted.transform(ready_test), PERSON), "scored")
    names = slot_names(ready_train, "features")
    spark = rows.sparkSession
    strings = [c for c in columns if c in columns_of(rows, numeric=False)]
    counts = {
        "sample_size": rows.count(),
        "n_features": len(names),
        "n_numeric": len(columns) - len(strings),
        "n_categorical": len(strings),
        "n_cat_after_onehot": len(names) - (len(columns) - len(strings)),
    }
    card = met.ranking_metrics(scored).select(
        F.lit(BEST_MODEL).alias("model"),
        F.lit(BEST_FEATURES).alias("feature_set"),
        "auc_roc",
        "auc_pr",
        F.lit(fraction).alias("sample_frac"),
        *(F.lit(value).alias(name) for name, value in counts.items()),
    )
    return BestModel(
        PipelineModel([*prep.stages, fitted]), scored, card, importances(spark, fitted, names), met.roc_points(scored)
    )


def importances(spark: SparkSession, fitted, names: Sequence[str]) -> DataFrame:
    """Importance per feature name, one row for every slot of the vector."""
    weights = fitted.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, weights)), "feature string, importance double")


def top_importances(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)
