"""The ready-made runs: customer segmentations and instalment studies, with their usual settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from custlens.functions.hashing import in_sample
from custlens.operators.joins import PERSON
from custlens.operators.models import classifier
from custlens.operators.profile import overview
from custlens.plans import classification as cls, features as feat, segmentation as seg
from custlens.sources import Shop, discover_tables


@dataclass(frozen=True)
class SegmentRecipe:
    """Settings of one segmentation run."""

    features: str
    ks: range
    people: float = 1.0  # share of customer rows whose people are kept, before any join
    rows: float = 1.0  # share of finished customer rows that are kept
    strings: tuple = tuple(feat.GEOGRAPHY)
    top: int | None = None
    variance: float | None = 0.95
    components: int | None = None
    scale_all: bool = True
    starts: int = 1
    max_iter: int = 20


# The settings of each segmentation.
SEGMENT_RECIPES = {
    "base": SegmentRecipe(
        "v1", range(2, 7), strings=("customer_state",), variance=None, scale_all=False, starts=10, max_iter=300
    ),
    "efficient": SegmentRecipe("v2", range(2, 7), top=10, max_iter=100),
    "pca": SegmentRecipe("v2", range(2, 7), max_iter=100),
    "quick": SegmentRecipe("v2", range(2, 6), rows=0.1, variance=None, components=10),
    "optimized": SegmentRecipe("v2", range(2, 6), rows=0.01),
    "sampled": SegmentRecipe("v3", range(2, 6), people=0.001),
    "final": SegmentRecipe("v3", range(2, 6), people=0.005),
    "5pct": SegmentRecipe("v3", range(2, 5), people=0.05, variance=0.9, max_iter=30),
    "larger": SegmentRecipe("v3", range(2, 6), people=0.1),
    "clean": SegmentRecipe("clean", range(2, 7), top=10, max_iter=100),
}


def segment_customers(shop: Shop, recipe: str | SegmentRecipe = "clean", **changes) -> seg.Segmentation:
    """Run a named segmentation, optionally with some settings changed."""
    plan = replace(SEGMENT_RECIPES[recipe] if isinstance(recipe, str) else recipe, **changes)
    if plan.people < 1:
        shop = feat.sample_shop(shop, plan.people)
    rows = feat.RECIPES[plan.features](shop)
    key = "customer_id" if plan.features == "v1" else PERSON
    if plan.rows < 1:
        rows = rows.where(in_sample(key, plan.rows))
    numeric = [c for c in feat.SEGMENT_NUMERIC if c in rows.columns]
    pipeline = seg.preparation(
        numeric, plan.strings, plan.top, plan.variance, plan.components, plan.scale_all
    )
    return seg.segment(rows, plan.ks, pipeline, plan.starts, plan.max_iter)


def profile_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", fmt: str = "csv") -> DataFrame:
    """Profile of every table in a folder, one row per column, and one row with the error of each unreadable table."""
    tables, errors = discover_tables(spark, folder, pattern, fmt)
    failed = spark.createDataFrame(sorted(errors.items()), "table_name string, error string")
    return overview(tables).unionByName(failed, allowMissingColumns=True) if tables else failed


def labelled_customers(shop: Shop, fraction: float = 0.05) -> DataFrame:
    """The classifiers' rows, for the people behind a share of the customer rows."""
    return feat.bnpl_features(feat.sample_shop(shop, fraction) if fraction < 1 else shop)


def feature_set_study(shop: Shop, fraction: float = 0.05, **settings) -> cls.GridResult:
    """Feature sets A to D by three models; ``settings`` as for ``classifier``."""
    train, test = cls.split(labelled_customers(shop, fraction))
    return cls.run_grid(train, test, cls.grid_cells(train, list("ABCD"), cls.GRID_MODELS, **settings))


def preprocessing_study(shop: Shop, fraction: float = 0.05, **settings) -> cls.GridResult:
    """Five preprocessings by four models."""
    train, test = cls.split(labelled_customers(shop, fraction))
    return cls.run_grid(train, test, cls.experiment_cells(train, **settings))


def comparison_study(shop: Shop, fraction: float = 0.05, **settings) -> cls.GridResult:
    """Five models over all features; ``metrics.roc_points`` of the scored rows gives their curves."""
    train, test = cls.split(labelled_customers(shop, fraction))
    stages = cls.preprocessing(feat.FEATURE_SETS["C"], train, fill="median", scale="robust")
    cells = [cls.Cell("C", name, stages, classifier(name, **settings)) for name in cls.COMPARED_MODELS]
    return cls.run_grid(train, test, cells)


def tuning_study(
    shop: Shop, metric: str = "auc_pr", fraction: float = 0.05, max_iter: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Random search of four models: five draws each for average precision, ten for ROC-AUC."""
    train, test = cls.split(labelled_customers(shop, fraction))
    n_iter = 5 if metric == "auc_pr" else 10
    return cls.random_search(train, test, cls.SEARCHED_MODELS, n_iter, metric=metric, max_iter=max_iter)


def best_model_study(shop: Shop, fraction: float = 0.1, trees: int = 100) -> cls.BestModel:
    """Boosting over all features, with its record, importances, ROC points and a model to save."""
    return cls.best_model(labelled_customers(shop, fraction), fraction, trees)
