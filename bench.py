"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from custlens.catalog import QUERIES
from custlens.functions.quantiles import collect_quantiles
from custlens.operators.models import boosting
from custlens.plans import classification as cls, features as feat, segmentation as seg
from custlens.session import build_session, materialize
from custlens.sources import read_star_shop

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

HEADLINE = [
    "features_clean",
    "features_v1",
    "features_v2",
    "features_v3",
    "bnpl_features",
    "wide_v2",
    "distinct_counts",
    "mode_state_city",
    "profile_overview",
    "impute_median",
    "stratified_split",
    "robust_scale",
    "silhouette_sq",
    "roc_curve",
    "knn5",
]


def write_out(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "custlens-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action):
        started = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - started, 3)
        return result

    write_out(QUERIES["scan_pruned"](spark, FOLDER))  # start the workers before the clock runs
    for name in HEADLINE:
        timed(name, lambda: write_out(QUERIES[name](spark, FOLDER)))

    shop = read_star_shop(spark, FOLDER)
    clean = materialize(feat.features_clean(shop), "bench-clean")
    timed("exact_medians", lambda: collect_quantiles(clean, feat.SEGMENT_NUMERIC, [0.5]))
    timed("k_sweep_2_to_6", lambda: seg.segment(clean, range(2, 7)).sweep.collect())
    labelled = materialize(feat.bnpl_features(shop), "bench-labelled")
    train, test = cls.split(labelled)
    stages = cls.preprocessing(feat.FEATURE_SETS["C"], train, fill="median", scale="robust", top=10)
    _, ready, _ = cls._prepare(stages, train, test)
    timed("gradient_boosting_100x3", lambda: boosting().fit(ready))
    timed("logistic_regression", lambda: cls.classifier("Logistic Regression").fit(ready))

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
