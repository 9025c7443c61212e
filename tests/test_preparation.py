import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from custlens.functions.hashing import in_sample, split_by_hash
from custlens.functions.quantiles import exact_quantiles, key_value, sort_keys
from custlens.functions.scalars import finite_or_zero, parsed_timestamp, whole_days
from custlens.operators import aggregates as agg, encoding as enc
from custlens.operators.profile import null_profile
from custlens.operators.stages import FillMissing, KeepTopLevels, QuantileBins, ScaleColumns, VariancePCA, components_for


@pytest.mark.parametrize("seed,n,gather", [(0, 1, 0), (1, 2, 100), (2, 7, 0), (3, 1000, 20), (4, 40000, 0), (4, 40000, 10000)])
def test_quantiles_are_exact(spark, seed, n, gather):
    rng = np.random.default_rng(seed)
    a = np.round(rng.lognormal(3, 2, n), 2)
    b = np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n))  # one hot value
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(7)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {(r["feature"], r["probability"]): r["value"] for r in exact_quantiles(df, ["a", "b"], probabilities, gather=gather).collect()}
    for name, values in (("a", a), ("b", b)):
        for p in probabilities:
            assert found[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("gather", [0, 100_000])
def test_quantiles_of_odd_values(spark, gather):
    rng = np.random.default_rng(9)
    odd = [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1e308, -1e308, 1.0, np.nextafter(1.0, 2)]
    groups = {"a": odd, None: list(-rng.lognormal(0, 3, 500)), "c": [3.0] * 50}
    rows = [(g, i % 2, float(x)) for g, values in groups.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    probabilities = [0.0, 0.3, 0.5, 1.0]
    found = {(r["g"], r["h"], r["probability"]): r["value"] for r in exact_quantiles(df, ["x"], probabilities, ["g", "h"], gather).collect()}
    assert len(found) == 6 * len(probabilities)
    for (g, h, p), value in found.items():
        own = sorted(x for i, x in enumerate(groups[g]) if i % 2 == h)
        low = own[int(np.floor((len(own) - 1) * p))], own[int(np.ceil((len(own) - 1) * p))]
        place = (len(own) - 1) * p % 1
        want = low[0] + place * (low[1] - low[0])
        assert value == want or (np.isnan(value) and np.isnan(want))


def test_keys_sort_like_the_doubles():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=1000) * 10.0 ** rng.integers(-300, 300, 1000), [0.0, -0.0, np.inf, -np.inf]])
    keys = sort_keys(values)
    assert (values[np.argsort(keys, kind="stable")] == np.sort(values)).all()
    assert all(key_value(int(k)) == v for k, v in zip(keys, values))


def test_quantiles_by_group_skip_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (1, float("nan")), (2, None)], "g int, x double")
    rows = exact_quantiles(df, ["x"], [0.5], by=["g"]).collect()
    assert [(r["g"], r["value"]) for r in rows] == [(1, 2.0)]


def test_split_sizes_are_exact_and_stratified(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 10 == 0).cast("int")).repartition(5)
    parts = split_by_hash(df, "id", "label", [0.2, 0.8], "part")
    sizes = {(r["label"], r["part"]): r["n"] for r in parts.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(0, 0): 180, (0, 1): 722, (1, 0): 20, (1, 1): 81}
    again = split_by_hash(df.repartition(3), "id", "label", [0.2, 0.8], "part")
    assert parts.select("id", "part").exceptAll(again.select("id", "part")).count() == 0


def test_split_of_a_tiny_label(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)], "id long, label int")
    parts = split_by_hash(df, "id", "label", [0.2, 0.8], "part")
    sizes = {(r["label"], r["part"]): r["n"] for r in parts.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    # A fifth of four rounds to one, a fifth of one to none.
    assert sizes == {(0, 0): 1, (0, 1): 3, (1, 1): 1}


def test_sample_share(spark):
    assert spark.range(20000).where(in_sample("id", 0.1)).count() == pytest.approx(2000, rel=0.1)


def test_scalars(spark):
    df = spark.sql(
        """SELECT timestamp_ntz'2020-01-02 23:59:00' AS a, timestamp_ntz'2020-01-02 00:00:00' AS b,
           double('NaN') AS x, double('inf') AS y, CAST(NULL AS double) AS z, 'garbage' AS t"""
    )
    row = df.select(
        whole_days(F.col("a"), F.col("b")),
        whole_days(F.col("b"), F.col("a")),
        *(finite_or_zero(F.col(c)) for c in "xyz"),
        parsed_timestamp(F.col("t")),
    ).first()
    assert tuple(row) == (0, -1, 0.0, 0.0, 0.0, None)


def test_strict_timestamp_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.sql("SELECT 'garbage' AS t").select(parsed_timestamp(F.col("t"), strict=True)).collect()


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None)], "x double, y string")
    rows = {r["column_name"]: (r["null_count"], round(r["null_pct"], 2)) for r in null_profile(df).collect()}
    assert rows == {"x": (2, 66.67), "y": (2, 66.67)}


def test_fill_learns_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (8.0, None)], "x double, y string")
    test = spark.createDataFrame([(None, None), (float("nan"), "z")], "x double, y string")
    for strategy, value in (("mean", 4.0), ("median", 3.0)):
        filled = FillMissing(inputCols=["x"], strategy=strategy).fit(train).transform(test).collect()
        assert [r["x"] for r in filled] == [value, value]
    modes = FillMissing(inputCols=["y"], strategy="mode", fallback="Unknown").fit(train).transform(test).collect()
    assert [r["y"] for r in modes] == ["b", "z"]
    empty = spark.createDataFrame([(None, None)], "x double, y string")
    assert FillMissing(inputCols=["y"], strategy="mode", fallback="missing").fit(empty).transform(empty).first()["y"] == "missing"


def test_scaling_without_spread(spark):
    df = spark.createDataFrame([(2.0, 1.0)] * 5 + [(2.0, 9.0)], "flat double, iqr0 double")
    standard = ScaleColumns(inputCols=["flat"], method="standard").fit(df).transform(df).collect()
    assert {r["flat"] for r in standard} == {0.0}
    robust = ScaleColumns(inputCols=["iqr0"], method="robust").fit(df).transform(df).collect()
    assert sorted(r["iqr0"] for r in robust) == [0.0] * 5 + [8.0]


def test_standard_scale_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert sorted(r["x"] for r in ScaleColumns(inputCols=["x"]).fit(df).transform(df).collect()) == [-1.0, 1.0]


def test_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0] * 8 + [1, 2]], "x double")
    # Edges 0 0 0 0 .2 2: one inner edge is left.
    binned = QuantileBins(inputCols=["x"], bins=5).fit(df).transform(df)
    assert sorted(r["x"] for r in binned.collect()) == [0.0] * 8 + [1.0, 1.0]


def test_top_levels_break_ties_by_name(spark):
    names = [chr(97 + i) for i in range(12)]
    df = spark.createDataFrame([(n,) for n in names for _ in range(2 if n < "j" else 1)] + [(None,)], "c string")
    model = KeepTopLevels(inputCols=["c"], top=10, others={"c": "rest"}).fit(df)
    kept = {r["c"] for r in model.transform(df).collect()}
    assert kept == {*names[:10], "rest"}


def test_one_hot_of_unknown_and_null_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    test = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")

    def vectors(drop_first):
        stages, out = enc.one_hot_stages(["c"], drop_first)
        encoded = Pipeline(stages=stages).fit(train).transform(test)
        return [r[0] for r in encoded.select(vector_to_array(out[0])).collect()]

    assert vectors(False) == [[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0]]
    assert vectors(True) == [[0, 0], [1, 0], [0, 0], [0, 0]]


def test_components_for():
    assert components_for([0.6, 0.3, 0.1], 0.8) == 2
    assert components_for([0.7, 0.25, 0.05], 0.9) == 2
    assert components_for([0.5, 0.5], 1.5) == 2


def test_variance_pca_keeps_distances(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(60, 3)) @ np.diag([5.0, 2.0, 0.01])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double, c double")
    assembled = enc.assemble(["a", "b", "c"], "v").transform(df)
    model = VariancePCA(inputCol="v", outputCol="w", target=0.99).fit(assembled)
    reduced = np.array([r[0] for r in model.transform(assembled).select(vector_to_array("w")).collect()])
    assert reduced.shape == (60, 2)
    original = np.linalg.norm(points[0] - points[1])
    assert np.linalg.norm(reduced[0] - reduced[1]) == pytest.approx(original, rel=1e-3)


@pytest.mark.parametrize("settings", [{"target": 0.8}, {"components": 5}])
def test_components_of_wide_vectors_without_their_covariance(spark, settings):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, 60)) + 0.2 * rng.normal(size=(300, 60)) + 3
    points[rng.random(points.shape) < 0.5] = 0.0
    rows = [(Vectors.sparse(60, np.flatnonzero(p).tolist(), p[p != 0].tolist()),) for p in points]
    df = spark.createDataFrame(rows, ["v"]).repartition(3)
    model = VariancePCA(inputCol="v", outputCol="w", gramSlots=10, **settings).fit(df)
    values = np.sort(np.linalg.eigvalsh(np.cov(points.T)))[::-1]
    shares = values / values.sum()
    kept = model.explainedVariance.toArray()
    assert len(kept) == (5 if "components" in settings else int(np.argmax(np.cumsum(shares) >= 0.8)) + 1)
    assert kept == pytest.approx(shares[: len(kept)], rel=1e-6)
    got = np.array([r[0] for r in model.transform(df).select(vector_to_array("w")).collect()])
    spread = np.cov(got.T)
    assert np.abs(spread - np.diag(np.diag(spread))).max() < 1e-6 * spread[0, 0]
    with pytest.raises(ValueError):
        VariancePCA(inputCol="v", outputCol="w", gramSlots=10).fit(df.limit(0))


def test_long_form_of_sparse_dense_and_null_vectors(spark):
    rows = [(1, Vectors.sparse(4, [1, 3], [2.0, 0.0])), (2, Vectors.dense([0, 5, 0, 7])), (3, None), (4, Vectors.sparse(4, [], []))]
    df = spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("v", VectorUDT())]))
    long = enc.long_form(df, "id", "v", ["a", "b", "c", "d"])
    assert sorted(map(tuple, long.collect())) == [(1, "b", 2.0), (2, "b", 5.0), (2, "d", 7.0)]


def test_sketches_unite(spark):
    df = spark.range(6000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2000).alias("x"), F.lit(None).cast("string").alias("y"))
    sketches = agg.distinct_sketches(df, "g", ["x", "y"])
    for row in agg.distinct_estimates(sketches, ["g"], ["x", "y"]).collect():
        exact = len({i % 2000 for i in range(6000) if i % 3 == row["g"]})
        assert abs(row["unique_x"] - exact) <= 0.05 * exact and row["unique_y"] == 0
    assert abs(agg.distinct_estimates(sketches, [], ["x"]).first()[0] - 2000) <= 100


def test_long_form_broadcasts_the_names_however_small_the_file(spark, tmp_path):
    rows = [(i, Vectors.dense([1.0, float(i), 2.0])) for i in range(20)]
    spark.createDataFrame(rows, ["id", "v"]).write.parquet(f"{tmp_path}/v")
    long = enc.long_form(spark.read.parquet(f"{tmp_path}/v"), "id", "v", ["a", "b", "c"])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert long.count() == 59
