"""Queries for profiling, splitting, imputing, encoding, scaling, metrics and cluster descriptions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from custlens.catalog.base_sql import with_views
from custlens.catalog.registry import query
from custlens.catalog.relational import rounded
from custlens.functions.hashing import in_sample, split_by_hash
from custlens.functions.quantiles import exact_quantiles
from custlens.operators import clustering as cl, encoding as enc, metrics as met, profile as prof
from custlens.operators.joins import PERSON, products_in_english
from custlens.operators.stages import FillMissing, KeepTopLevels, QuantileBins, ScaleColumns
from custlens.plans import features as feat
from custlens.session import materialize
from custlens.sources import discover_tables, read_star_shop, read_star_table


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(feat.features_clean(read_star_shop(spark, folder)), "features")


def _v1(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(feat.features_v1(read_star_shop(spark, folder)), "features_v1")


# --- profile -----------------------------------------------------------------------------------------

# Columns of the profiled tables, as the SQL side needs them by name.
COLUMNS = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
    " l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table that the folder holds."""
    return discover_tables(spark, folder, "*.parquet", "parquet")[0]


@query(
    "profile_shape",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(COLUMNS[t].split())} AS n_columns FROM {t}"
        for t in COLUMNS
    ),
)
def profile_shape(spark: SparkSession, folder: str) -> DataFrame:
    shapes = [prof.shape(df, name) for name, df in _tables(spark, folder).items()]
    result = shapes[0]
    for one in shapes[1:]:
        result = result.unionByName(one)
    return result


# Column types that are not strings.
KINDS = {
    "bigint": "c_custkey event_id user_id l_orderkey l_partkey l_suppkey o_orderkey o_custkey p_partkey s_suppkey"
    " item_id conv_id turn doc_id n_chars vec_id page_id",
    "array<float>": "embedding",
    "int": "label quality toxic c_nationkey l_linenumber n_nationkey n_regionkey p_size r_regionkey s_nationkey",
    "double": "c_acctbal value l_quantity l_extendedprice l_discount l_tax o_totalprice p_retailprice s_acctbal",
    "timestamp_ntz": "ts l_shipdate o_orderdate",
}
_KIND = {column: kind for kind, columns in KINDS.items() for column in columns.split()}


@query(
    "profile_types",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{_KIND.get(c, 'string')}' AS data_type,
            count({c}) AS n_values FROM {t}"""
        for t in COLUMNS
        for i, c in enumerate(COLUMNS[t].split(), start=1)
    ),
)
def profile_types(spark: SparkSession, folder: str) -> DataFrame:
    return prof.overview(_tables(spark, folder)).select(
        "table_name",
        "position",
        "column_name",
        "data_type",
        (F.col("n_rows") - F.col("null_count")).alias("n_values"),
    )


_NULL_COLUMNS = ["order_id", "review_id", "review_score", "review_comment_title", "review_comment_message"]


def _reviewed_orders(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    reviews = shop.reviews.drop("review_creation_date")
    return shop.orders.select("order_id").join(reviews, "order_id", "left")


def _null_sql(where: str = "") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, '{c}' AS column_name, count(*) - count({c}) AS null_count,
            (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct FROM j"""
        for c in _NULL_COLUMNS
    )
    return with_views(
        "shop",
        "j AS (SELECT * FROM (SELECT order_id FROM v_orders) LEFT JOIN v_reviews USING (order_id))",
        query=f"SELECT * FROM ({parts}) {where}",
    )


@query("profile_nulls", _null_sql())
def profile_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return prof.null_profile(_reviewed_orders(spark, folder)).drop("data_type", "position")


@query("profile_nulls_only", _null_sql("WHERE null_count > 0"))
def profile_nulls_only(spark: SparkSession, folder: str) -> DataFrame:
    return prof.null_profile(_reviewed_orders(spark, folder), only_missing=True).drop("data_type", "position")


@query(
    "profile_sample",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3",
)
def profile_sample(spark: SparkSession, folder: str) -> DataFrame:
    return prof.first_rows(read_star_table(spark, folder, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query(
    "profile_overview",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, count(*) AS n_rows, {len(COLUMNS[t].split())} AS n_columns,
        '{c}' AS column_name, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_pct FROM {t}"""
        for t in COLUMNS
        for c in COLUMNS[t].split()
    ),
)
def profile_overview(spark: SparkSession, folder: str) -> DataFrame:
    return prof.overview(_tables(spark, folder)).drop("data_type", "position")


# --- samples and splits ------------------------------------------------------------------------------

_HASH = "CAST('0x' || substr(md5(CAST(customer_unique_id AS VARCHAR)), 1, 15) AS BIGINT)"
TEST_SHARE = 0.2


@query(
    "sample_features",
    with_views(
        "fc",
        query=f"""SELECT customer_unique_id, recency, frequency, monetary FROM fc
                  WHERE {_HASH} < {int(0.1 * 2**60)}""",
    ),
)
def sample_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_clean(read_star_shop(spark, folder))
    return rows.where(in_sample(PERSON, 0.1)).select(PERSON, *feat.RFM)


_RANKED = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bnpl_target ORDER BY {_HASH}, customer_unique_id) AS place,
         count(*) OVER (PARTITION BY bnpl_target) AS total FROM fc),
split AS (SELECT *, CASE WHEN place <= round({TEST_SHARE} * total) THEN 1 ELSE 0 END AS is_test FROM ranked)"""


def split_train_test(df: DataFrame) -> DataFrame:
    """Add ``is_test``: 1 for exactly a fifth of each label."""
    parts = split_by_hash(df, PERSON, feat.LABEL, [TEST_SHARE, 1 - TEST_SHARE], "part")
    return parts.withColumn("is_test", (F.col("part") == 0).cast("int")).drop("part")


@query("stratified_split", with_views("fc", _RANKED, query="SELECT customer_unique_id, bnpl_target, is_test FROM split"))
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return split_train_test(_clean(spark, folder)).select(PERSON, feat.LABEL, "is_test")


@query(
    "cv_folds",
    with_views(
        "fc",
        _RANKED,
        query="""SELECT customer_unique_id, bnpl_target,
                   CASE WHEN place <= round(total * (1 / 3::DOUBLE)) THEN 0
                        WHEN place <= round(total * (2 / 3::DOUBLE)) THEN 1 ELSE 2 END AS fold FROM ranked""",
    ),
)
def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return split_by_hash(rows, PERSON, feat.LABEL, [1 / 3, 1 / 3, 1 / 3], "fold").select(PERSON, feat.LABEL, "fold")


# --- missing values ----------------------------------------------------------------------------------

_FILLED = ["avg_monetary", "avg_items_per_order", "avg_freight_per_order", "avg_installments", "avg_review_score"]


@query(
    "impute_median",
    with_views(
        "f1",
        query="SELECT customer_id, "
        + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM f1)) AS {c}" for c in _FILLED)
        + " FROM f1",
    ),
)
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    rows = _v1(spark, folder).select("customer_id", *_FILLED)
    return FillMissing(inputCols=_FILLED, strategy="median").fit(rows).transform(rows)


@query(
    "impute_mode",
    with_views(
        "english",
        """best AS (SELECT product_category_name_english AS v FROM v_english WHERE product_category_name_english IS NOT NULL
                    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
        query="""SELECT product_id, coalesce(product_category_name_english, (SELECT v FROM best))
                 AS product_category_name_english FROM v_english""",
    ),
)
def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    name = "product_category_name_english"
    rows = products_in_english(read_star_shop(spark, folder)).select("product_id", name)
    return FillMissing(inputCols=[name], strategy="mode", fallback="missing").fit(rows).transform(rows)


# Whether a v1 row is in the training part, by hash of its key.
_TRAIN = f"CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT) >= {int(TEST_SHARE * 2**60)}"


def _train(rows: DataFrame, key: str = "customer_id") -> DataFrame:
    return rows.where(~in_sample(key, TEST_SHARE))


@query(
    "impute_mean_train",
    with_views(
        "f1",
        query="SELECT customer_id, "
        + ", ".join(
            f"round(coalesce({c}, (SELECT avg({c}) FROM f1 WHERE {_TRAIN})), 6) AS {c}"
            for c in ("avg_items_per_order", "avg_review_score")
        )
        + " FROM f1",
    ),
)
def impute_mean_train(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["avg_items_per_order", "avg_review_score"]
    rows = _v1(spark, folder).select("customer_id", *columns)
    return rounded(FillMissing(inputCols=columns, strategy="mean").fit(_train(rows)).transform(rows), *columns)


@query(
    "impute_median_train",
    with_views(
        "f1",
        query="SELECT customer_id, "
        + ", ".join(
            f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM f1 WHERE {_TRAIN})) AS {c}" for c in _FILLED
        )
        + " FROM f1",
    ),
)
def impute_median_train(spark: SparkSession, folder: str) -> DataFrame:
    rows = _v1(spark, folder).select("customer_id", *_FILLED)
    return FillMissing(inputCols=_FILLED, strategy="median").fit(_train(rows)).transform(rows)


@query(
    "impute_mode_train",
    with_views(
        "english",
        f"""best AS (SELECT product_category_name_english AS v FROM v_english
                     WHERE product_category_name_english IS NOT NULL AND {_TRAIN.replace('customer_id', 'product_id')}
                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
        query="""SELECT product_id, coalesce(product_category_name_english, (SELECT v FROM best))
                 AS product_category_name_english FROM v_english""",
    ),
)
def impute_mode_train(spark: SparkSession, folder: str) -> DataFrame:
    name = "product_category_name_english"
    rows = products_in_english(read_star_shop(spark, folder)).select("product_id", name)
    return FillMissing(inputCols=[name], strategy="mode").fit(_train(rows, "product_id")).transform(rows)


# --- encoding ----------------------------------------------------------------------------------------


def _hot_sql(drop_first: bool, fit_where: str = "TRUE") -> str:
    """Long form of one-hot slots; SQL states directly which levels have a slot."""
    parts = []
    for c in feat.GEOGRAPHY:
        first = f"AND {c} > (SELECT min({c}) FROM fc WHERE {fit_where})" if drop_first else ""
        parts.append(
            f"""SELECT customer_unique_id, '{c}' AS source, {c} AS level, 1.0::DOUBLE AS value FROM fc
                WHERE {c} IN (SELECT {c} FROM fc WHERE {fit_where}) {first}"""
        )
    return with_views("fc", query=" UNION ALL ".join(parts))


# Two in a hundred people, so that some cities occur only outside the fitted part.
_FEW = f"{_HASH} < {int(0.02 * 2**60)}"


def _hot_long(df: DataFrame, columns: list[str], encoded: list[str], drop_first: bool) -> DataFrame:
    result = None
    for column, vector in zip(columns, encoded):
        part = enc.long_form(df, PERSON, vector).select(
            PERSON, F.lit(column).alias("source"), F.col("feature").alias("level"), "value"
        )
        result = part if result is None else result.unionByName(part)
    return result


def _hot(rows: DataFrame, fit_on: DataFrame, drop_first: bool) -> DataFrame:
    stages, encoded = enc.one_hot_stages(feat.GEOGRAPHY, drop_first)
    return _hot_long(Pipeline(stages=stages).fit(fit_on).transform(rows), feat.GEOGRAPHY, encoded, drop_first)


@query("dummies_drop_first", _hot_sql(True))
def dummies_drop_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return _hot(rows, rows, drop_first=True)


@query("onehot_ignore", _hot_sql(False, _FEW))
def onehot_ignore(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return _hot(rows, rows.where(in_sample(PERSON, 0.02)), drop_first=False)


@query("onehot_drop_first_ignore", _hot_sql(True, _FEW))
def onehot_drop_first_ignore(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return _hot(rows, rows.where(in_sample(PERSON, 0.02)), drop_first=True)


OTHERS = {"customer_state": "Other_State", "customer_city": "Other_City"}


@query(
    "bucket_top10",
    with_views(
        "fc",
        query="SELECT customer_unique_id, "
        + ", ".join(
            f"""CASE WHEN {c} IN (SELECT {c} FROM fc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
                THEN {c} ELSE '{other}' END AS {c}_reduced"""
            for c, other in OTHERS.items()
        )
        + " FROM fc",
    ),
)
def bucket_top10(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).select(PERSON, *feat.GEOGRAPHY)
    reduced = KeepTopLevels(inputCols=feat.GEOGRAPHY, top=10, others=OTHERS).fit(rows).transform(rows)
    return reduced.withColumnsRenamed({c: f"{c}_reduced" for c in feat.GEOGRAPHY})


_BINNED = ["recency", "frequency", "monetary", "avg_monetary"]


def _bin_sql(column: str) -> str:
    edges = [f"(SELECT quantile_cont({column}, {p}) FROM fc)" for p in (0.2, 0.4, 0.6, 0.8)]
    low, high = f"(SELECT min({column}) FROM fc)", f"(SELECT max({column}) FROM fc)"
    cuts = []
    for before, edge in zip([low, *edges], edges):
        cuts.append(f"CASE WHEN {column} >= {edge} AND {edge} > {before} AND {edge} < {high} THEN 1 ELSE 0 END")
    return "CAST(" + " + ".join(cuts) + f" AS DOUBLE) AS {column}"


@query(
    "kbins_quantile",
    with_views("fc", query="SELECT customer_unique_id, " + ", ".join(map(_bin_sql, _BINNED)) + " FROM fc"),
)
def kbins_quantile(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).select(PERSON, *_BINNED)
    return QuantileBins(inputCols=_BINNED, bins=5).fit(rows).transform(rows)


_POLY = feat.RFM + feat.BEHAVIOUR
_POLY_SOURCE = "p AS (SELECT customer_unique_id, " + ", ".join(
    f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in _POLY
) + " FROM (SELECT * REPLACE (round(avg_review_score, 6) AS avg_review_score) FROM fc))"


def _poly_sql() -> str:
    parts = []
    for i, column in enumerate(_POLY):
        parts.append((column, column))
        parts += [(f"{other}*{column}", f"{other} * {column}") for other in _POLY[: i + 1]]
    return with_views(
        "fc",
        _POLY_SOURCE,
        query="SELECT customer_unique_id, feature, value FROM (SELECT customer_unique_id, unnest(["
        + ", ".join(f"'{name}'" for name, _ in parts)
        + "]) AS feature, unnest(["
        + ", ".join(value for _, value in parts)
        + "]) AS value FROM p) WHERE value <> 0",
    )


@query("poly2", _poly_sql())
def poly2(spark: SparkSession, folder: str) -> DataFrame:
    rows = rounded(_clean(spark, folder), "avg_review_score").select(
        PERSON, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _POLY)
    )
    stages, output = enc.polynomial_stages(_POLY)
    expanded = Pipeline(stages=stages).fit(rows).transform(rows)
    return enc.long_form(expanded, PERSON, output[0], enc.polynomial_names(_POLY))


for _name, _columns in (("a", feat.FEATURE_SETS["A"]), ("b", feat.FEATURE_SETS["B"]), ("c", feat.FEATURE_SETS["C"])):

    def _feature_set(spark: SparkSession, folder: str, columns=tuple(_columns)) -> DataFrame:
        rows = feat.features_clean(read_star_shop(spark, folder))
        rows = rounded(rows, "avg_review_score")
        return rows.select(PERSON, feat.LABEL, *columns)

    query(
        f"feature_set_{_name}",
        with_views(
            "fc",
            query="SELECT customer_unique_id, bnpl_target, "
            + ", ".join("round(avg_review_score, 6) AS avg_review_score" if c == "avg_review_score" else c for c in _columns)
            + " FROM fc",
        ),
    )(_feature_set)


# --- scaling -----------------------------------------------------------------------------------------

_SCALED = ["recency", "frequency", "monetary", "avg_items_per_order", "pct_orders_with_review"]


@query(
    "standard_scale",
    with_views(
        "fc",
        query="SELECT customer_unique_id, "
        + ", ".join(
            f"""round(({c} - (SELECT avg({c}) FROM fc)) / (SELECT CASE WHEN max({c}) > min({c}) THEN stddev_pop({c})
                ELSE 1 END FROM fc), 6) AS {c}"""
            for c in _SCALED
        )
        + " FROM fc",
    ),
)
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).select(PERSON, *_SCALED)
    return rounded(ScaleColumns(inputCols=_SCALED, method="standard").fit(rows).transform(rows), *_SCALED)


@query(
    "robust_scale",
    with_views(
        "fc",
        query="SELECT customer_unique_id, "
        + ", ".join(
            f"""round(({c} - (SELECT quantile_cont({c}, 0.5) FROM fc)) / (SELECT CASE
                WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25)
                THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1 END FROM fc), 6) AS {c}"""
            for c in _SCALED
        )
        + " FROM fc",
    ),
)
def robust_scale(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).select(PERSON, *_SCALED)
    return rounded(ScaleColumns(inputCols=_SCALED, method="robust").fit(rows).transform(rows), *_SCALED)


@query(
    "exact_quantiles",
    with_views(
        "fc",
        query=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, {p}::DOUBLE AS probability, CAST(quantile_cont({c}, {p}) AS DOUBLE) AS value FROM fc"
            for c in _BINNED
            for p in (0.0, 0.1, 0.5, 0.9, 1.0)
        ),
    ),
)
def exact_quantiles_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_quantiles(_clean(spark, folder), _BINNED, [0.0, 0.1, 0.5, 0.9, 1.0])


# --- cluster descriptions, on a labelling SQL can repeat -----------------------------------------------

# Three centroids in units of recency, frequency and hundred thousands of spend.
CENTROIDS = [
    {"recency": 30.0, "frequency": 12.0, "spend": 30.0},
    {"recency": 90.0, "frequency": 10.0, "spend": 25.0},
    {"recency": 300.0, "frequency": 8.0, "spend": 20.0},
]
_POINT = ["recency", "frequency", "spend"]
_DISTANCES = [
    " + ".join(f"(({c} - {x}::DOUBLE) * ({c} - {x}::DOUBLE))" for c, x in centroid.items()) for centroid in CENTROIDS
]
_CLUSTERED = f"""points AS (SELECT *, monetary / 100000 AS spend FROM fc),
dist AS (SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(_DISTANCES))} FROM points),
clustered AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM dist)"""


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_clean(read_star_shop(spark, folder)).withColumn("spend", F.col("monetary") / 100000)
    return materialize(cl.nearest_centroid(rows, CENTROIDS), "clustered")


def _with_vector(rows: DataFrame) -> DataFrame:
    return enc.assemble(_POINT).transform(rows)


def _one_row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} double" for name in values))


@query("cluster_assign", with_views("fc", _CLUSTERED, query="SELECT customer_unique_id, cluster FROM clustered"))
def cluster_assign(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_clean(read_star_shop(spark, folder)).withColumn("spend", F.col("monetary") / 100000)
    return cl.nearest_centroid(rows, CENTROIDS).select(PERSON, "cluster")


@query(
    "cluster_sizes",
    with_views(
        "fc",
        _CLUSTERED,
        query="""SELECT cluster, count(*) AS size, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM clustered) AS percentage
                 FROM clustered GROUP BY 1""",
    ),
)
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return cl.cluster_sizes(_clustered(spark, folder))


@query(
    "cluster_means",
    with_views(
        "fc",
        _CLUSTERED,
        query=" UNION ALL ".join(
            f"SELECT cluster, '{c}' AS feature, round(avg({c}), 4) AS mean FROM clustered GROUP BY 1"
            for c in feat.SEGMENT_NUMERIC
        ),
    ),
)
def cluster_means(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cl.cluster_means(_clustered(spark, folder), feat.SEGMENT_NUMERIC), "mean", digits=4)


def _top_sql(column: str) -> str:
    return with_views(
        "fc",
        _CLUSTERED,
        query=f"""SELECT cluster, {column}, n, place, n * 100.0::DOUBLE / size AS percentage FROM (
            SELECT cluster, {column}, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster) AS size,
                   CAST(row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {column}) AS INTEGER) AS place
            FROM clustered GROUP BY 1, 2) WHERE place <= 2""",
    )


@query("cluster_top_states", _top_sql("customer_state"))
def cluster_top_states(spark: SparkSession, folder: str) -> DataFrame:
    return cl.top_levels(_clustered(spark, folder), "customer_state")


@query("cluster_top_cities", _top_sql("customer_city"))
def cluster_top_cities(spark: SparkSession, folder: str) -> DataFrame:
    return cl.top_levels(_clustered(spark, folder), "customer_city")


@query(
    "top2_per_group",
    with_views(
        "english",
        query="""SELECT seller_id, product_category_name_english, n, place FROM (
            SELECT seller_id, product_category_name_english, count(*) AS n, CAST(row_number() OVER
              (PARTITION BY seller_id ORDER BY count(*) DESC, product_category_name_english) AS INTEGER) AS place
            FROM v_items JOIN v_english USING (product_id) WHERE product_category_name_english IS NOT NULL
            GROUP BY 1, 2) WHERE place <= 2""",
    ),
)
def top2_per_group(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    sold = shop.items.join(products_in_english(shop), "product_id")
    return cl.top_levels(sold, "product_category_name_english", cluster="seller_id").drop("percentage")


@query(
    "silhouette_sq",
    with_views(
        "fc",
        _CLUSTERED,
        query="""SELECT round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
          SELECT x, any_value(own_n) AS own_n, max(s) FILTER (own) / greatest(any_value(own_n) - 1, 1) AS a,
                 min(s / n) FILTER (NOT own) AS b
          FROM (SELECT p.customer_unique_id AS x, q.cluster, p.cluster = q.cluster AS own, count(*) AS n,
                  sum((p.recency - q.recency) ** 2 + (p.frequency - q.frequency) ** 2 + (p.spend - q.spend) ** 2) AS s,
                  any_value(c.n) AS own_n
                FROM clustered p CROSS JOIN clustered q
                JOIN (SELECT cluster, count(*) AS n FROM clustered GROUP BY 1) c ON c.cluster = p.cluster
                GROUP BY 1, 2, 3)
          GROUP BY 1)""",
    ),
)
def silhouette_sq(spark: SparkSession, folder: str) -> DataFrame:
    value = cl.silhouette_squared(_with_vector(_clustered(spark, folder)))
    return rounded(_one_row(spark, silhouette=value), "silhouette")


_CENTRES = """centres AS (
  SELECT cluster, count(*) AS n, avg(recency) AS m1, avg(frequency) AS m2, avg(spend) AS m3 FROM clustered GROUP BY 1)"""


@query(
    "calinski_harabasz",
    with_views(
        "fc",
        _CLUSTERED,
        _CENTRES,
        query="""SELECT round((between_ss / (k - 1)) / (within_ss / (total - k)), 4) AS calinski_harabasz FROM (
          SELECT sum((recency - m1) ** 2 + (frequency - m2) ** 2 + (spend - m3) ** 2) AS within_ss, count(*) AS total
          FROM clustered JOIN centres USING (cluster))
        CROSS JOIN (
          SELECT count(*) AS k, sum(n * ((m1 - a1) ** 2 + (m2 - a2) ** 2 + (m3 - a3) ** 2)) AS between_ss
          FROM centres CROSS JOIN (SELECT avg(recency) AS a1, avg(frequency) AS a2, avg(spend) AS a3 FROM clustered))""",
    ),
)
def calinski_harabasz(spark: SparkSession, folder: str) -> DataFrame:
    scores = cl.cluster_scores(_with_vector(_clustered(spark, folder)))
    return rounded(_one_row(spark, calinski_harabasz=scores["calinski_harabasz"]), "calinski_harabasz", digits=4)


@query(
    "davies_bouldin",
    with_views(
        "fc",
        _CLUSTERED,
        _CENTRES,
        """spreads AS (
  SELECT cluster, avg(sqrt((recency - m1) ** 2 + (frequency - m2) ** 2 + (spend - m3) ** 2)) AS s,
         any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3
  FROM clustered JOIN centres USING (cluster) GROUP BY 1)""",
        query="""SELECT round(avg(worst), 6) AS davies_bouldin FROM (
          SELECT i.cluster, max((i.s + j.s) / sqrt((i.m1 - j.m1) ** 2 + (i.m2 - j.m2) ** 2 + (i.m3 - j.m3) ** 2)) AS worst
          FROM spreads i JOIN spreads j ON i.cluster <> j.cluster GROUP BY 1)""",
    ),
)
def davies_bouldin(spark: SparkSession, folder: str) -> DataFrame:
    scores = cl.cluster_scores(_with_vector(_clustered(spark, folder)))
    return rounded(_one_row(spark, davies_bouldin=scores["davies_bouldin"]), "davies_bouldin")


def _bin(column: str) -> str:
    low, high = f"(SELECT min({column}) FROM clustered)", f"(SELECT max({column}) FROM clustered)"
    return (
        f"CAST(least(floor(({column}::DOUBLE - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE) * 50), 49) AS INTEGER)"
    )


_PAIRS = [("recency", "monetary"), ("frequency", "monetary"), ("recency", "frequency")]


@query(
    "scatter_bins",
    with_views(
        "fc",
        _CLUSTERED,
        query=" UNION ALL ".join(
            f"""SELECT '{x}' AS x, '{y}' AS y, cluster, {_bin(x)} AS x_bin, {_bin(y)} AS y_bin, count(*) AS n
                FROM clustered GROUP BY ALL"""
            for x, y in _PAIRS
        ),
    ),
)
def scatter_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clustered(spark, folder)
    result = None
    for x, y in _PAIRS:
        part = cl.scatter_bins(rows, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "*")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "boxplot_stats",
    with_views(
        "fc",
        _CLUSTERED,
        """boxes AS (
  SELECT cluster, quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.5) AS median,
         quantile_cont(monetary, 0.75) AS q3 FROM clustered GROUP BY 1),
placed AS (
  SELECT *, monetary >= q1 - 1.5::DOUBLE * (q3 - q1) AND monetary <= q3 + 1.5::DOUBLE * (q3 - q1) AS inside
  FROM clustered JOIN boxes USING (cluster))""",
        query="""SELECT cluster, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, min(monetary) FILTER (inside) AS whisker_low,
                   max(monetary) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
                 FROM placed GROUP BY ALL""",
    ),
)
def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cl.boxplot_stats(_clustered(spark, folder), "monetary"), "q1", "median", "q3", digits=3)


# --- classifier metrics, on a score SQL can repeat ------------------------------------------------------

# Mean spend rounded to ten thousands gives heavy ties; the threshold makes a prediction.
_SCORED = """scored AS (
  SELECT customer_unique_id, bnpl_target AS label, round(avg_monetary / 10000) AS score,
         CASE WHEN avg_monetary >= 250000 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM fc)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_clean(read_star_shop(spark, folder)).select(
        PERSON,
        F.col(feat.LABEL).alias("label"),
        F.round(F.col("avg_monetary") / 10000).alias("score"),
        F.when(F.col("avg_monetary") >= 250000, 1.0).otherwise(0.0).alias("prediction"),
    )
    return materialize(rows, "scored")


_CURVE = """curve AS (
  SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
steps AS (
  SELECT *, sum(pos) OVER down AS cum_pos, sum(neg) OVER down AS cum_neg, lead(pos) OVER down AS next_pos,
         lead(neg) OVER down AS next_neg, row_number() OVER down AS place,
         (SELECT sum(label) FROM scored) AS p, (SELECT sum(1 - label) FROM scored) AS q
  FROM curve WINDOW down AS (ORDER BY score DESC))"""


@query(
    "roc_auc",
    with_views(
        "fc",
        _SCORED,
        query="""SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 9)
                   AS auc_roc
                 FROM scored a CROSS JOIN scored b WHERE a.label = 1 AND b.label = 0""",
    ),
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(met.ranking_metrics(_scored(spark, folder)).select("auc_roc"), "auc_roc", digits=9)


@query(
    "average_precision",
    with_views(
        "fc",
        _SCORED,
        _CURVE,
        query="SELECT round(sum(pos / p * (cum_pos / (cum_pos + cum_neg))), 9) AS auc_pr FROM steps",
    ),
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(met.ranking_metrics(_scored(spark, folder)).select("auc_pr"), "auc_pr", digits=9)


@query(
    "roc_curve",
    with_views(
        "fc",
        _SCORED,
        _CURVE,
        query="""SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL
                 SELECT CAST(cum_neg AS DOUBLE) / q, CAST(cum_pos AS DOUBLE) / p FROM steps
                 WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""",
    ),
)
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return met.roc_points(_scored(spark, folder))


_COUNTS = """counts AS (
  SELECT count(*) AS n, count(*) FILTER (label = prediction) AS ok,
         count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (prediction = 1) AS guessed, count(*) FILTER (label = 1) AS actual FROM scored)"""


@query(
    "binary_metrics",
    with_views(
        "fc",
        _SCORED,
        _COUNTS,
        query="""SELECT ok / n AS accuracy, coalesce(tp / nullif(guessed, 0), 0) AS precision,
                   coalesce(tp / nullif(actual, 0), 0) AS recall,
                   coalesce(2 * tp / nullif(guessed + actual, 0), 0) AS f1 FROM counts""",
    ),
)
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return met.binary_metrics(_scored(spark, folder))


@query(
    "weighted_report",
    with_views(
        "fc",
        _SCORED,
        _COUNTS,
        query="""SELECT
          round((actual * coalesce(tp / nullif(guessed, 0), 0)
            + (n - actual) * coalesce(tn / nullif(n - guessed, 0), 0)) / n, 9) AS precision,
          round((actual * coalesce(tp / nullif(actual, 0), 0)
            + (n - actual) * coalesce(tn / nullif(n - actual, 0), 0)) / n, 9) AS recall,
          round((actual * coalesce(2 * tp / nullif(guessed + actual, 0), 0)
            + (n - actual) * coalesce(2 * tn / nullif(2 * n - guessed - actual, 0), 0)) / n, 9) AS f1 FROM counts""",
    ),
)
def weighted_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(met.weighted_report(_scored(spark, folder)), "precision", "recall", "f1", digits=9)


# Coefficients of a logistic score.
LOGIT = {"recency": -0.002, "frequency": 0.05, "avg_monetary": 0.00001}


@query(
    "score_fixed_logit",
    with_views(
        "fc",
        query="""SELECT customer_unique_id, round(1 / (1 + exp(-z)), 9) AS probability,
                   CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction
                 FROM (SELECT *, -3.0::DOUBLE + """
        + " + ".join(f"{w}::DOUBLE * coalesce({c}, 0)" for c, w in LOGIT.items())
        + " AS z FROM fc)",
    ),
)
def score_fixed_logit(spark: SparkSession, folder: str) -> DataFrame:
    rows = feat.features_clean(read_star_shop(spark, folder))
    z = F.lit(-3.0)
    for column, weight in LOGIT.items():
        z = z + F.lit(weight) * F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    rows = rows.withColumn("z", z)
    return rows.select(
        PERSON,
        F.round(1 / (1 + F.exp(-F.col("z"))), 9).alias("probability"),
        (F.col("z") > 0).cast("double").alias("prediction"),
    )
