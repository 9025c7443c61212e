"""Queries for scans, joins, aggregates and customer features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from custlens.catalog.base_sql import with_views
from custlens.catalog.registry import query
from custlens.functions.scalars import finite_or_zero, parsed_timestamp, whole_days
from custlens.operators import aggregates as agg, joins
from custlens.operators.joins import PERSON
from custlens.plans import features as feat
from custlens.session import materialize
from custlens.sources import discover_tables, read_star_shop, read_star_table

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _text(column: str) -> Column:
    return F.date_format(column, TIME_FORMAT)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_sql(columns: list[str], digits: int = 6) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, {digits}) AS {c}" for c in columns) + ")"


# --- scans ---------------------------------------------------------------------------------------


# The tables of a folder, as the SQL side needs them by name.
TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier"
).split()


@query("scan_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table that the folder holds."""
    tables, _ = discover_tables(spark, folder, "*.parquet", "parquet")
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


@query(
    "scan_pruned",
    "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,"
    " l_extendedprice AS price FROM lineitem",
)
def scan_pruned(spark: SparkSession, folder: str) -> DataFrame:
    line = read_star_table(spark, folder, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
    )


# --- scalar functions ------------------------------------------------------------------------------


@query(
    "parse_ts_coerce",
    """SELECT o_orderkey AS order_id, strftime(try_cast(
         CASE o_orderstatus WHEN 'P' THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
         AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed
       FROM orders""",
)
def parse_ts_coerce(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_star_table(spark, folder, "orders")
    raw = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(_text("o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("order_id"), parsed_timestamp(raw).alias("parsed")).withColumn(
        "parsed", _text("parsed")
    )


@query(
    "recency_days",
    with_views(
        "shop",
        query="""SELECT customer_unique_id,
          CAST(floor((epoch_us((SELECT max(order_purchase_timestamp) FROM v_orders))
                      - epoch_us(max(order_purchase_timestamp))) / 86400000000) AS BIGINT) AS recency
        FROM v_orders JOIN v_customers USING (customer_id) GROUP BY 1""",
    ),
)
def recency_days(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    last = joins.orders_with_customers(shop).groupBy(PERSON).agg(F.max(feat.WHEN).alias("last_order"))
    return last.select(PERSON, whole_days(agg.latest(shop.orders, feat.WHEN), F.col("last_order")).alias("recency"))


@query(
    "nonfinite_to_zero",
    """SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
         CASE WHEN l_discount = 0 OR l_tax = 0 THEN 0 ELSE round(ln(l_discount) / l_tax, 6) END AS cleaned
       FROM lineitem""",
)
def nonfinite_to_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Log-discount per tax, where no discount gives an infinity and no tax a NaN or a null."""
    line = read_star_table(spark, folder, "lineitem")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    log = F.when(discount == 0, float("-inf")).otherwise(F.log(discount))
    value = F.when(tax == 0, F.when(discount == 0, float("nan"))).otherwise(log / tax)
    return line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.round(finite_or_zero(value), 6).alias("cleaned"),
    )


# --- joins ---------------------------------------------------------------------------------------


@query(
    "join_orders_customers_left",
    with_views(
        "shop",
        query="""SELECT order_id, customer_unique_id, customer_state, customer_city
                 FROM v_orders LEFT JOIN v_customers USING (customer_id)""",
    ),
)
def join_orders_customers_left(spark: SparkSession, folder: str) -> DataFrame:
    return joins.orders_with_customers(read_star_shop(spark, folder), "left").select(
        "order_id", PERSON, "customer_state", "customer_city"
    )


@query(
    "join_orders_customers",
    with_views(
        "shop",
        query="""SELECT order_id, customer_unique_id, customer_state, customer_city
                 FROM v_orders JOIN v_customers USING (customer_id)""",
    ),
)
def join_orders_customers(spark: SparkSession, folder: str) -> DataFrame:
    return joins.orders_with_customers(read_star_shop(spark, folder)).select(
        "order_id", PERSON, "customer_state", "customer_city"
    )


@query(
    "join_geo_fanout",
    with_views(
        "shop",
        query="""SELECT o.order_id, c.customer_unique_id, count(*) AS joined_rows
                 FROM v_orders o JOIN v_customers a USING (customer_id)
                 JOIN v_customers c ON a.customer_unique_id = c.customer_unique_id GROUP BY 1, 2""",
    ),
)
def join_geo_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return joins.geo_fanout(read_star_shop(spark, folder)).select(
        "order_id", PERSON, F.col("home_rows").alias("joined_rows")
    )


@query(
    "join_items",
    with_views(
        "shop",
        query="""SELECT order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price,
                 strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS bought
                 FROM v_orders JOIN v_items USING (order_id)""",
    ),
)
def join_items(spark: SparkSession, folder: str) -> DataFrame:
    return joins.orders_with_items(read_star_shop(spark, folder)).select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("price").cast("double").alias("price"),
        _text(feat.WHEN).alias("bought"),
    )


@query(
    "join_category_lookup",
    with_views("english", query="SELECT product_id, product_category_name_english FROM v_english"),
)
def join_category_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return joins.products_in_english(read_star_shop(spark, folder)).select(
        "product_id", "product_category_name_english"
    )


@query(
    "join_products",
    with_views(
        "english",
        query="""SELECT order_id, order_item_id, product_id, product_category_name_english
                 FROM v_items JOIN v_english USING (product_id)""",
    ),
)
def join_products(spark: SparkSession, folder: str) -> DataFrame:
    return joins.items_with_products(read_star_shop(spark, folder)).select(
        "order_id", "order_item_id", "product_id", "product_category_name_english"
    )


@query(
    "join_sellers_left",
    with_views(
        "shop",
        query="""SELECT order_id, order_item_id, seller_id, seller_state
                 FROM v_items LEFT JOIN v_sellers USING (seller_id)""",
    ),
)
def join_sellers_left(spark: SparkSession, folder: str) -> DataFrame:
    return joins.items_with_sellers(read_star_shop(spark, folder)).select(
        "order_id", "order_item_id", "seller_id", "seller_state"
    )


@query(
    "join_payments_fanout",
    with_views(
        "shop",
        query="""SELECT order_id, count(*) AS joined_rows, CAST(sum(payment_value) AS DOUBLE) AS paid,
                 CAST(sum(price) AS DOUBLE) AS priced FROM v_items JOIN v_payments USING (order_id) GROUP BY 1""",
    ),
)
def join_payments_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over items joined to raw payments, from one row per order on either side."""
    shop = read_star_shop(spark, folder)
    items = shop.items.groupBy("order_id").agg(F.count("*").alias("items"), F.sum("price").alias("price"))
    payments = shop.payments.groupBy("order_id").agg(
        F.count("*").alias("payments"), F.sum("payment_value").alias("value")
    )
    return items.join(payments, "order_id").select(
        "order_id",
        (F.col("items") * F.col("payments")).alias("joined_rows"),
        (F.col("items") * F.col("value")).cast("double").alias("paid"),
        (F.col("payments") * F.col("price")).cast("double").alias("priced"),
    )


@query(
    "join_payments_agg",
    with_views(
        "orders",
        query="""SELECT order_id, order_item_id, payment_value, payment_installments, payment_type
                 FROM v_items JOIN o_payments_mode USING (order_id)""",
    ),
)
def join_payments_agg(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    return joins.items_with_payments(shop).select(
        "order_id", "order_item_id", "payment_value", "payment_installments", "payment_type"
    )


@query(
    "join_reviews_left",
    with_views(
        "shop",
        query="SELECT order_id, review_id, review_score FROM v_orders LEFT JOIN v_reviews USING (order_id)",
    ),
)
def join_reviews_left(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    return joins.attach_many(
        shop.orders.select("order_id"), shop.reviews.select("order_id", "review_id", "review_score"), "order_id"
    )


@query(
    "join_reviews_agg",
    with_views(
        "orders",
        query="""SELECT order_id, avg_review_score, comment_title_count, comment_message_count
                 FROM v_orders LEFT JOIN o_comments USING (order_id)""",
    ),
)
def join_reviews_agg(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    return (
        shop.orders.select("order_id")
        .join(agg.comments_per_order(shop.reviews), "order_id", "left")
        .select("order_id", "avg_review_score", "comment_title_count", "comment_message_count")
    )


@query(
    "join_demographics",
    with_views(
        "shop",
        query="""SELECT customer_id, n_orders, customer_state, customer_city
                 FROM (SELECT customer_id, count(*) AS n_orders FROM v_orders GROUP BY 1)
                 LEFT JOIN v_customers USING (customer_id)""",
    ),
)
def join_demographics(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    counted = shop.orders.groupBy("customer_id").agg(F.count("*").alias("n_orders"))
    return counted.join(shop.customers, "customer_id", "left").select(
        "customer_id", "n_orders", "customer_state", "customer_city"
    )


SAMPLE_FRACTION = 0.05
_SAMPLED = f"""s_people AS (
  SELECT DISTINCT customer_unique_id FROM v_customers
  WHERE CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 15) AS BIGINT) < {int(SAMPLE_FRACTION * 2**60)})"""


@query(
    "semi_join_sample",
    with_views(
        "shop",
        _SAMPLED,
        query="""SELECT order_id, customer_unique_id FROM v_orders JOIN v_customers USING (customer_id)
                 WHERE customer_unique_id IN (SELECT customer_unique_id FROM s_people)""",
    ),
)
def semi_join_sample(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    people = feat.sampled_people(shop, SAMPLE_FRACTION)
    return joins.keep_members(joins.orders_with_customers(shop), people, PERSON).select("order_id", PERSON)


_V1_ROUND = ["avg_review_score", "avg_installments"]


@query(
    "wide_v1",
    with_views(
        "w1",
        query=f"""SELECT {_rounded_sql(_V1_ROUND)} FROM (
                  SELECT order_id, customer_id, customer_unique_id, customer_state, n_items, total_price, total_freight,
                         n_payments, total_payment_value, max_installments, avg_installments, n_reviews, avg_review_score
                  FROM w1)""",
    ),
)
def wide_v1(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        feat.wide_v1(read_star_shop(spark, folder)).select(
            "order_id",
            "customer_id",
            PERSON,
            "customer_state",
            "n_items",
            "total_price",
            "total_freight",
            "n_payments",
            "total_payment_value",
            "max_installments",
            "avg_installments",
            "n_reviews",
            "avg_review_score",
        ),
        *_V1_ROUND,
    )


@query(
    "wide_v2",
    with_views(
        "w2",
        query="""SELECT order_id, order_item_id, product_id, seller_id, customer_unique_id, customer_state, seller_state,
                   product_category_name_english, payment_value, payment_type, payment_installments,
                   round(avg_review_score, 6) AS avg_review_score, comment_title_count FROM w2""",
    ),
)
def wide_v2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        feat.wide_v2(read_star_shop(spark, folder)).select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            PERSON,
            "customer_state",
            "seller_state",
            "product_category_name_english",
            "payment_value",
            "payment_type",
            "payment_installments",
            "avg_review_score",
            "comment_title_count",
        ),
        "avg_review_score",
    )


@query(
    "wide_v3",
    with_views(
        "w3",
        query="""SELECT order_id, customer_unique_id, CAST(count(*) AS DOUBLE) AS joined_rows,
                   CAST(sum(payment_value) AS DOUBLE) AS paid, CAST(sum(freight_value) AS DOUBLE) AS freight,
                   CAST(sum(order_item_id) AS DOUBLE) AS positions, CAST(sum(review_score) AS DOUBLE) AS scores
                 FROM w3 GROUP BY 1, 2""",
    ),
)
def wide_v3(spark: SparkSession, folder: str) -> DataFrame:
    wide = feat.wide_v3(read_star_shop(spark, folder))

    def weighed(column: str, weight: str) -> Column:
        return (F.col(column) * F.col(weight)).cast("double")

    return wide.select(
        "order_id",
        PERSON,
        F.col("joined_rows").cast("double").alias("joined_rows"),
        weighed("paid_sum", "payment_weight").alias("paid"),
        weighed("freight_sum", "item_weight").alias("freight"),
        weighed("position_sum", "item_weight").alias("positions"),
        weighed("score_sum", "review_weight").alias("scores"),
    )


# --- aggregates ------------------------------------------------------------------------------------


@query("agg_items", with_views("orders", query="SELECT * FROM o_items"))
def agg_items(spark: SparkSession, folder: str) -> DataFrame:
    return agg.items_per_order(read_star_shop(spark, folder).items)


@query("agg_payments", with_views("orders", query="SELECT * FROM o_payments"))
def agg_payments(spark: SparkSession, folder: str) -> DataFrame:
    return agg.payments_per_order(read_star_shop(spark, folder).payments)


@query("agg_reviews", with_views("orders", query="SELECT * FROM o_reviews"))
def agg_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return agg.reviews_per_order(read_star_shop(spark, folder).reviews)


@query("agg_payments_mode", with_views("orders", query="SELECT * FROM o_payments_mode"))
def agg_payments_mode(spark: SparkSession, folder: str) -> DataFrame:
    return agg.payments_per_order_with_mode(read_star_shop(spark, folder).payments)


@query("agg_reviews_comments", with_views("orders", query="SELECT * FROM o_comments"))
def agg_reviews_comments(spark: SparkSession, folder: str) -> DataFrame:
    return agg.comments_per_order(read_star_shop(spark, folder).reviews)


@query(
    "latest_order",
    "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest_order FROM orders",
)
def latest_order(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_star_shop(spark, folder).orders
    return orders.agg(F.max(feat.WHEN).alias("latest_order")).select(_text("latest_order").alias("latest_order"))


_CLEAN_ROUND = ["avg_review_score", "avg_installments"]


@query("features_v1", with_views("f1", query="SELECT * FROM f1"))
def features_v1(spark: SparkSession, folder: str) -> DataFrame:
    return feat.features_v1(read_star_shop(spark, folder))


@query(
    "features_v2",
    with_views("f2", query=f"SELECT {_rounded_sql(_CLEAN_ROUND)} FROM (SELECT * EXCLUDE (max_installments) FROM f2)"),
)
def features_v2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(feat.features_v2(read_star_shop(spark, folder)), *_CLEAN_ROUND)


@query("features_v3", with_views("f3", query="SELECT * EXCLUDE (max_installments) FROM f3"))
def features_v3(spark: SparkSession, folder: str) -> DataFrame:
    return feat.features_v3(read_star_shop(spark, folder))


_BNPL = """SELECT * EXCLUDE (max_installments, avg_installments),
             CAST(coalesce(max_installments, 0) >= 2 AS INTEGER) AS bnpl_target FROM f3"""


@query("bnpl_features", with_views("f3", query=_BNPL))
def bnpl_features(spark: SparkSession, folder: str) -> DataFrame:
    return feat.bnpl_features(read_star_shop(spark, folder))


@query(
    "features_with_target",
    with_views(
        "f3",
        """labels_only AS (SELECT customer_unique_id, max(payment_installments) AS most FROM w3 GROUP BY 1)""",
        query="""SELECT customer_unique_id, recency, frequency, monetary, CAST(most >= 2 AS INTEGER) AS bnpl_target
                 FROM f3 JOIN labels_only USING (customer_unique_id)""",
    ),
)
def features_with_target(spark: SparkSession, folder: str) -> DataFrame:
    """The label and the features come out of one grouping, so nothing has to be joined back."""
    return feat.bnpl_features(read_star_shop(spark, folder)).select(PERSON, *feat.RFM, feat.LABEL)


@query("features_clean", with_views("fc", query=f"SELECT {_rounded_sql(_CLEAN_ROUND)} FROM fc"))
def features_clean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(feat.features_clean(read_star_shop(spark, folder)), *_CLEAN_ROUND)


_DISTINCT_SQL = """SELECT customer_unique_id, count(DISTINCT order_id) AS unique_orders,
    count(DISTINCT product_category_name_english) AS unique_categories, count(DISTINCT seller_id) AS unique_sellers
  FROM v_orders JOIN v_customers USING (customer_id) JOIN v_items USING (order_id) JOIN v_english USING (product_id)
  GROUP BY 1"""


def _bought(spark: SparkSession, folder: str) -> DataFrame:
    shop = read_star_shop(spark, folder)
    return (
        joins.items_with_products(shop)
        .join(joins.orders_with_customers(shop).select("order_id", PERSON), "order_id")
        .select(
            PERSON,
            F.col("order_id").alias("orders"),
            F.col("product_category_name_english").alias("categories"),
            F.col("seller_id").alias("sellers"),
        )
    )


@query("distinct_counts", with_views("english", query=_DISTINCT_SQL))
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return agg.distinct_counts(_bought(spark, folder), PERSON, ["orders", "categories", "sellers"])


@query("distinct_counts_approx")
def distinct_counts_approx(spark: SparkSession, folder: str) -> DataFrame:
    return agg.distinct_counts(_bought(spark, folder), PERSON, ["orders", "categories", "sellers"], exact=False)


@query(
    "distinct_sketch_check",
    with_views(
        "english",
        query=f"""SELECT unnest(['categories', 'orders', 'sellers']) AS counted, (SELECT count(*) FROM ({_DISTINCT_SQL})) AS people,
          0::BIGINT AS outside, true AS united""",
    ),
)
def distinct_sketch_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per column: people whose estimate is outside 5 % (three deviations) of the exact count, and whether all sketches
    united come within it of the count over all people."""
    columns = ["categories", "orders", "sellers"]
    bought = materialize(_bought(spark, folder), "bought")
    sketches = materialize(agg.distinct_sketches(bought, PERSON, columns), "sketches")
    exact = agg.distinct_counts(bought, PERSON, columns)
    near = agg.distinct_estimates(sketches, [PERSON], columns).toDF(PERSON, *(f"near_{c}" for c in columns))
    everyone = agg.distinct_estimates(sketches, [], columns)
    real = bought.agg(*(F.count_distinct(c).alias(f"all_{c}") for c in columns))

    def off(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) > 0.05 * F.col(b)

    people = exact.join(near, PERSON, "full").agg(
        F.count("*").alias("people"),
        *(F.count_if(F.coalesce(off(f"near_{c}", f"unique_{c}"), F.lit(True))).alias(f"off_{c}") for c in columns),
    )
    rows = [
        F.struct(F.lit(c).alias("counted"), "people", F.col(f"off_{c}").alias("outside"), (~off(f"unique_{c}", f"all_{c}")).alias("united"))
        for c in columns
    ]
    # One row on either side.
    one = people.withColumn("one", F.lit(1)).join(everyone.withColumn("one", F.lit(1)), "one").join(real.withColumn("one", F.lit(1)), "one")
    return one.select(F.inline(F.array(*rows)))


@query(
    "mode_state_city",
    with_views(
        "shop",
        query="""SELECT s.seller_id, s.customer_state, c.customer_city FROM
  (SELECT * FROM (SELECT seller_id, customer_state,
     row_number() OVER (PARTITION BY seller_id ORDER BY count(*) DESC, customer_state) AS place
   FROM v_orders JOIN v_customers USING (customer_id) JOIN v_items USING (order_id) GROUP BY 1, 2) WHERE place = 1) s
  JOIN
  (SELECT * FROM (SELECT seller_id, customer_city,
     row_number() OVER (PARTITION BY seller_id ORDER BY count(*) DESC, customer_city) AS place
   FROM v_orders JOIN v_customers USING (customer_id) JOIN v_items USING (order_id) GROUP BY 1, 2) WHERE place = 1) c
  USING (seller_id)""",
    ),
)
def mode_state_city(spark: SparkSession, folder: str) -> DataFrame:
    """Usual home of each seller's buyers: many states and cities per group, with ties."""
    shop = read_star_shop(spark, folder)
    homes = joins.orders_with_customers(shop).select("order_id", *feat.GEOGRAPHY)
    return agg.mode_per_group(shop.items.join(homes, "order_id"), "seller_id", feat.GEOGRAPHY)


@query(
    "label_distribution",
    with_views("fc", query="SELECT bnpl_target, count(*) AS n FROM fc GROUP BY 1"),
)
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return agg.value_counts(feat.features_clean(read_star_shop(spark, folder)), feat.LABEL)


@query(
    "top10_categories",
    with_views(
        "english",
        query="""SELECT product_category_name_english, count(*) AS n FROM v_items JOIN v_english USING (product_id)
                 WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
    ),
)
def top10_categories(spark: SparkSession, folder: str) -> DataFrame:
    sold = joins.items_with_products(read_star_shop(spark, folder))
    name = "product_category_name_english"
    return agg.value_counts(sold.where(F.col(name).isNotNull()), name).orderBy(F.desc("n"), name).limit(10)


# --- samples -----------------------------------------------------------------------------------------


@query("sample_customers", with_views("shop", _SAMPLED, query="SELECT customer_unique_id FROM s_people"))
def sample_customers(spark: SparkSession, folder: str) -> DataFrame:
    return feat.sampled_people(read_star_shop(spark, folder), SAMPLE_FRACTION)
