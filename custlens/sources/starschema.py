"""Shop tables derived from a star schema of orders, lines, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from custlens.sources.shop import Shop

# The order total from which payment is spread, and the brand left untranslated.
INSTALMENT_TOTAL = 465000
UNTRANSLATED_BRAND = "Brand#1"


def read_star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_star_shop(spark: SparkSession, folder: str) -> Shop:
    def table(name: str) -> DataFrame:
        return read_star_table(spark, folder, name)

    nation = table("nation").select("n_nationkey", "n_name")
    line = table("lineitem")
    order = table("orders")
    price = F.col("l_extendedprice").cast("decimal(18,2)")

    customers = (
        order.select("o_orderkey", "o_custkey")
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
            F.concat_ws("/", "n_name", "c_mktsegment").alias("customer_city"),
        )
    )
    orders = order.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    items = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("freight_value"),
    )
    products = table("part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_category_name")
    )
    translation = (
        products.select("product_category_name")
        .distinct()
        .where(F.col("product_category_name") != UNTRANSLATED_BRAND)
        .withColumn("product_category_name_english", F.lower("product_category_name"))
    )
    sellers = (
        table("supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))
    )
    paid = line.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("payment_type")).agg(
        F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("payment_value")
    )
    payments = (
        paid.join(order.select(F.col("o_orderkey").alias("order_id"), "o_totalprice"), "order_id")
        .withColumn("payment_sequential", F.row_number().over(W.partitionBy("order_id").orderBy("payment_type")))
        .withColumn(
            "payment_installments",
            F.when(F.col("o_totalprice") >= INSTALMENT_TOTAL, 2 + F.col("order_id") % 9).otherwise(1).cast("int"),
        )
        .drop("o_totalprice")
    )
    kind = F.col("event_type")
    reviews = table("events").select(
        F.col("event_id").alias("review_id"),
        F.expr("(event_id * 4) div 5").alias("order_id"),
        (1 + F.col("user_id") % 5).cast("int").alias("review_score"),
        F.when(kind == "error", kind).alias("review_comment_title"),
        F.when(kind.isin("error", "click"), F.col("props")).alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
    )
    return Shop(customers, orders, items, products, translation, sellers, payments, reviews)
