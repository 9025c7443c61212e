"""One row per customer: recency, frequency, spend, behaviour and home.

Four recipes share one pattern: reduce items, payments and reviews to one row per order, join those,
then group by customer. Only the two distinct counts return to single items. Their differences:

* ``features_v1``     keyed by ``customer_id``; every order counts; review share is 0-100.
* ``features_v2``     keyed by person; an order weighs as many rows as it has items.
* ``features_v3``     keyed by person; an order weighs items x payments x reviews x customer rows. The
  weights are multiplied, the rows are never built.
* ``features_clean``  keyed by person; an order weighs one row. The recommended default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.hashing import in_sample
from custlens.functions.scalars import ratio, whole_days
from custlens.operators import aggregates as agg, joins
from custlens.operators.joins import PERSON
from custlens.session import materialize
from custlens.sources.shop import Shop

# Feature names and label, by group.
RFM = ["recency", "frequency", "monetary"]
BEHAVIOUR = [
    "avg_monetary",
    "avg_items_per_order",
    "avg_freight_per_order",
    "avg_review_score",
    "pct_orders_with_review",
    "unique_product_categories",
    "unique_sellers",
]
GEOGRAPHY = ["customer_state", "customer_city"]
LABEL = "bnpl_target"
FEATURE_SETS = {"A": RFM, "B": RFM + BEHAVIOUR, "C": RFM + BEHAVIOUR + GEOGRAPHY, "D": RFM + BEHAVIOUR + GEOGRAPHY}
SEGMENT_NUMERIC = [
    "recency",
    "frequency",
    "monetary",
    "avg_monetary",
    "avg_items_per_order",
    "avg_freight_per_order",
    "avg_installments",
    "avg_review_score",
    "pct_orders_with_review",
    "unique_product_categories",
    "unique_sellers",
]

WHEN = "order_purchase_timestamp"
LABEL_INSTALMENTS = 2


def wide_v1(shop: Shop) -> DataFrame:
    """Every order with its customer and its per-order item, payment and review aggregates."""
    return (
        joins.orders_with_customers(shop, "left")
        .join(agg.items_per_order(shop.items), "order_id", "left")
        .join(agg.payments_per_order(shop.payments), "order_id", "left")
        .join(agg.reviews_per_order(shop.reviews), "order_id", "left")
    )


def wide_v2(shop: Shop) -> DataFrame:
    """Every sold item of a paid order, with product, seller, payment and review columns.

    All that is known per order is joined at one row per order, before the items come in.
    """
    orders = (
        shop.orders.join(agg.payments_per_order_with_mode(shop.payments), "order_id")
        .join(agg.comments_per_order(shop.reviews), "order_id", "left")
        .join(shop.customers, "customer_id")
    )
    return (
        shop.items.join(orders, "order_id")
        .join(joins.products_in_english(shop).drop("product_category_name"), "product_id")
        .join(shop.sellers, "seller_id", "left")
    )


def wide_v3(shop: Shop) -> DataFrame:
    """The raw join of all tables, held as one row per order with its multiplicities.

    ``joined_rows`` is the number of rows the order takes in the raw join, and the ``*_weight``
    columns say how often one item, payment or review of the order is repeated there.
    """
    items, payments, homes = (_exact(c) for c in ("item_rows", "payment_rows", "home_rows"))
    reviews = F.greatest(F.coalesce(F.col("review_rows"), F.lit(0)), F.lit(1))
    return (
        sold_orders(shop)
        .join(materialize(joins.home_rows_per_person(shop), "homes"), PERSON)
        .withColumn("item_weight", payments * reviews * homes)
        .withColumn("payment_weight", items * reviews * homes)
        .withColumn("review_weight", items * payments * homes)
        .withColumn("joined_rows", items * payments * reviews * homes)
    )


def sold_orders(shop: Shop) -> DataFrame:
    """Orders with a customer, at least one item of a known product and at least one payment."""
    known_items = joins.keep_members(shop.items, shop.products, "product_id", unique=True)
    return (
        joins.orders_with_customers(shop)
        .join(agg.item_measures(known_items), "order_id")
        .join(agg.payment_measures(shop.payments), "order_id")
        .join(agg.review_measures(shop.reviews), "order_id", "left")
    )


def features_v1(shop: Shop) -> DataFrame:
    orders = wide_v1(shop)
    newest = agg.latest(shop.orders, WHEN)
    rows = F.count("*")
    return (
        orders.groupBy("customer_id")
        .agg(
            F.max(WHEN).alias("last_order"),
            F.count_distinct("order_id").alias("frequency"),
            F.coalesce(F.sum("total_payment_value"), F.lit(0.0)).alias("monetary"),
            F.avg("total_payment_value").alias("avg_monetary"),
            F.avg("n_items").alias("avg_items_per_order"),
            F.avg("total_freight").alias("avg_freight_per_order"),
            F.avg("avg_installments").alias("avg_installments"),
            F.avg("avg_review_score").alias("avg_review_score"),
            ratio(F.count_if(F.col("n_reviews") > 0) * 100, rows).alias("pct_orders_with_review"),
        )
        .withColumn("recency", whole_days(newest, F.col("last_order")))
        .join(shop.customers.select("customer_id", *GEOGRAPHY), "customer_id", "left")
        .select("customer_id", *RFM, *SEGMENT_NUMERIC[3:9], *GEOGRAPHY)
    )


def features_v2(shop: Shop) -> DataFrame:
    rows = F.col("item_rows")
    instalments = ratio(F.col("instalment_sum"), F.col("instalment_rows"))
    score = ratio(F.col("score_sum"), F.col("score_rows"))
    measures = {
        "paid": F.col("paid_sum") * rows,
        "paid_n": rows,
        "position": F.col("position_sum"),
        "position_n": rows,
        "freight": F.col("freight_sum"),
        "freight_n": F.col("freight_rows"),
        "instalment": instalments * rows,
        "instalment_n": F.when(instalments.isNotNull(), rows),
        "score": score * rows,
        "score_n": F.when(score.isNotNull(), rows),
        "scored_rows": F.when(score.isNotNull(), rows),
        "rows": rows,
    }
    orders = sold_orders(shop)
    people = _per_person(orders, measures, home_weight=rows)
    return _finish(people, _diversity(shop, paid_only=True)).select(PERSON, *SEGMENT_NUMERIC, *GEOGRAPHY)


def features_v3(shop: Shop, with_label: bool = False) -> DataFrame:
    items, payments = _exact("item_rows"), _exact("payment_rows")
    reviews = F.greatest(F.coalesce(F.col("review_rows"), F.lit(0)), F.lit(1))
    measures = {
        "paid": items * reviews * F.col("paid_sum"),
        "paid_n": items * reviews * F.col("paid_rows"),
        "position": payments * reviews * F.col("position_sum"),
        "position_n": items * payments * reviews,
        "freight": payments * reviews * F.col("freight_sum"),
        "freight_n": payments * reviews * F.col("freight_rows"),
        "instalment": items * reviews * F.col("instalment_sum"),
        "instalment_n": items * reviews * F.col("instalment_rows"),
        "score": items * payments * F.col("score_sum"),
        "score_n": items * payments * F.col("score_rows"),
        "scored_rows": items * payments * F.coalesce(F.col("score_rows"), F.lit(0)),
        "rows": items * payments * reviews,
    }
    # In the raw join every order of a person meets all their customer rows, so homes are counted there.
    homes = agg.mode_per_group(shop.customers, PERSON, GEOGRAPHY)
    people = (
        _per_person(sold_orders(shop), measures)
        .join(joins.home_rows_per_person(shop), PERSON)
        .withColumns({name: F.col(name) * _exact("home_rows") for name in measures})
        .withColumn("paid_total", F.col("paid").cast("double"))
        .join(homes, PERSON)
    )
    columns = [c for c in SEGMENT_NUMERIC if not (with_label and c == "avg_installments")]
    return _finish(people, _diversity(shop, paid_only=True)).select(
        PERSON, *columns, *GEOGRAPHY, *([LABEL] if with_label else [])
    )


def bnpl_features(shop: Shop) -> DataFrame:
    """The classifier's rows: ``features_v3`` without instalments, labelled by paying in two or more."""
    return features_v3(shop, with_label=True)


def features_clean(shop: Shop) -> DataFrame:
    orders = (
        joins.orders_with_customers(shop)
        .join(agg.item_measures(shop.items), "order_id", "left")
        .join(agg.payment_measures(shop.payments), "order_id", "left")
        .join(agg.review_measures(shop.reviews), "order_id", "left")
    )
    one = F.lit(1)
    instalments = ratio(F.col("instalment_sum"), F.col("instalment_rows"))
    score = ratio(F.col("score_sum"), F.col("score_rows"))

    def present(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), one)

    measures = {
        "paid": F.col("paid_sum"),
        "paid_n": present("paid_sum"),
        "position": F.col("item_rows"),
        "position_n": present("item_rows"),
        "freight": F.col("freight_sum"),
        "freight_n": present("freight_sum"),
        "instalment": instalments,
        "instalment_n": F.when(instalments.isNotNull(), one),
        "score": score,
        "score_n": F.when(score.isNotNull(), one),
        "scored_rows": present("review_rows"),
        "rows": one,
    }
    people = _per_person(orders, measures, home_weight=one)
    return _finish(people, _diversity(shop, paid_only=False), newest=agg.latest(shop.orders, WHEN)).select(
        PERSON, *SEGMENT_NUMERIC, *GEOGRAPHY, LABEL
    )


RECIPES = {"v1": features_v1, "v2": features_v2, "v3": features_v3, "clean": features_clean}


def sample_shop(shop: Shop, fraction: float, key: str = "customer_id") -> Shop:
    """All rows of the people behind a sample of customer rows, with the facts cut before any join.

    The people and their orders, which every other table is cut by, are written once.
    """
    people = materialize(sampled_people(shop, fraction, key), "sampled-people")
    customers = materialize(joins.keep_members(shop.customers, people, PERSON, unique=True), "sampled-customers")
    orders = materialize(joins.keep_members(shop.orders, customers, "customer_id", unique=True), "sampled-orders")

    def of_orders(rows: DataFrame) -> DataFrame:
        return joins.keep_members(rows, orders, "order_id", unique=True)

    return Shop(
        customers=customers,
        orders=orders,
        items=of_orders(shop.items),
        products=shop.products,
        translation=shop.translation,
        sellers=shop.sellers,
        payments=of_orders(shop.payments),
        reviews=of_orders(shop.reviews),
    )


def sampled_people(shop: Shop, fraction: float, key: str = "customer_id") -> DataFrame:
    return shop.customers.where(in_sample(key, fraction)).select(PERSON).distinct()


def _per_person(orders: DataFrame, measures: dict[str, Column], home_weight: Column | None = None) -> DataFrame:
    """Sum the measures per person, with the usual home weighted by ``home_weight`` unless none is given.

    For the home every order is a row per column of it, of which the first carries the measures. They are grouped
    by person and level and then by person, both combining on the map side.
    """
    if home_weight is None:
        return orders.groupBy(PERSON).agg(
            F.max(WHEN).alias("last_order"),
            F.count("*").alias("frequency"),
            F.max("instalment_max").alias("instalment_max"),
            *(F.sum(value).alias(name) for name, value in measures.items()),
        )
    once = lambda value: F.when(F.col("place") == 0, value)
    per_level = (
        orders.select("*", agg.levels(GEOGRAPHY))
        .groupBy(PERSON, "place", "level")
        .agg(
            F.max(once(F.col(WHEN))).alias("last_order"),
            F.count(once(F.lit(1))).alias("frequency"),
            F.max(once(F.col("instalment_max"))).alias("instalment_max"),
            *(F.sum(once(value)).alias(name) for name, value in measures.items()),
            F.sum(home_weight).cast("long").alias("weight"),
        )
    )
    return (
        per_level.groupBy(PERSON)
        .agg(
            F.max("last_order").alias("last_order"),
            F.sum("frequency").alias("frequency"),
            F.max("instalment_max").alias("instalment_max"),
            *(F.sum(name).alias(name) for name in measures),
            *(agg.heaviest_level(i, "unknown").alias(c) for i, c in enumerate(GEOGRAPHY)),
        )
        .withColumn("paid_total", F.coalesce(F.col("paid").cast("double"), F.lit(0.0)))
    )


def _diversity(shop: Shop, paid_only: bool) -> DataFrame:
    """Distinct categories and sellers per person, from the items of their orders."""
    orders = shop.orders.select("order_id", "customer_id")
    if paid_only:
        orders = joins.keep_members(orders, shop.payments, "order_id")
    people = orders.join(shop.customers, "customer_id").select("order_id", PERSON)
    categories = joins.products_in_english(shop).select(
        "product_id", F.col("product_category_name_english").alias("product_categories")
    )
    bought = (
        shop.items.select("order_id", "product_id", F.col("seller_id").alias("sellers"))
        .join(categories, "product_id", "inner" if paid_only else "left")
        .join(people, "order_id")
    )
    return agg.distinct_counts(bought, PERSON, ["product_categories", "sellers"])


def _finish(people: DataFrame, diversity: DataFrame, newest: Column | None = None) -> DataFrame:
    """Turn sums into features. Without a given ``newest`` time it is that of the people themselves,
    who are then written once, so that the time is not found by running all joins again."""
    if newest is None:
        people = materialize(people, "people")
        newest = agg.latest(people, "last_order")
    means = {
        "avg_monetary": "paid",
        "avg_items_per_order": "position",
        "avg_freight_per_order": "freight",
        "avg_installments": "instalment",
        "avg_review_score": "score",
    }
    return people.join(diversity, PERSON, "left").select(
        PERSON,
        whole_days(newest, F.col("last_order")).alias("recency"),
        "frequency",
        F.col("paid_total").alias("monetary"),
        *(ratio(F.col(part), F.col(f"{part}_n")).alias(name) for name, part in means.items()),
        F.coalesce(ratio(F.col("scored_rows"), F.col("rows")), F.lit(0.0)).alias("pct_orders_with_review"),
        F.coalesce("unique_product_categories", F.lit(0)).alias("unique_product_categories"),
        F.coalesce("unique_sellers", F.lit(0)).alias("unique_sellers"),
        *GEOGRAPHY,
        (F.coalesce("instalment_max", F.lit(0)) >= LABEL_INSTALMENTS).cast("int").alias(LABEL),
    )


def _exact(column: str) -> Column:
    """A count wide enough for products of counts."""
    return F.col(column).cast("decimal(38,0)")
