"""Joins of the shop tables, shaped to stay even when one key holds a large share of the rows.

No broadcast hints here: lookup tables are broadcast by Spark when their measured size is under
``spark.sql.autoBroadcastJoinThreshold``, otherwise the join shuffles and adaptive execution
splits hot keys: on either side of an inner join, on the left of a left or semi join. It can do so only
where both inputs come straight from a shuffle. Where the other side would be an aggregate that is
already partitioned by the key, that side is written first and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from custlens.operators.aggregates import payments_per_order_with_mode
from custlens.session import materialize
from custlens.sources.shop import Shop

PERSON = "customer_unique_id"


def orders_with_customers(shop: Shop, how: str = "inner") -> DataFrame:
    return shop.orders.join(shop.customers, "customer_id", how)


def orders_with_items(shop: Shop) -> DataFrame:
    return shop.orders.join(shop.items, "order_id")


def products_in_english(shop: Shop) -> DataFrame:
    """Every product with its English category, null where the category has no translation."""
    return shop.products.join(shop.translation, "product_category_name", "left")


def items_with_products(shop: Shop) -> DataFrame:
    return shop.items.join(products_in_english(shop), "product_id")


def items_with_sellers(shop: Shop) -> DataFrame:
    return shop.items.join(shop.sellers, "seller_id", "left")


def attach_many(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """``one LEFT JOIN many`` where ``key`` is unique in ``one`` and may be hot in ``many``.

    A left join cannot split a hot key of its right side. The matched part is therefore an inner
    join, which can, and rows without a match are added from an anti join.
    """
    matched = one.join(many, key)
    unmatched = one.join(many.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def keep_members(rows: DataFrame, members: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Rows whose key occurs in ``members``.

    Members that are not ``unique`` shrink to one row per key before they are shuffled, so that a
    key may repeat there without end. With unique members a hot key of ``rows`` can be split.
    """
    keys = members.select(key)
    return rows.join(keys if unique else keys.distinct(), key, "left_semi")


def home_rows_per_person(shop: Shop) -> DataFrame:
    """Customer rows per person, which is how often each of their orders repeats in a join on the person."""
    return shop.customers.groupBy(PERSON).agg(F.count("*").alias("home_rows"))


def geo_fanout(shop: Shop) -> DataFrame:
    """Orders joined to customers on the person (many to many), as one row per order and its multiplicity.

    ``home_rows`` says how many rows the order would take, so sums stay exact while a person with
    many orders costs their number of orders, not its square.
    """
    return orders_with_customers(shop).join(materialize(home_rows_per_person(shop), "homes"), PERSON)


def items_with_payments(shop: Shop) -> DataFrame:
    """Every item with the one reduced payment row of its order."""
    return shop.items.join(materialize(payments_per_order_with_mode(shop.payments), "payments"), "order_id")
