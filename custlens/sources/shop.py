"""The tables of one web shop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Shop:
    """Eight related tables; ``customer_id`` is one per order, ``customer_unique_id`` is the person."""

    customers: DataFrame
    orders: DataFrame
    items: DataFrame
    products: DataFrame
    translation: DataFrame
    sellers: DataFrame
    payments: DataFrame
    reviews: DataFrame
