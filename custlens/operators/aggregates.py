"""Per-order aggregates and grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from custlens.functions.scalars import ratio

ORDER = "order_id"


def items_per_order(items: DataFrame) -> DataFrame:
    return items.groupBy(ORDER).agg(
        F.count("order_item_id").alias("n_items"),
        _total("price").alias("total_price"),
        _total("freight_value").alias("total_freight"),
        _mean("price").alias("avg_price"),
        _mean("freight_value").alias("avg_freight"),
    )


def payments_per_order(payments: DataFrame) -> DataFrame:
    return payments.groupBy(ORDER).agg(
        F.count("payment_sequential").alias("n_payments"),
        _total("payment_value").alias("total_payment_value"),
        _mean("payment_value").alias("avg_payment_value"),
        F.max("payment_installments").alias("max_installments"),
        _mean("payment_installments").alias("avg_installments"),
    )


def payments_per_order_with_mode(payments: DataFrame) -> DataFrame:
    """As the reduced payment table, with the usual payment type (few types, so its state is small)."""
    return payments.groupBy(ORDER).agg(
        _total("payment_value").alias("payment_value"),
        _mean("payment_installments").alias("payment_installments"),
        F.coalesce(F.mode("payment_type", True), F.lit("not_defined")).alias("payment_type"),
    )


def reviews_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(ORDER).agg(
        F.count("review_id").alias("n_reviews"), _mean("review_score").alias("avg_review_score")
    )


def comments_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(ORDER).agg(
        _mean("review_score").alias("avg_review_score"),
        F.count("review_comment_title").alias("comment_title_count"),
        F.count("review_comment_message").alias("comment_message_count"),
    )


def item_measures(items: DataFrame) -> DataFrame:
    """Sums and non-null counts per order, from which every weighted mean can be rebuilt."""
    return items.groupBy(ORDER).agg(
        F.count("*").alias("item_rows"),
        _sum("order_item_id").alias("position_sum"),
        _sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_rows"),
    )


def payment_measures(payments: DataFrame) -> DataFrame:
    return payments.groupBy(ORDER).agg(
        F.count("*").alias("payment_rows"),
        _sum("payment_value").alias("paid_sum"),
        F.count("payment_value").alias("paid_rows"),
        _sum("payment_installments").alias("instalment_sum"),
        F.count("payment_installments").alias("instalment_rows"),
        F.max("payment_installments").alias("instalment_max"),
    )


def review_measures(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(ORDER).agg(
        F.count("*").alias("review_rows"),
        _sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_rows"),
    )


def latest(df: DataFrame, column: str) -> Column:
    """The greatest value of a column as a one-row subquery, usable inside another query."""
    return df.agg(F.max(column)).scalar()


def levels(columns: Sequence[str]) -> Column:
    """Generator of a row per string column: its ``place`` in ``columns`` and its value as ``level``."""
    return F.posexplode(F.array(*columns)).alias("place", "level")


def heaviest_level(place: int, default: str) -> Column:
    """Aggregate over rows ``place, level, weight``: the heaviest known level of a place, ties to the smallest."""
    known = (F.col("place") == place) & F.col("level").isNotNull()
    heaviest = F.min(F.when(known, F.struct((-F.col("weight")).alias("lightness"), "level")))
    return F.coalesce(heaviest["level"], F.lit(default))


def mode_per_group(
    df: DataFrame, group: str, columns: Sequence[str], weight: Column | None = None, default: str = "unknown"
) -> DataFrame:
    """Most frequent value of each string column per group.

    Two groupings, by value and by group, that both combine on the map side and keep a row of fixed size per
    key: a group of any number of rows and values is never gathered.
    """
    weight = F.lit(1) if weight is None else weight
    weighted = df.select(group, *columns, weight.alias("weight")).select(group, "weight", levels(columns))
    per_level = weighted.groupBy(group, "place", "level").agg(F.sum("weight").cast("long").alias("weight"))
    return per_level.groupBy(group).agg(*(heaviest_level(i, default).alias(c) for i, c in enumerate(columns)))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent non-null value, ties to the smallest; no row when all are null."""
    return value_counts(df.where(F.col(column).isNotNull()), column).orderBy(F.desc("n"), column).limit(1)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, group: str, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values per group; the sketches of ``exact=False`` need one shuffle less."""
    if not exact:
        return distinct_estimates(distinct_sketches(df, group, columns), [group], columns)
    return df.groupBy(group).agg(*(F.count_distinct(c).alias(f"unique_{c}") for c in columns))


def distinct_sketches(df: DataFrame, group: str, columns: Sequence[str], bits: int = 12) -> DataFrame:
    """One mergeable HyperLogLog sketch per group and column, to be stored and united later.

    A sketch of ``bits`` 12 errs by 1.7 % (one standard deviation) and is at most 4 KB; few values make a small and exact one.
    A column without values has an empty sketch.
    """
    return df.groupBy(group).agg(
        *(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"sketch_{c}") for c in columns)
    )


def distinct_estimates(sketches: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values after uniting the stored sketches by any columns of theirs, or all into one row."""
    united = (F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"unique_{c}") for c in columns)
    return sketches.groupBy(*by).agg(*united)


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _total(column: str) -> Column:
    return _sum(column).cast("double")


def _mean(column: str) -> Column:
    return ratio(F.sum(column), F.count(column))
