import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from shops import T0, awkward_shop, hot_shop, make_shop, raw_join_features

from custlens.operators import aggregates as agg, joins
from custlens.plans import features as feat


def same(actual, expected):
    if expected is None or (isinstance(expected, float) and math.isnan(expected)):
        return actual is None or (isinstance(actual, float) and math.isnan(actual))
    if isinstance(expected, (int, float)):
        return actual == pytest.approx(expected)
    return actual == expected


@pytest.mark.parametrize("make", [awkward_shop, hot_shop])
def test_v3_equals_the_raw_join(spark, make):
    shop = make(spark)
    expected, joined = raw_join_features(shop)
    actual = {r["customer_unique_id"]: r.asDict() for r in feat.features_v3(shop).collect()}
    labels = {r["customer_unique_id"]: r["bnpl_target"] for r in feat.bnpl_features(shop).collect()}
    assert set(actual) == set(expected["customer_unique_id"])
    for row in expected.to_dict("records"):
        got = {**actual[row["customer_unique_id"]], "bnpl_target": labels[row["customer_unique_id"]]}
        for name, value in row.items():
            assert same(got[name], value), (row["customer_unique_id"], name, got[name], value)
    assert feat.wide_v3(shop).agg(F.sum("joined_rows")).first()[0] == joined


def test_clean_keeps_everyone(spark):
    rows = {r["customer_unique_id"]: r for r in feat.features_clean(awkward_shop(spark)).collect()}
    assert set(rows) == {"ann", "bob", "cat", "dan"}
    ann, cat, dan = rows["ann"], rows["cat"], rows["dan"]
    assert ann["frequency"] == 3 and ann["monetary"] == pytest.approx(44.7)
    assert ann["customer_state"] == "RJ"  # RJ and SP once each: the smaller
    assert ann["customer_city"] == "y" and ann["bnpl_target"] == 1
    assert cat["customer_state"] == "unknown" and cat["avg_items_per_order"] is None
    assert cat["unique_sellers"] == 0 and cat["pct_orders_with_review"] == 1.0
    assert dan["monetary"] == 0.0 and dan["avg_monetary"] is None and dan["bnpl_target"] == 0


def test_v1_sums_nothing_to_zero_and_counts_reviews_in_percent(spark):
    rows = {r["customer_id"]: r for r in feat.features_v1(awkward_shop(spark)).collect()}
    assert rows["c6"]["monetary"] == 0.0 and rows["c6"]["avg_monetary"] is None
    assert rows["c1"]["pct_orders_with_review"] == 100.0 and rows["c4"]["pct_orders_with_review"] == 0.0
    assert rows["c1"]["avg_installments"] == 2.0 and rows["c3"]["avg_installments"] is None


def test_v2_repeats_a_payment_per_item(spark):
    rows = {r["customer_unique_id"]: r for r in feat.features_v2(awkward_shop(spark)).collect()}
    assert set(rows) == {"ann", "bob"}
    assert rows["ann"]["monetary"] == pytest.approx(2 * 31.5 + 5.5 + 7.7)
    # Two item rows of o1 in SP against one of o2 in RJ.
    assert rows["ann"]["customer_state"] == "SP"


def test_recency_counts_whole_days(spark):
    orders = [
        ("a", "a", "new", "SP", "x", T0 + dt.timedelta(days=2)),
        ("b", "b", "almost", "SP", "x", T0 + dt.timedelta(days=1, minutes=1)),
        ("c", "c", "exactly", "SP", "x", T0 + dt.timedelta(days=1)),
    ]
    shop = make_shop(spark, orders, [("a", 1, "p1", "s1", "1.00", "1.00")], [("a", 1, "card", 1, "1.00")], [("r", "a", 1, None, None)])
    rows = {r["customer_unique_id"]: r["recency"] for r in feat.features_clean(shop).collect()}
    assert rows == {"new": 0, "almost": 0, "exactly": 1}


def test_attach_many_keeps_unmatched(spark):
    one = spark.createDataFrame([("a",), ("b",)], "k string")
    many = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "k string, v int")
    rows = sorted(((r["k"], r["v"]) for r in joins.attach_many(one, many, "k").collect()), key=str)
    assert rows == [("a", 1), ("a", 2), ("b", None)]


def test_payment_mode_defaults_and_ties(spark):
    payments = spark.createDataFrame(
        [("o1", 1, "b", 1, 1.0), ("o1", 2, "a", 1, 1.0), ("o2", 1, None, 2, 1.0)],
        "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double",
    )
    rows = {r["order_id"]: r["payment_type"] for r in agg.payments_per_order_with_mode(payments).collect()}
    assert rows == {"o1": "a", "o2": "not_defined"}


def test_sample_takes_whole_people(spark):
    shop = hot_shop(spark)
    sampled = feat.sample_shop(shop, 0.3)
    people = {r[0] for r in feat.sampled_people(shop, 0.3).collect()}
    everyone = joins.orders_with_customers(shop).where(F.col("customer_unique_id").isin(people)).count()
    assert sampled.orders.count() == everyone
    assert 0 < len(people) < 41
    orders = {r[0] for r in sampled.orders.select("order_id").collect()}
    assert {r[0] for r in sampled.items.select("order_id").collect()} <= orders


@pytest.mark.parametrize("make", [lambda s: feat._diversity(s, True), feat.wide_v2, joins.items_with_payments])
def test_a_hot_order_is_split(spark, make):
    """With thresholds scaled down to the fixture, adaptive execution must split the order that holds most items."""
    orders = [(f"o{i}", f"c{i}", f"p{i}", "SP", "x", T0) for i in range(400)]
    items = [(f"o{i % 400 if i % 2 else 7}", i, f"p{i % 4 + 1}", f"s{i % 2 + 1}", "2.00", "0.25") for i in range(20_000)]
    payments = [(f"o{i}", 1, "card", 1, "2.00") for i in range(400)]
    shop = make_shop(spark, orders, items, payments, [("r", "o1", 5, None, None)])
    shop = replace(shop, items=shop.items.repartition(8).persist())
    expected = make(shop).count()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = make(shop)
        assert len(rows.collect()) == expected
        assert "SortMergeJoin(skew=true) [order_id" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
        shop.items.unpersist()
