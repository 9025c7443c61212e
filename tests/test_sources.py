import datetime as dt

import pytest

from custlens.plans import features as feat
from custlens.plans.studies import profile_folder
from custlens.sources import discover_tables, read_csv_shop, read_table
from custlens.sources.sinks import CSV_OPTIONS, write_table

FILES = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    "c1,ann,01409,sao paulo,SP\nc2,bob,20000,rio,RJ\n",
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
    "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c1,delivered,2018-01-02 03:04:05,,,,2018-02-01 00:00:00\n"
    "o2,c2,delivered,2018-01-05 00:00:00,,,,\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    "o1,1,p1,s1,2018-01-03 00:00:00,10.50,1.25\no2,1,p2,s1,2018-01-06 00:00:00,3.00,0.50\n",
    "order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,credit_card,3,11.75\no2,1,boleto,1,3.50\n",
    "order_reviews": "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    'review_creation_date,review_answer_timestamp\nr1,o1,4,,"two\nlines, ""quoted""",2018-01-09 00:00:00,\n',
    "products": "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,"
    "product_weight_g,product_length_cm,product_height_cm,product_width_cm\np1,casa,1,1,1,100,1,1,1\np2,,,,,,,,\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,sao paulo,SP\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}_dataset.csv").write_text(text)
    (tmp_path / "product_category_name_translation.csv").write_bytes(
        b"\xef\xbb\xbfproduct_category_name,product_category_name_english\ncasa,home\n"
    )
    return str(tmp_path)


def test_csv_shop(spark, folder):
    shop = read_csv_shop(spark, folder)
    assert shop.translation.first().asDict() == {
        "product_category_name": "casa",
        "product_category_name_english": "home",
    }
    assert shop.customers.orderBy("customer_id").first()["customer_zip_code_prefix"] == "01409"
    assert shop.orders.orderBy("order_id").first()["order_purchase_timestamp"] == dt.datetime(2018, 1, 2, 3, 4, 5)
    assert shop.reviews.first()["review_comment_message"] == 'two\nlines, "quoted"'
    rows = {r["customer_unique_id"]: r for r in feat.features_clean(shop).collect()}
    assert rows["ann"]["bnpl_target"] == 1 and rows["ann"]["recency"] == 2
    assert rows["bob"]["unique_product_categories"] == 0 and rows["bob"]["avg_review_score"] is None


def test_pruned_csv_reads_only_the_columns(spark, folder):
    table = read_table(spark, f"{folder}/orders_dataset.csv", columns=["order_id"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:string>" in plan


def test_discovery_goes_on_after_a_bad_table(spark, tmp_path):
    write_table(spark.range(3), str(tmp_path / "good.parquet"))
    (tmp_path / "bad.parquet").write_text("not parquet")
    tables, errors = discover_tables(spark, str(tmp_path), "*.parquet", "parquet")
    assert list(tables) == ["good"] and tables["good"].count() == 3
    assert list(errors) == ["bad"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_sinks_round_trip(spark, tmp_path, fmt):
    rows = [(1, 0.1, "a,b"), (2, None, 'say "x", now'), (3, 1.0, "two\nlines"), (4, 2.0, ""), (5, 3.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, s string")
    write_table(df, str(tmp_path / fmt), fmt)
    reader = spark.read.schema(df.schema).options(**(CSV_OPTIONS if fmt == "csv" else {}))
    assert sorted(tuple(r) for r in reader.format(fmt).load(str(tmp_path / fmt)).collect()) == rows


def test_profile_of_a_folder(spark, folder):
    rows = {(r["table_name"], r["column_name"]): r for r in profile_folder(spark, folder).collect()}
    assert rows["products_dataset", "product_category_name"]["null_count"] == 1
    assert rows["products_dataset", "product_category_name"]["null_pct"] == 50.0
    assert rows["orders_dataset", "order_purchase_timestamp"]["data_type"].startswith("timestamp")
    assert rows["customers_dataset", "customer_id"]["n_columns"] == 5


def test_profile_names_unreadable_tables(spark, tmp_path):
    write_table(spark.range(3), str(tmp_path / "a good one.parquet"))
    (tmp_path / "bad.parquet").write_text("not parquet")
    rows = {r["table_name"]: r for r in profile_folder(spark, str(tmp_path), "*.parquet", "parquet").collect()}
    assert rows["bad"]["error"] and rows["a good one"]["n_rows"] == 3 and rows["a good one"]["error"] is None


def test_profile_counts_rows_with_line_breaks(spark, tmp_path):
    text = 'review_id,review_score,message\na,5,"one\ntwo\nthree ""x"""\nb,4,"four\n"\n'
    (tmp_path / "reviews.csv").write_text(text)
    rows = {r["column_name"]: r for r in profile_folder(spark, str(tmp_path)).collect()}
    assert rows["review_score"]["n_rows"] == 2 and rows["review_score"]["null_count"] == 0
