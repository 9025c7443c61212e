"""CSV folders: declared schemas, pruned scans and table discovery."""

from __future__ import annotations

from fnmatch import fnmatch

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from custlens.sources.shop import Shop

# Columns of the raw tables, by table name.
SCHEMAS = {
    "customers": """customer_id string, customer_unique_id string, customer_zip_code_prefix string,
        customer_city string, customer_state string""",
    "orders": """order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    "order_items": """order_id string, order_item_id int, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price decimal(18,2), freight_value decimal(18,2)""",
    "order_payments": """order_id string, payment_sequential int, payment_type string,
        payment_installments int, payment_value decimal(18,2)""",
    "order_reviews": """review_id string, order_id string, review_score int,
        review_comment_title string, review_comment_message string,
        review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz""",
    "products": """product_id string, product_category_name string, product_name_lenght double,
        product_description_lenght double, product_photos_qty double, product_weight_g double,
        product_length_cm double, product_height_cm double, product_width_cm double""",
    "sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    "product_category_name_translation": "product_category_name string, product_category_name_english string",
}


# Tables whose quoted text may hold line breaks.
MULTILINE = {"order_reviews"}


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    columns: list[str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Scan one CSV file or folder with a header; ``columns`` reach the reader as its pruned schema.

    Header names are matched to the declared schema, so a file whose columns moved fails instead of
    shifting values. ``multiline`` keeps quoted line breaks whole but reads each file in one task:
    keep such tables in many files.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    # Univocity drops a leading UTF-8 byte-order mark, so the first header name is clean.
    reader = reader.schema(schema).option("enforceSchema", False) if schema else reader.option("inferSchema", True)
    table = reader.csv(path)
    return table.select(*columns) if columns else table


def read_csv_shop(spark: SparkSession, folder: str, prefix: str = "", suffix: str = "_dataset.csv") -> Shop:
    """The eight tables used from ``{folder}/{prefix}{table}{suffix}``, each with its declared schema."""

    def table(name: str) -> DataFrame:
        return read_table(
            spark, f"{folder}/{prefix}{name}{suffix}", SCHEMAS[name], multiline=name in MULTILINE
        )

    return Shop(
        customers=table("customers"),
        orders=table("orders"),
        items=table("order_items"),
        products=table("products"),
        translation=read_table(
            spark,
            f"{folder}/product_category_name_translation.csv",
            SCHEMAS["product_category_name_translation"],
        ),
        sellers=table("sellers"),
        payments=table("order_payments"),
        reviews=table("order_reviews"),
    )


def discover_tables(
    spark: SparkSession, folder: str, pattern: str = "*.csv", fmt: str = "csv", multiline: bool = True
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every file or table folder in ``folder`` that matches, and the errors of those that fail.

    The folder's store lists it, one level and no content, so any store that Spark can read works. Free text may hold
    quoted line breaks, so CSV is read with ``multiline`` unless told otherwise. A folder that does not exist raises.
    """
    folder = folder.rstrip("/")
    tables, errors = {}, {}
    for entry in _entries(spark, folder):
        if not fnmatch(entry, pattern):
            continue
        name = entry.rsplit(".", 1)[0]
        try:
            path = f"{folder}/{entry}"
            tables[name] = read_table(spark, path, multiline=multiline) if fmt == "csv" else spark.read.format(fmt).load(path)
        except (PySparkException, Py4JError) as error:
            errors[name] = str(error).splitlines()[0]
    return tables, errors


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly in ``folder``, as its store lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in store.listStatus(path))
