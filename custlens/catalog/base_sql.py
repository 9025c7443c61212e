"""Shared pieces of the SQL statements: the shop views and the customer rows."""

SHOP = """
v_customers AS (
  SELECT o_orderkey AS customer_id, o_custkey AS customer_unique_id, n_name AS customer_state,
         n_name || '/' || c_mktsegment AS customer_city
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
v_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp FROM orders),
v_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value
  FROM lineitem),
v_products AS (SELECT p_partkey AS product_id, p_brand AS product_category_name FROM part),
v_translation AS (
  SELECT DISTINCT p_brand AS product_category_name, lower(p_brand) AS product_category_name_english
  FROM part WHERE p_brand <> 'Brand#1'),
v_sellers AS (
  SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
v_paid AS (
  SELECT l_orderkey AS order_id, l_returnflag AS payment_type,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,4))
           AS payment_value
  FROM lineitem GROUP BY ALL),
v_payments AS (
  SELECT order_id, payment_type, payment_value,
         CAST(row_number() OVER (PARTITION BY order_id ORDER BY payment_type) AS INTEGER) AS payment_sequential,
         CAST(CASE WHEN o_totalprice >= 465000 THEN 2 + order_id % 9 ELSE 1 END AS INTEGER) AS payment_installments
  FROM v_paid JOIN orders ON order_id = o_orderkey),
v_reviews AS (
  SELECT event_id AS review_id, (event_id * 4) // 5 AS order_id, CAST(1 + user_id % 5 AS INTEGER) AS review_score,
         CASE WHEN event_type = 'error' THEN event_type END AS review_comment_title,
         CASE WHEN event_type IN ('error', 'click') THEN props END AS review_comment_message,
         ts AS review_creation_date
  FROM events)
"""

PER_ORDER = """
o_items AS (
  SELECT order_id, count(order_item_id) AS n_items, CAST(sum(price) AS DOUBLE) AS total_price,
         CAST(sum(freight_value) AS DOUBLE) AS total_freight,
         CAST(sum(price) AS DOUBLE) / count(price) AS avg_price,
         CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS avg_freight
  FROM v_items GROUP BY 1),
o_payments AS (
  SELECT order_id, count(payment_sequential) AS n_payments, CAST(sum(payment_value) AS DOUBLE) AS total_payment_value,
         CAST(sum(payment_value) AS DOUBLE) / count(payment_value) AS avg_payment_value,
         max(payment_installments) AS max_installments, avg(payment_installments) AS avg_installments
  FROM v_payments GROUP BY 1),
o_payments_mode AS (
  SELECT p.order_id, CAST(sum(payment_value) AS DOUBLE) AS payment_value,
         avg(payment_installments) AS payment_installments, any_value(m.payment_type) AS payment_type
  FROM v_payments p JOIN (
    SELECT order_id, payment_type FROM (
      SELECT order_id, payment_type,
             row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) AS place
      FROM v_payments GROUP BY 1, 2) WHERE place = 1) m ON p.order_id = m.order_id
  GROUP BY 1),
o_reviews AS (
  SELECT order_id, count(review_id) AS n_reviews, avg(review_score) AS avg_review_score FROM v_reviews GROUP BY 1),
o_comments AS (
  SELECT order_id, avg(review_score) AS avg_review_score, count(review_comment_title) AS comment_title_count,
         count(review_comment_message) AS comment_message_count
  FROM v_reviews GROUP BY 1)
"""

WIDE_V1 = """
w1 AS (
  SELECT * FROM v_orders LEFT JOIN v_customers USING (customer_id) LEFT JOIN o_items USING (order_id)
  LEFT JOIN o_payments USING (order_id) LEFT JOIN o_reviews USING (order_id))
"""

ENGLISH = """
v_english AS (
  SELECT product_id, product_category_name_english
  FROM v_products LEFT JOIN v_translation USING (product_category_name))
"""

WIDE_V2 = """
w2 AS (
  SELECT * FROM v_orders JOIN v_customers USING (customer_id) JOIN v_items USING (order_id)
  JOIN v_english USING (product_id) LEFT JOIN v_sellers USING (seller_id)
  JOIN o_payments_mode USING (order_id) LEFT JOIN o_comments USING (order_id))
"""

# The raw join, every row of it.
WIDE_V3 = """
w3 AS (
  SELECT * FROM (SELECT order_id, order_purchase_timestamp, customer_unique_id
                 FROM v_orders JOIN v_customers USING (customer_id))
  JOIN (SELECT customer_unique_id, customer_state, customer_city FROM v_customers) USING (customer_unique_id)
  JOIN v_items USING (order_id) JOIN v_english USING (product_id) LEFT JOIN v_sellers USING (seller_id)
  JOIN v_payments USING (order_id) LEFT JOIN v_reviews USING (order_id))
"""

FEATURES_V1 = """
f1 AS (
  SELECT customer_id,
         CAST(floor((epoch_us((SELECT max(order_purchase_timestamp) FROM w1)) - epoch_us(max(order_purchase_timestamp)))
              / 86400000000) AS BIGINT) AS recency,
         count(DISTINCT order_id) AS frequency, coalesce(sum(total_payment_value), 0) AS monetary,
         avg(total_payment_value) AS avg_monetary, avg(n_items) AS avg_items_per_order,
         avg(total_freight) AS avg_freight_per_order, avg(avg_installments) AS avg_installments,
         avg(avg_review_score) AS avg_review_score,
         CAST(count(*) FILTER (n_reviews > 0) * 100 AS DOUBLE) / count(*) AS pct_orders_with_review,
         any_value(customer_state) AS customer_state, any_value(customer_city) AS customer_city
  FROM w1 GROUP BY 1)
"""


def _mode(table: str, column: str) -> str:
    return f"""{table}_{column} AS (
  SELECT customer_unique_id, {column} FROM (
    SELECT customer_unique_id, {column},
           row_number() OVER (PARTITION BY customer_unique_id ORDER BY count(*) DESC, {column}) AS place
    FROM {table} WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE place = 1)"""


def _person_features(name: str, table: str, paid: str, instalments: str, score: str) -> str:
    modes = ", ".join(_mode(table, c) for c in ("customer_state", "customer_city"))
    return f"""{modes},
{name} AS (
  SELECT g.*, coalesce(s.customer_state, 'unknown') AS customer_state, coalesce(c.customer_city, 'unknown') AS customer_city
  FROM (
    SELECT customer_unique_id,
           CAST(floor((epoch_us((SELECT max(order_purchase_timestamp) FROM {table})) - epoch_us(max(order_purchase_timestamp)))
                / 86400000000) AS BIGINT) AS recency,
           count(DISTINCT order_id) AS frequency,
           CAST(sum({paid}) AS DOUBLE) AS monetary, CAST(sum({paid}) AS DOUBLE) / count({paid}) AS avg_monetary,
           avg(order_item_id) AS avg_items_per_order,
           CAST(sum(freight_value) AS DOUBLE) / count(freight_value) AS avg_freight_per_order,
           avg({instalments}) AS avg_installments, max(payment_installments) AS max_installments,
           avg({score}) AS avg_review_score,
           CAST(count({score}) AS DOUBLE) / count(*) AS pct_orders_with_review,
           count(DISTINCT product_category_name_english) AS unique_product_categories,
           count(DISTINCT seller_id) AS unique_sellers
    FROM {table} GROUP BY 1) g
  LEFT JOIN {table}_customer_state s USING (customer_unique_id)
  LEFT JOIN {table}_customer_city c USING (customer_unique_id))"""


FEATURES_V2 = _person_features(
    "f2", "w2", "CAST(payment_value AS DECIMAL(18,4))", "payment_installments", "avg_review_score"
)
FEATURES_V3 = _person_features("f3", "w3", "payment_value", "payment_installments", "review_score")

FEATURES_CLEAN = """
wc AS (
  SELECT * FROM v_orders JOIN v_customers USING (customer_id) LEFT JOIN o_items USING (order_id)
  LEFT JOIN o_payments USING (order_id) LEFT JOIN o_reviews USING (order_id)
  LEFT JOIN (SELECT order_id, sum(payment_value) AS paid_exact FROM v_payments GROUP BY 1) USING (order_id)
  LEFT JOIN (SELECT order_id, sum(freight_value) AS freight_exact FROM v_items GROUP BY 1) USING (order_id)),
wd AS (
  SELECT customer_unique_id, count(DISTINCT product_category_name_english) AS unique_product_categories,
         count(DISTINCT seller_id) AS unique_sellers
  FROM v_orders JOIN v_customers USING (customer_id) JOIN v_items USING (order_id)
  LEFT JOIN v_english USING (product_id) GROUP BY 1),
""" + ", ".join(_mode("wc", c) for c in ("customer_state", "customer_city")) + """,
fc AS (
  SELECT g.*, coalesce(unique_product_categories, 0) AS unique_product_categories,
         coalesce(unique_sellers, 0) AS unique_sellers,
         coalesce(s.customer_state, 'unknown') AS customer_state, coalesce(c.customer_city, 'unknown') AS customer_city
  FROM (
    SELECT customer_unique_id,
           CAST(floor((epoch_us((SELECT max(order_purchase_timestamp) FROM v_orders)) - epoch_us(max(order_purchase_timestamp)))
                / 86400000000) AS BIGINT) AS recency,
           count(*) AS frequency, coalesce(CAST(sum(paid_exact) AS DOUBLE), 0) AS monetary,
           CAST(sum(paid_exact) AS DOUBLE) / count(paid_exact) AS avg_monetary,
           avg(n_items) AS avg_items_per_order,
           CAST(sum(freight_exact) AS DOUBLE) / count(freight_exact) AS avg_freight_per_order,
           avg(avg_installments) AS avg_installments, avg(avg_review_score) AS avg_review_score,
           CAST(count(*) FILTER (n_reviews > 0) AS DOUBLE) / count(*) AS pct_orders_with_review,
           CAST(coalesce(max(max_installments), 0) >= 2 AS INTEGER) AS bnpl_target
    FROM wc GROUP BY 1) g
  LEFT JOIN wd USING (customer_unique_id)
  LEFT JOIN wc_customer_state s USING (customer_unique_id)
  LEFT JOIN wc_customer_city c USING (customer_unique_id))
"""

_PARTS = {
    "shop": SHOP,
    "orders": PER_ORDER,
    "w1": WIDE_V1,
    "english": ENGLISH,
    "w2": WIDE_V2,
    "w3": WIDE_V3,
    "f1": FEATURES_V1,
    "f2": FEATURES_V2,
    "f3": FEATURES_V3,
    "fc": FEATURES_CLEAN,
}
_NEEDS = {
    "shop": [],
    "orders": ["shop"],
    "english": ["shop"],
    "w1": ["shop", "orders"],
    "w2": ["shop", "orders", "english"],
    "w3": ["shop", "english"],
    "f1": ["shop", "orders", "w1"],
    "f2": ["shop", "orders", "english", "w2"],
    "f3": ["shop", "english", "w3"],
    "fc": ["shop", "orders", "english"],
}


def with_views(part: str, *more: str, query: str) -> str:
    """``query`` preceded by the named part, all it needs, and further CTE texts."""
    names = [*_NEEDS[part], part]
    return "WITH " + ",".join([*(_PARTS[n].strip() for n in names), *(m.strip() for m in more)]) + "\n" + query
