"""Small shops with the awkward cases, and a plain pandas statement of the raw-join features."""

import datetime as dt
from decimal import Decimal

import pandas as pd

from custlens.sources.shop import Shop

T0 = dt.datetime(2020, 1, 1)


def make_shop(spark, orders, items, payments, reviews, customers=None, products=None):
    """orders: (order_id, customer_id, person, state, city, timestamp); the rest as in the schemas below."""
    customers = customers or [(c, p, s, t) for _, c, p, s, t, _ in orders]
    products = products or [("p1", "casa"), ("p2", "auto"), ("p3", None), ("p4", "raro")]

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Shop(
        customers=frame(
            customers, "customer_id string, customer_unique_id string, customer_state string, customer_city string"
        ),
        orders=frame(
            [(o, c, t) for o, c, _, _, _, t in orders],
            "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz",
        ),
        items=frame(
            [(o, i, p, s, Decimal(a), Decimal(b) if b is not None else None) for o, i, p, s, a, b in items],
            "order_id string, order_item_id int, product_id string, seller_id string,"
            " price decimal(18,2), freight_value decimal(18,2)",
        ),
        products=frame(products, "product_id string, product_category_name string"),
        translation=frame(
            [("casa", "home"), ("auto", "car")], "product_category_name string, product_category_name_english string"
        ),
        sellers=frame([("s1", "SP"), ("s2", "RJ")], "seller_id string, seller_state string"),
        payments=frame(
            [(o, i, k, n, Decimal(v)) for o, i, k, n, v in payments],
            "order_id string, payment_sequential int, payment_type string, payment_installments int,"
            " payment_value decimal(18,2)",
        ),
        reviews=frame(
            reviews,
            "review_id string, order_id string, review_score int, review_comment_title string,"
            " review_comment_message string",
        ),
    )


def awkward_shop(spark):
    day = dt.timedelta(days=1)
    orders = [
        ("o1", "c1", "ann", "SP", "x", T0),
        ("o2", "c2", "ann", "RJ", "y", T0 + 3 * day),
        ("o3", "c3", "ann", None, "y", T0 + 5 * day),
        ("o4", "c4", "bob", "SP", "x", T0 + 9 * day + dt.timedelta(hours=23)),
        ("o5", "c5", "cat", None, None, T0 + 10 * day),  # no items
        ("o6", "c6", "dan", "MG", "z", T0 + 2 * day),  # no payments
    ]
    items = [
        ("o1", 1, "p1", "s1", "10.00", "1.50"),
        ("o1", 2, "p2", "s2", "20.00", None),
        ("o2", 1, "p3", "s1", "5.00", "0.50"),
        ("o3", 1, "p1", "s2", "7.00", "0.70"),
        ("o4", 1, "p4", "s1", "9.00", "0.90"),
        ("o4", 2, "missing", "s9", "1.00", "0.10"),
        ("o6", 1, "p1", "s1", "3.00", "0.30"),
    ]
    payments = [
        ("o1", 1, "card", 3, "20.00"),
        ("o1", 2, "voucher", 1, "11.50"),
        ("o2", 1, "card", 1, "5.50"),
        ("o3", 1, "card", None, "7.70"),
        ("o4", 1, "boleto", 1, "9.90"),
        ("o5", 1, "card", 1, "1.00"),
    ]
    reviews = [
        ("r1", "o1", 5, None, "good"),
        ("r2", "o1", None, "t", None),
        ("r3", "o2", 2, None, None),
        ("r4", "o5", 1, None, None),
    ]
    return make_shop(spark, orders, items, payments, reviews)


def hot_shop(spark, size=60):
    """One person with a third of the orders, one order with a third of items, payments and reviews."""
    orders = [(f"o{i}", f"c{i}", "hot" if i % 3 == 0 else f"p{i}", "SP", "x", T0 + dt.timedelta(hours=i)) for i in range(size)]
    items, payments, reviews = [], [], []
    for i in range(size):
        for j in range(size // 2 if i == 1 else 1):
            items.append((f"o{i}", j + 1, f"p{j % 4 + 1}", f"s{j % 2 + 1}", "2.00", "0.25"))
            payments.append((f"o{i}", j + 1, "card", j % 4 + 1, f"{i + j}.10"))
            if i % 2:
                reviews.append((f"r{i}-{j}", f"o{i}", j % 5 + 1, None, None))
    return make_shop(spark, orders, items, payments, reviews)


def raw_join_features(shop):
    """The customer rows by literally joining everything in pandas."""
    t = {name: getattr(shop, name).toPandas() for name in shop.__dataclass_fields__}
    for name, columns in {"items": ["price", "freight_value"], "payments": ["payment_value"]}.items():
        for c in columns:
            t[name][c] = t[name][c].astype(float)
    people = t["orders"].merge(t["customers"][["customer_id", "customer_unique_id"]], on="customer_id")
    wide = people.merge(t["customers"].drop(columns="customer_id"), on="customer_unique_id")
    english = t["products"].merge(t["translation"], on="product_category_name", how="left")
    wide = wide.merge(t["items"], on="order_id").merge(english, on="product_id")
    wide = wide.merge(t["payments"], on="order_id").merge(t["reviews"], on="order_id", how="left")
    newest = wide["order_purchase_timestamp"].max()
    rows = []
    for person, g in wide.groupby("customer_unique_id"):
        modes = {c: g[c].mode() for c in ("customer_state", "customer_city")}
        rows.append(
            {
                "customer_unique_id": person,
                "recency": (newest - g["order_purchase_timestamp"].max()).days,
                "frequency": g["order_id"].nunique(),
                "monetary": g["payment_value"].sum(),
                "avg_monetary": g["payment_value"].mean(),
                "avg_items_per_order": g["order_item_id"].mean(),
                "avg_freight_per_order": g["freight_value"].mean(),
                "avg_installments": g["payment_installments"].mean(),
                "avg_review_score": g["review_score"].mean(),
                "pct_orders_with_review": g["review_score"].notna().mean(),
                "unique_product_categories": g["product_category_name_english"].nunique(),
                "unique_sellers": g["seller_id"].nunique(),
                **{c: m.iloc[0] if len(m) else "unknown" for c, m in modes.items()},
                "bnpl_target": int(g["payment_installments"].max() >= 2),
            }
        )
    return pd.DataFrame(rows), len(wide)
