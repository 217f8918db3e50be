"""The constraints of the tables, declared once and audited in one aggregate a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.functions.normalize import EMAIL
from martline.operators import quality as dq
from martline.plans.book import query
from martline.plans.views import Core

#: What the enumerations of the shop allow.
CUSTOMER_STATUS = ["active", "inactive"]
PRODUCT_STATUS = ["active", "inactive", "discontinued"]
ORDER_STATUS = ["pending", "confirmed", "shipped", "completed", "cancelled"]
CHANNEL = ["web", "mobile_app", "social"]
PAYMENT_METHOD = ["cash", "bank_transfer", "card", "e_wallet"]
PAYMENT_STATUS = ["pending", "success", "failed", "refunded"]


def _one_of(column: str, allowed: list[str]) -> dq.Check:
    return dq.Check(f"{column} is allowed", ~F.col(column).isin(allowed))


def _at_least_zero(*columns: str) -> list[dq.Check]:
    return [dq.Check(f"{c} >= 0", F.col(c) < 0) for c in columns]


def shop_contracts(now: str, customers: DataFrame, products: DataFrame, orders: DataFrame, categories: DataFrame, statuses: DataFrame) -> dict[str, dq.Contract]:
    """The contract of each table of the shop as of the instant ``now``; the frames are what foreign keys point to."""
    today = F.lit(now).cast("timestamp")
    stamps = dq.Check("updated_at >= created_at", F.col("updated_at") < F.col("created_at"))
    return {
        "customers": dq.Contract(
            [*dq.not_null("customer_id", "full_name", "email", "customer_segment", "status"), _one_of("status", CUSTOMER_STATUS), dq.Check("email is an address", ~F.col("email").rlike(EMAIL))],
            [["customer_id"], ["email"]],
        ),
        "products": dq.Contract(
            [*dq.not_null("product_id", "category_id", "product_name", "unit_price", "cost_price", "status"), *_at_least_zero("unit_price", "cost_price"), _one_of("status", PRODUCT_STATUS), dq.Check("unit_price >= cost_price", F.col("unit_price") < F.col("cost_price"))],
            [["product_id"]], [("category_id", categories, "category_id")],
        ),
        "orders": dq.Contract(
            [*dq.not_null("order_id", "customer_id", "order_date", "order_status", "channel", "order_total"), *_at_least_zero("order_total"), _one_of("channel", CHANNEL), dq.Check("order_date is past", F.col("order_date") > today), stamps],
            [["order_id"]], [("customer_id", customers, "customer_id"), ("order_status", statuses, "order_status")],
        ),
        "order_items": dq.Contract(
            [*dq.not_null("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount"), dq.Check("1 <= quantity <= 1000", (F.col("quantity") < 1) | (F.col("quantity") > 1000)), *_at_least_zero("unit_price", "discount_amount"), dq.Check("discount_amount <= gross", F.col("discount_amount") > F.col("unit_price") * F.col("quantity"))],
            [["order_item_id"]], [("order_id", orders, "order_id"), ("product_id", products, "product_id")],
        ),
        "payments": dq.Contract(
            [*dq.not_null("payment_id", "order_id", "payment_date", "payment_method", "payment_status", "amount"), dq.Check("amount > 0", F.col("amount") <= 0), _one_of("payment_method", PAYMENT_METHOD), _one_of("payment_status", PAYMENT_STATUS), dq.Check("payment_date is past", F.col("payment_date") > today)],
            [["payment_id"]], [("order_id", orders, "order_id")],
        ),
    }


# The driver tables are mostly clean, so the audits of the queries run over tables in which a rule spoils some rows.

_SPOILT_ORDERS = """SELECT order_id, CASE WHEN order_id % 31 = 0 THEN -customer_id ELSE customer_id END AS customer_id, CASE WHEN order_id % 37 = 0 THEN NULL ELSE order_date END AS order_date, order_status,
    CASE order_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'social' WHEN 2 THEN 'mobile_app' ELSE NULL END AS channel, CASE WHEN order_id % 29 = 0 THEN -order_total ELSE order_total END AS order_total,
    order_date AS created_at, order_date + to_days((order_id % 7 - 1)::INT) AS updated_at FROM core_orders"""


def spoilt_orders(c: Core) -> DataFrame:
    key = F.col("order_id")
    channel = F.when(key % 4 == 0, "web").when(key % 4 == 1, "social").when(key % 4 == 2, "mobile_app")
    return c.orders.select(
        "order_id", F.when(key % 31 == 0, -F.col("customer_id")).otherwise(F.col("customer_id")).alias("customer_id"), F.when(key % 37 != 0, F.col("order_date")).alias("order_date"), "order_status",
        channel.alias("channel"), F.when(key % 29 == 0, -F.col("order_total")).otherwise(F.col("order_total")).alias("order_total"), F.col("order_date").alias("created_at"),
        (F.col("order_date") + F.make_dt_interval((key % 7 - 1).cast("int"))).alias("updated_at"),
    )


def _told(rows: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM {table} WHERE {fails}) AS violations" for name, fails in rows.items())


_ORDER_ROWS = {f"{k} is not null": f"{k} IS NULL" for k in ("order_id", "customer_id", "order_date", "order_status", "channel", "order_total")} | {
    "order_total >= 0": "order_total < 0", "channel is allowed": "channel NOT IN ('web', 'mobile_app', 'social')", "order_date is past": "order_date > TIMESTAMP '1998-01-01'", "updated_at >= created_at": "updated_at < created_at",
    "customer_id is known": "customer_id NOT IN (SELECT customer_id FROM customers)", "order_status is known": "order_status NOT IN ('pending', 'completed')",
}


@query(f", t AS ({_SPOILT_ORDERS}) {_told(_ORDER_ROWS, 't')} UNION ALL SELECT 'unique order_id', (SELECT count(*) - count(DISTINCT order_id) FROM t)")
def dq_contract_orders(c: Core) -> DataFrame:
    """Thirteen constraints of orders, as of 1998, against a lookup that lacks the status shipped."""
    statuses = c.spark.createDataFrame([("pending",), ("completed",)], "order_status string")
    contracts = shop_contracts("1998-01-01", c.customers, c.products, c.orders, c.categories, statuses)
    return contracts["orders"].audit(spoilt_orders(c))


_SPOILT_ITEMS = """SELECT l_orderkey * 100 + l_linenumber AS order_item_id, CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_orderkey END AS order_id, CASE WHEN l_partkey % 43 = 0 THEN -l_partkey ELSE l_partkey END AS product_id,
    (l_quantity * CASE WHEN l_partkey % 47 = 0 THEN 100 WHEN l_partkey % 53 = 0 THEN 0 ELSE 1 END)::INT AS quantity, (l_extendedprice / l_quantity)::DECIMAL(14,2) AS unit_price,
    CASE WHEN l_partkey % 59 = 0 THEN -1 WHEN l_partkey % 61 = 0 THEN l_extendedprice * 2 ELSE 0 END::DECIMAL(14,2) AS discount_amount FROM lineitem"""


def spoilt_items(c: Core) -> DataFrame:
    """Lines as they came, repeated ones too."""
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    times = F.when(part % 47 == 0, 100).when(part % 53 == 0, 0).otherwise(1)
    off = F.when(part % 59 == 0, F.lit(-1.0)).when(part % 61 == 0, F.col("l_extendedprice") * 2).otherwise(F.lit(0.0))
    return c.raw("lineitem").select(
        (order * 100 + F.col("l_linenumber")).alias("order_item_id"), F.when(order % 41 != 0, order).alias("order_id"), F.when(part % 43 == 0, -part).otherwise(part).alias("product_id"),
        (F.col("l_quantity") * times).cast("int").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(14,2)").alias("unit_price"), off.cast("decimal(14,2)").alias("discount_amount"),
    )


_ITEM_ROWS = {f"{k} is not null": f"{k} IS NULL" for k in ("order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount_amount")} | {
    "1 <= quantity <= 1000": "quantity < 1 OR quantity > 1000", "unit_price >= 0": "unit_price < 0", "discount_amount >= 0": "discount_amount < 0", "discount_amount <= gross": "discount_amount > unit_price * quantity",
    "order_id is known": "order_id NOT IN (SELECT order_id FROM core_orders)", "product_id is known": "product_id NOT IN (SELECT product_id FROM products)",
}


@query(f", t AS ({_SPOILT_ITEMS}) {_told(_ITEM_ROWS, 't')} UNION ALL SELECT 'unique order_item_id', (SELECT count(*) - count(DISTINCT order_item_id) FROM t)")
def dq_contract_items(c: Core) -> DataFrame:
    """Thirteen constraints of order items, over the lines as they came."""
    contracts = shop_contracts("1998-01-01", c.customers, c.products, c.orders, c.categories, c.orders.select("order_status"))
    return contracts["order_items"].audit(spoilt_items(c))
