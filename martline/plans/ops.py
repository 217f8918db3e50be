"""Quality, state and incremental operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.functions import normalize as nz
from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.operators import state
from martline.plans.book import query
from martline.plans.views import Core
from martline.sources import files

_RAW = "raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 7 = 0 THEN 'bad' ELSE user_id || '@x.com' END AS email, CASE WHEN event_id % 13 = 0 THEN 'junk' ELSE ' ' || value::DECIMAL(14,2) || ' ' END AS amount, upper(event_type) AS status FROM events)"


def _raw(c: Core) -> DataFrame:
    email = F.when(F.col("event_id") % 11 == 0, " ").when(F.col("event_id") % 7 == 0, "bad").otherwise(F.concat("user_id", F.lit("@x.com")))
    amount = F.when(F.col("event_id") % 13 == 0, "junk").otherwise(F.concat(F.lit(" "), F.col("value").cast("decimal(14,2)"), F.lit(" ")))
    return c.raw("events").select("event_id", email.alias("Email "), amount.alias("amount"), F.upper("event_type").alias("STATUS"))


@query(f", {_RAW} SELECT event_id, trim(email) AS email, CASE WHEN amount = 'junk' THEN NULL ELSE trim(amount)::DOUBLE END AS amount, lower(status) AS status FROM raw", name="normalize_columns")
def normalized(c: Core) -> DataFrame:
    return nz.normalize(_raw(c), lower=("status",), numeric=("amount",)).withColumn("amount", F.col("amount").cast("double"))


_TAG = f", {_RAW}, codes AS (SELECT event_id, list_filter([CASE WHEN trim(email) = 'bad' THEN 'INVALID_EMAIL' END, CASE WHEN lower(status) NOT IN ('view', 'click', 'purchase') THEN 'INVALID_STATUS' END, CASE WHEN amount <> 'junk' AND try_cast(trim(amount) AS DECIMAL(14,2)) <= 10 THEN 'AMOUNT_TOO_LOW' END], lambda x: x IS NOT NULL) AS e FROM raw)"


def _tagged(c: Core) -> DataFrame:
    low = dq.Rule("AMOUNT_TOO_LOW", F.col("amount") <= 10)
    return dq.tag(nz.normalize(_raw(c), lower=("status",), numeric=("amount",)), [dq.email("email"), dq.one_of("status", ["view", "click", "purchase"]), low])


@query(f"{_TAG} SELECT event_id, array_to_string(e, '|') AS error_code FROM codes WHERE len(e) > 0")
def dq_split(c: Core) -> DataFrame:
    return dq.split(_tagged(c))[1].select("event_id", "error_code")


@query(f"{_TAG} SELECT code, count(*) AS n FROM (SELECT unnest(e) AS code FROM codes) GROUP BY 1")
def agg_violation_counts(c: Core) -> DataFrame:
    return dq.violations(dq.split(_tagged(c))[1])


@query(f"{_TAG} SELECT event_type AS dataset, count(*) AS input, count(*) FILTER (len(e) = 0) AS valid, count(*) FILTER (len(e) > 0) AS rejected FROM codes JOIN events USING (event_id) GROUP BY 1")
def dq_invariant(c: Core) -> DataFrame:
    """Counted in three frames: what came in, and both outputs of the split."""
    tagged = _tagged(c).join(c.raw("events").select("event_id", F.col("event_type").alias("dataset")), "event_id")
    return dq.check_invariant(c.raw("events").select(F.col("event_type").alias("dataset")), *dq.split(tagged))


@query(f", {_RAW} SELECT event_id, (CASE WHEN trim(email) = '' THEN 67 ELSE 100 END)::INT AS score, CASE WHEN trim(email) = '' THEN 'email' ELSE '' END AS missing FROM raw")
def dq_completeness_score(c: Core) -> DataFrame:
    df = dq.completeness(_raw(c).withColumnsRenamed({"Email ": "email", "STATUS": "status"}), ["email", "amount", "status"])
    return df.select("event_id", "score", F.array_join("missing_cols", "|").alias("missing"))


@query("SELECT count(*) AS orphans FROM core_orders WHERE customer_id NOT IN (SELECT customer_id FROM customers WHERE customer_id % 50 <> 0)")
def dq_foreign_keys(c: Core) -> DataFrame:
    tagged = dq.foreign_key(dq.tag(c.orders, []), "customer_id", c.customers.filter("customer_id % 50 <> 0"), "customer_id", "FK_CUSTOMER_NOT_FOUND")
    return tagged.agg(F.count_if(F.col("error_code") == "FK_CUSTOMER_NOT_FOUND").alias("orphans"))


@query("SELECT payment_id FROM payments JOIN core_orders USING (order_id) WHERE payment_date < order_date")
def dq_chronology(c: Core) -> DataFrame:
    return c.payments.join(c.orders, "order_id").filter("payment_date < order_date").select("payment_id")


@query("SELECT count(*) FILTER (quantity < 1 OR quantity > 1000) AS bad_quantity, count(*) FILTER (discount > gross) AS bad_discount, count(*) - count(DISTINCT item_id) AS duplicate_keys FROM items")
def dq_constraints(c: Core) -> DataFrame:
    return c.items.agg(F.count_if((F.col("quantity") < 1) | (F.col("quantity") > 1000)).alias("bad_quantity"), F.count_if(F.col("discount") > F.col("gross")).alias("bad_discount"), (F.count(F.lit(1)) - F.countDistinct("item_id")).alias("duplicate_keys"))


@query("SELECT product_id, CASE WHEN product_id % 10 = 0 THEN round(unit_price * 1.1, 2) ELSE unit_price END::DOUBLE AS unit_price, product_name, CASE WHEN product_id % 10 = 0 AND product_id % 3 = 0 THEN 'insert' WHEN product_id % 10 = 0 THEN 'update' ELSE 'keep' END AS _op FROM products WHERE product_id % 3 <> 0 OR product_id % 10 = 0".replace("product_name, CASE", "CASE WHEN product_id % 3 = 0 THEN NULL ELSE product_name END AS product_name, CASE"))
def upsert(c: Core) -> DataFrame:
    target = c.products.filter("product_id % 3 <> 0").select("product_id", "unit_price", "product_name")
    batch = c.products.filter("product_id % 10 = 0").select("product_id", F.round(F.col("unit_price") * F.lit("1.1").cast("decimal(2,1)"), 2).cast("decimal(14,2)").alias("unit_price"))
    return state.upsert(target, batch, ["product_id"]).withColumn("unit_price", F.col("unit_price").cast("double"))


@query("SELECT count(*) AS members, max(k) AS top, count(DISTINCT k) AS keys FROM (SELECT segment, row_number() OVER () AS k FROM (SELECT DISTINCT segment FROM customers))")
def surrogate_keys(c: Core) -> DataFrame:
    known = c.spark.range(0).select(F.lit("").alias("segment"), F.col("id").alias("key"))
    half = state.assign_keys(known, c.customers.filter("customer_id % 2 = 0"), "segment")
    return state.assign_keys(half, c.customers, "segment").agg(F.count(F.lit(1)).alias("members"), F.max("key").alias("top"), F.countDistinct("key").alias("keys"))


@query("SELECT product_id, unit_price::DOUBLE AS unit_price, DATE '1900-01-01' AS valid_from, CASE WHEN product_id % 10 = 0 THEN DATE '2026-06-30' ELSE DATE '9999-12-31' END AS valid_to, product_id % 10 <> 0 AS is_current FROM products UNION ALL SELECT product_id, (unit_price + 1)::DOUBLE, DATE '2026-07-01', DATE '9999-12-31', true FROM products WHERE product_id % 10 = 0")
def scd2(c: Core) -> DataFrame:
    first = c.products.select("product_id", "unit_price")
    empty = first.limit(0).select("product_id", "unit_price", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    dim = state.scd2(empty, first, "product_id", ["unit_price"], "2026-01-01")
    later = first.withColumn("unit_price", F.when(F.col("product_id") % 10 == 0, F.col("unit_price") + 1).otherwise(F.col("unit_price")).cast("decimal(14,2)"))
    return state.scd2(dim, later, "product_id", ["unit_price"], "2026-07-01").withColumn("unit_price", F.col("unit_price").cast("double"))


@query("SELECT event_type, max(ts) AS watermark FROM events GROUP BY 1")
def high_watermark(c: Core) -> DataFrame:
    return c.raw("events").groupBy("event_type").agg(F.max("ts").alias("watermark"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def incremental_pull(c: Core) -> DataFrame:
    """Rows strictly after the watermark; the filter is pushed to the scan."""
    return files.incremental(c.raw("events"), "2024-01-15 00:00:00", ("ts",)).select("event_id")


@query("SELECT order_id FROM core_orders ORDER BY order_id LIMIT 100 OFFSET 200")
def page_slice(c: Core) -> DataFrame:
    return c.orders.orderBy("order_id").offset(200).limit(100).select("order_id")


#: The shares of the statuses in a hundred made orders, the number of customers and days, the first day's start
#: (UTC) and the range of totals, in the SQL and in ``orders_made``.
_SYNTH = """SELECT 'ORD' || lpad(g::VARCHAR, 10, '0') AS order_id, 'CUS' || lpad((g % 100000 + 1)::VARCHAR, 8, '0') AS customer_id,
    TIMESTAMP '2023-12-31 17:00:00' + to_days((g % 730)::INT) + to_seconds(g % 86400) AS order_date,
    CASE WHEN g % 100 < 78 THEN 'completed' WHEN g % 100 < 87 THEN 'shipped' WHEN g % 100 < 92 THEN 'confirmed' WHEN g % 100 < 97 THEN 'cancelled' ELSE 'pending' END AS status,
    ((50000 + g % 4500000) / 100)::DOUBLE AS order_total FROM (SELECT unnest(generate_series(1, (SELECT max(order_id) FROM core_orders))) AS g)"""


def orders_made(c: Core, n: int) -> DataFrame:
    """``n`` deterministic orders by modular arithmetic; days start at midnight seven hours east."""
    g, slot = F.col("id"), F.col("id") % 100
    status = F.when(slot < 78, "completed").when(slot < 87, "shipped").when(slot < 92, "confirmed").when(slot < 97, "cancelled").otherwise("pending")
    day = F.lit("2023-12-31 17:00:00").cast("timestamp_ntz") + F.make_dt_interval((g % 730).cast("int"), F.lit(0), F.lit(0), g % 86400)
    return c.spark.range(1, n + 1).select(
        F.concat(F.lit("ORD"), F.lpad(g.cast("string"), 10, "0")).alias("order_id"), F.concat(F.lit("CUS"), F.lpad((g % 100000 + 1).cast("string"), 8, "0")).alias("customer_id"),
        day.alias("order_date"), status.alias("status"), ((50000 + g % 4500000) / 100).alias("order_total"),
    )


@query(_SYNTH)
def synthetic_orders(c: Core) -> DataFrame:
    """As many made orders as the greatest order id says."""
    return orders_made(c, c.orders.agg(F.coalesce(F.max("order_id"), F.lit(0))).first()[0])


@query("SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS title, lpad(user_id::VARCHAR, 6, '0') AS padded, md5(event_type) AS digest, regexp_matches(event_type, '^(view|click)$') AS browsing, json_extract_string(props, '$.k') AS k FROM events")
def fn_scalars(c: Core) -> DataFrame:
    return c.raw("events").select("event_id", F.initcap("event_type").alias("title"), F.lpad(F.col("user_id").cast("string"), 6, "0").alias("padded"), F.md5(F.col("event_type").cast("binary")).alias("digest"), F.col("event_type").rlike(r"\A(view|click)\z").alias("browsing"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_type, datediff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days, year(max(ts))::INT AS year, isodow(max(ts))::INT AS dow, count(*) AS n FROM events GROUP BY 1")
def fn_dates(c: Core) -> DataFrame:
    last = F.max("ts")
    return c.raw("events").groupBy("event_type").agg(F.datediff(last.cast("date"), F.min("ts").cast("date")).alias("days"), F.year(last).alias("year"), (F.weekday(last) + 1).alias("dow"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'orders' AS kpi, count(*) FILTER (order_id % 10 <> 0)::DOUBLE AS before, count(*)::DOUBLE AS after, count(*) FILTER (order_id % 10 = 0)::DOUBLE AS diff FROM core_orders")
def recon_kpi_before_after(c: Core) -> DataFrame:
    kpi = lambda df: df.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("orders").alias("kpi"), "v")
    return rel.full_recon(kpi(c.orders), kpi(c.orders.filter("order_id % 10 <> 0")), ["kpi"], "v").select("kpi", F.col("b_value").alias("before"), F.col("a_value").alias("after"), "diff")
