"""The star schema with surrogate keys: dimensions by key ledgers, the item-grain fact, and its refresh as one commit.

A dimension's ledger (natural key, key) is a table of its own that only grows: a member keeps its key whatever happens to
its attributes, and new members are numbered after the greatest key in order of their natural keys. Key 0 is the unknown
member of every dimension that a fact may miss. Facts join the ledgers, not the dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.operators import state
from martline.plans.book import query
from martline.plans.mart import dim_date
from martline.plans.storage import materialize
from martline.plans.views import MONEY, Core
from martline.plans.warehouse import STATUSES
from martline.sources.files import write_report

UNKNOWN = 0
#: Hours that the shop's days are ahead of UTC.
AHEAD = 7
DIMENSIONS = {"dim_customer": "customer_id", "dim_product": "product_id", "dim_payment_method": "payment_method", "dim_order_status": "order_status"}
FACT_COLUMNS = ["order_item_id", "order_id", "date_key", "customer_key", "product_key", "payment_method_key", "order_status_key", "channel", "quantity", "unit_price", "discount", "gross_amount", "revenue", "net_amount"]


def ledger(known: DataFrame | None, members: DataFrame, natural: str) -> DataFrame:
    """(natural, key) after ``members``; without a known ledger numbering starts at 1."""
    if known is None:
        known = members.select(natural, F.lit(0).cast("long").alias("key")).limit(0)
    return state.assign_keys(known, members, natural)


def calendar(c: Core, start: str, end: str) -> DataFrame:
    """dim_date with year_month and day_name."""
    days = dim_date(start, end, c)
    return days.withColumns({"year_month": F.date_format("full_date", "yyyy-MM"), "day_name": F.date_format("full_date", "EEEE")})


def members(c: Core) -> dict[str, DataFrame]:
    """``member`` of every dimension."""
    return {name: member(c, name) for name in DIMENSIONS}


def member(c: Core, name: str) -> DataFrame:
    """What a dimension holds today, by its natural key. Customers carry neither mail nor phone, and no city is Unknown;
    products carry their category and its parent, a root being its own; cost is 70 % of the price, as the tables have none;
    cash is the one method that is not digital."""
    tree = rel.with_parent(c.categories, "category_id", "parent_id", "category_name")
    method, cents = F.col("payment_method"), F.col("unit_price") * F.lit("0.7").cast("decimal(2,1)")
    title = F.initcap(F.translate(method, "_", " "))
    told = {
        "dim_customer": lambda: c.customers.select(
            "customer_id", "full_name", F.coalesce("city", F.lit("Unknown")).alias("city"), F.col("segment").alias("customer_segment"),
            F.when(F.col("balance") < 0, "inactive").otherwise("active").alias("status"),
        ),
        "dim_product": lambda: c.products.join(tree, "category_id").select(
            "product_id", "product_name", "category_id", F.col("category_name").alias("category"), F.col("parent_name").alias("parent_category"),
            F.col("unit_price").alias("list_price"), F.round(cents, 2).cast(MONEY).alias("cost_price"), F.when(F.col("unit_price") < 1000, "discontinued").otherwise("active").alias("status"),
        ),
        "dim_payment_method": lambda: c.methods.select(F.col("method").alias("payment_method")).select(
            "payment_method", title.alias("payment_method_name"), (method != "cash").alias("is_digital")
        ),
        "dim_order_status": lambda: c.spark.createDataFrame(STATUSES, "order_status string, status_name string, status_order int, is_final boolean"),
    }
    return told[name]()


def dimension(rows: DataFrame, keys: DataFrame, natural: str, key: str, unknown: dict[str, object] | None = None) -> DataFrame:
    """``rows`` with their surrogate ``key``; and the unknown member, of key 0, if its attributes are given."""
    out = rows.join(keys.select(natural, F.col("key").alias(key)), natural).select(key, *rows.columns)
    if unknown is None:
        return out
    first = rows.sparkSession.range(1).select(F.lit(UNKNOWN).cast("long").alias(key), *[F.lit(unknown[c]).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return first.unionByName(out)


def order_payments(c: Core) -> DataFrame:
    """(order_id, payment_method) of the latest success of each order."""
    return rel.latest_per_key(c.payments.filter("status = 'success'"), ["order_id"], ["payment_date", "payment_id"], ["method"]).withColumnRenamed("method", "payment_method")


def fact_sales(c: Core, keys: dict[str, DataFrame], items: DataFrame | None = None) -> DataFrame:
    """One row an item, all statuses, with the keys of its day, customer, product, method and status: 0 where a ledger lacks
    the member. The unit price is that of the sale; net_amount is revenue by its other name. ``items``: only these. What a
    ledger has beside its keys, attributes of its members, the fact has too. What an order tells is joined to the orders, so
    the items are shuffled by order and by product alone."""
    local = F.col("order_date") + F.make_dt_interval(F.lit(0), F.lit(AHEAD))
    more = [x for name, natural in DIMENSIONS.items() for x in keys[name].columns if x not in (natural, "key")]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        natural, key = DIMENSIONS[name], f"{name.removeprefix('dim_')}_key"
        return df.join(keys[name].withColumnRenamed("key", key), natural, "left").withColumn(key, F.coalesce(key, F.lit(UNKNOWN).cast("long")))

    orders = keyed(keyed(c.orders, "dim_customer"), "dim_order_status")
    paid = c.paid_items.withColumnRenamed("method", "payment_method") if items is None else items.join(order_payments(c), "order_id", "left")
    f = paid.join(orders, "order_id").withColumn("payment_method", F.coalesce("payment_method", F.lit("unknown")))
    f = keyed(keyed(f, "dim_payment_method"), "dim_product")
    price = (F.col("gross") / F.col("quantity")).cast(MONEY)
    return f.select(
        F.col("item_id").alias("order_item_id"), "order_id", F.date_format(local, "yyyyMMdd").cast("int").alias("date_key"), "customer_key", "product_key",
        "payment_method_key", "order_status_key", "channel", "quantity", price.alias("unit_price"), "discount", F.col("gross").alias("gross_amount"),
        F.col("net").alias("revenue"), F.col("net").alias("net_amount"), *more,
    )


def outside_calendar(fact: DataFrame, days: DataFrame) -> DataFrame:
    """Facts whose day the calendar lacks."""
    return rel.unmatched(fact, days, "date_key")


def star_contract() -> dict[str, list[dq.Check]]:
    """What must hold in the written tables before they are published."""
    at_least_zero = [dq.Check(f"{c} >= 0", F.col(c) < 0) for c in ("unit_price", "discount", "gross_amount", "revenue")]
    return {
        "fact_sales": [
            dq.Check("quantity > 0", F.col("quantity") <= 0), *at_least_zero,
            dq.Check("revenue = gross_amount - discount", F.col("revenue") != F.col("gross_amount") - F.col("discount")),
            *[dq.Check(f"{c} is not null", F.col(c).isNull()) for c in ("order_item_id", "date_key", "customer_key", "product_key", "payment_method_key", "order_status_key")],
        ]
    }


def audit_star(written: dict[str, DataFrame]) -> None:
    """Raises ValueError if the fact breaks its contract, repeats an item, or leaves the calendar; for ``Versions.publish``."""
    fact = written["fact_sales"]
    broken = dq.audit(fact, star_contract()["fact_sales"], unique=[["order_item_id"]]).filter("violations > 0")
    if rows := broken.collect():
        raise ValueError("fact_sales: " + ", ".join(f"{r['check']} ({r['violations']})" for r in rows))
    if not outside_calendar(fact, written["dim_date"]).isEmpty():
        raise ValueError("an order's day is outside the calendar")


def refresh(c: Core, versions: state.Versions, run_id: str, start: str, end: str, full: bool = False) -> int:
    """Publish the star of the core tables as one commit; the sequence number after it.

    Ledgers of keys go on from what was published, so keys are stable. Facts that stand stay as they are, and the items that
    the fact lacks are added; with ``full`` all is built anew, keys from 1. Nothing is published if an item's day lies
    outside ``start`` to ``end``, if the contract is broken, or if neither an item nor a member's attribute is new."""
    since, today = versions.sequence(), members(c)
    old = {name: None if full else versions.read(name) for name in (*DIMENSIONS, *(f"{d}_keys" for d in DIMENSIONS), "dim_date", "fact_sales")}
    tables: dict[str, DataFrame | state.Staged] = {}
    keys = {}
    for name, natural in DIMENSIONS.items():
        tables[f"{name}_keys"] = versions.stage(f"{name}_keys", ledger(old[f"{name}_keys"], today[name], natural))
        keys[name] = tables[f"{name}_keys"].table
        key = f"{name.removeprefix('dim_')}_key"
        unknown = {"payment_method": "unknown", "payment_method_name": "Unknown", "is_digital": False} if name == "dim_payment_method" else None
        rows = dimension(today[name], keys[name], natural, key, unknown)
        tables[name] = versions.stage(name, _overwritten(old[name], rows, key))
    fact = old["fact_sales"]
    if fact is None:
        new = fact_sales(c, keys)
        tables["fact_sales"] = versions.stage("fact_sales", new)
    else:
        items = rel.unmatched(c.items, fact.select(F.col("order_item_id").alias("item_id")), "item_id")
        tables["fact_sales"] = versions.stage("fact_sales", fact.unionByName(fact_sales(c, keys, items)))
    tables["dim_date"] = versions.stage("dim_date", calendar(c, start, end))
    if all(old[name] is not None and _same(old[name], tables[name].table) for name in (*DIMENSIONS, "dim_date", "fact_sales")):
        return since
    return versions.publish(run_id, tables, audit_star, since)


def _overwritten(old: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """Type 1: today's attributes, and members that are no more as they were."""
    return rows if old is None else rows.unionByName(rel.unmatched(old, rows.select(key), key))


def _same(a: DataFrame, b: DataFrame) -> bool:
    return rel.fingerprint(a, a.columns[0]).first() == rel.fingerprint(b, b.columns[0]).first()


def kpis(fact: DataFrame | None, statuses: DataFrame | None) -> DataFrame:
    """(kpi, value) of a published mart: total_revenue, order_count, completed_orders, total_items_sold as exact decimals.
    A fact of before net_amount existed tells its revenue; a mart that was never published tells zeros. Items without
    quantity count as 0."""
    names = ("total_revenue", "order_count", "completed_orders", "total_items_sold")
    kind = "decimal(20,2)"
    if fact is None or statuses is None:
        return SparkSession.active().range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("kpi"), F.lit(0).cast(kind).alias("value")) for n in names])))
    revenue = "net_amount" if "net_amount" in fact.columns else "revenue"
    named = fact.join(statuses.select("order_status_key", "order_status"), "order_status_key")
    done = F.when(F.col("order_status") == "completed", F.col("order_id"))
    values = (F.sum(revenue), F.countDistinct("order_id"), F.countDistinct(done), F.sum("quantity"))
    told = [F.struct(F.lit(n).alias("kpi"), F.coalesce(v.cast(kind), F.lit(0).cast(kind)).alias("value")) for n, v in zip(names, values)]
    return named.agg(F.array(*told).alias("x")).select(F.inline("x"))


def kpi_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kpi, before, after, diff) of two tables of ``kpis``, exact."""
    a, b = before.select("kpi", F.col("value").alias("before")), after.select("kpi", F.col("value").alias("after"))
    return a.join(b, "kpi").select("kpi", "before", "after", (F.col("after") - F.col("before")).cast("decimal(20,2)").alias("diff"))


def refresh_and_compare(c: Core, versions: state.Versions, run_id: str, start: str, end: str, reports: str, full: bool = False) -> DataFrame:
    """``refresh``, and the comparison of the four figures before and after it, written as a report of the run: revenue with
    two places, counts without. A refresh that is refused writes none."""
    look = lambda: kpis(versions.read("fact_sales"), versions.read("dim_order_status"))
    before = c.spark.createDataFrame(look().collect(), "kpi string, value decimal(20,2)")  # four rows
    refresh(c, versions, run_id, start, end, full)
    told = kpi_comparison(before, look())
    whole = F.col("kpi") != "total_revenue"
    text = [F.when(whole, F.col(v).cast("decimal(20,0)").cast("string")).otherwise(F.col(v).cast("string")).alias(v) for v in ("before", "after", "diff")]
    write_report(told.select("kpi", *text), reports, run_id, "overwrite")
    return told


# The star as queries: every ledger is made in two refreshes, even members first, so keys of the second follow the first.

def _keys(c: Core, name: str, natural: str, early) -> DataFrame:
    today = member(c, name).select(natural)
    return materialize(ledger(materialize(ledger(None, today.filter(early), natural), "ledger"), today, natural), "ledger")


def _early(natural: str):
    """Members of the first refresh: those of even numbers, or of an even place among the letters."""
    return F.col(natural) % 2 == 0 if natural.endswith("_id") else F.ascii(natural) % 2 == 0


def _numbered(table: str, natural: str) -> str:
    early = f"{natural} % 2 = 0" if natural.endswith("_id") else f"ascii({natural}) % 2 = 0"
    return f"{table}_keys AS (SELECT {natural}, row_number() OVER (ORDER BY CASE WHEN {early} THEN 0 ELSE 1 END, {natural}) AS key FROM (SELECT DISTINCT {natural} FROM {table}_members))"


_MEMBERS = {
    "dim_customer": "SELECT customer_id, full_name, coalesce(city, 'Unknown') AS city, segment AS customer_segment, CASE WHEN balance < 0 THEN 'inactive' ELSE 'active' END AS status FROM customers",
    "dim_product": (
        "SELECT product_id, product_name, category_id, a.category_name AS category, coalesce(b.category_name, a.category_name) AS parent_category, unit_price AS list_price, "
        "round(unit_price * 0.7::DECIMAL(2,1), 2)::DECIMAL(14,2) AS cost_price, CASE WHEN unit_price < 1000 THEN 'discontinued' ELSE 'active' END AS status "
        "FROM products JOIN categories a USING (category_id) LEFT JOIN categories b ON a.parent_id = b.category_id"
    ),
    "dim_payment_method": "SELECT DISTINCT method AS payment_method, upper(method[1]) || lower(method[2:]) AS payment_method_name, method <> 'cash' AS is_digital FROM payments",
    "dim_order_status": "SELECT * FROM (VALUES ('pending', 'Pending', 1, false), ('confirmed', 'Confirmed', 2, false), ('shipped', 'Shipped', 3, false), ('completed', 'Completed', 4, true), ('cancelled', 'Cancelled', 5, true)) AS v(order_status, status_name, status_order, is_final)",
}
_STAR = ", ".join(f"{t}_members AS ({_MEMBERS[t]}), {_numbered(t, n)}" for t, n in DIMENSIONS.items())


def _dim_sql(table: str) -> str:
    natural = DIMENSIONS[table]
    key = f"{table.removeprefix('dim_')}_key"
    prices = " REPLACE (list_price::DOUBLE AS list_price, cost_price::DOUBLE AS cost_price)" if table == "dim_product" else ""
    unknown = f"SELECT 0::BIGINT AS {key}, 'unknown' AS payment_method, 'Unknown' AS payment_method_name, false AS is_digital UNION ALL " if table == "dim_payment_method" else ""
    return f", {table}_members AS ({_MEMBERS[table]}), {_numbered(table, natural)} {unknown}SELECT key AS {key}, {table}_members.*{prices} FROM {table}_members JOIN {table}_keys USING ({natural})"


@query(_dim_sql("dim_customer"))
def star_dim_customer(c: Core) -> DataFrame:
    return dimension(member(c, "dim_customer"), _keys(c, "dim_customer", "customer_id", _early("customer_id")), "customer_id", "customer_key")


@query(_dim_sql("dim_product"))
def star_dim_product(c: Core) -> DataFrame:
    dim = dimension(member(c, "dim_product"), _keys(c, "dim_product", "product_id", _early("product_id")), "product_id", "product_key")
    return dim.withColumns({p: F.col(p).cast("double") for p in ("list_price", "cost_price")})


@query(_dim_sql("dim_payment_method"))
def star_dim_payment_method(c: Core) -> DataFrame:
    unknown = {"payment_method": "unknown", "payment_method_name": "Unknown", "is_digital": False}
    keys = _keys(c, "dim_payment_method", "payment_method", _early("payment_method"))
    return dimension(member(c, "dim_payment_method"), keys, "payment_method", "payment_method_key", unknown)


@query(_dim_sql("dim_order_status"))
def star_dim_order_status(c: Core) -> DataFrame:
    return dimension(member(c, "dim_order_status"), _keys(c, "dim_order_status", "order_status", _early("order_status")), "order_status", "order_status_key")


@query(
    "SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS full_date, day(d)::INT AS day, month(d)::INT AS month, strftime(d, '%B') AS month_name, quarter(d)::INT AS quarter, year(d)::INT AS year, "
    "isodow(d)::INT AS day_of_week, isodow(d) >= 6 AS is_weekend, strftime(d, '%Y-%m') AS year_month, strftime(d, '%A') AS day_name "
    "FROM (SELECT unnest(generate_series((SELECT min(order_date)::DATE FROM core_orders), (SELECT max(order_date)::DATE FROM core_orders) + 1, INTERVAL 1 DAY))::DATE AS d)"
)
def star_dim_date(c: Core) -> DataFrame:
    """All days from the first order's to the one after the last order's, as the shop's days are ahead of UTC."""
    lo, hi = c.orders.agg(F.min("order_date").cast("date").cast("string"), F.date_add(F.max("order_date").cast("date"), 1).cast("string")).first()
    return calendar(c, lo, hi) if lo else calendar(c, "2025-01-01", "2025-01-01").limit(0)


_PAID = "paid AS (SELECT order_id, method AS payment_method FROM payments WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY payment_date DESC, payment_id DESC) = 1)"
_FACT = (
    "SELECT item_id AS order_item_id, order_id, strftime(order_date + INTERVAL 7 HOUR, '%Y%m%d')::INT AS date_key, coalesce(ck.key, 0) AS customer_key, coalesce(pk.key, 0) AS product_key, "
    "coalesce(mk.key, 0) AS payment_method_key, coalesce(sk.key, 0) AS order_status_key, channel, quantity, ((2 * (gross * 100)::BIGINT + quantity) // (2 * quantity))::DOUBLE / 100 AS unit_price, discount::DOUBLE AS discount, "
    "gross::DOUBLE AS gross_amount, net::DOUBLE AS revenue, net::DOUBLE AS net_amount FROM items JOIN core_orders USING (order_id) LEFT JOIN paid USING (order_id) LEFT JOIN dim_customer_keys ck USING (customer_id) "
    "LEFT JOIN dim_product_keys pk USING (product_id) LEFT JOIN dim_payment_method_keys mk ON mk.payment_method = paid.payment_method LEFT JOIN dim_order_status_keys sk USING (order_status)"
)


@query(f", {_STAR}, {_PAID} {_FACT}")
def star_fact_sales(c: Core) -> DataFrame:
    """The whole fact with surrogate keys; money as double for comparison."""
    keys = {name: _keys(c, name, natural, _early(natural)) for name, natural in DIMENSIONS.items()}
    money = ("unit_price", "discount", "gross_amount", "revenue", "net_amount")
    return fact_sales(c, keys).withColumns({m: F.col(m).cast("double") for m in money})


@query(f", {_STAR}, {_PAID}, f AS ({_FACT}) SELECT customer_segment, category, is_digital, count(*) AS items, sum(quantity)::BIGINT AS units, sum(revenue) AS revenue FROM f "
       "JOIN dim_customer_keys c ON c.key = customer_key JOIN dim_customer_members USING (customer_id) JOIN dim_product_keys p ON p.key = product_key JOIN dim_product_members USING (product_id) "
       "LEFT JOIN (SELECT key, is_digital FROM dim_payment_method_keys JOIN dim_payment_method_members USING (payment_method)) m ON m.key = payment_method_key GROUP BY ALL")  # fmt: skip
def star_kpi_by_dimensions(c: Core) -> DataFrame:
    """Items, units and revenue by attributes of three dimensions; no method is no attribute. The ledgers bring the attributes
    of their members along with the keys, so the fact is not shuffled a second time, by surrogate keys."""
    keys = {name: _keys(c, name, natural, _early(natural)) for name, natural in DIMENSIONS.items()}
    for name, attribute in {"dim_customer": "customer_segment", "dim_product": "category", "dim_payment_method": "is_digital"}.items():
        keys[name] = keys[name].join(member(c, name).select(DIMENSIONS[name], attribute), DIMENSIONS[name])
    f = fact_sales(c, keys).filter((F.col("customer_key") != UNKNOWN) & (F.col("product_key") != UNKNOWN))
    return f.groupBy("customer_segment", "category", "is_digital").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units"), F.sum("revenue").cast("double").alias("revenue"))
