"""The ten business questions, the summary tables of the mart, and the customer tables in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.operators import relational as rel
from martline.plans.analytics import _MONTHS, _done, _months
from martline.plans.book import query
from martline.plans.mart import FACT, build_fact
from martline.plans.views import Core

#: Parameters of the queries: spending below the first is Low, up to the second Medium, beyond it High.
LOW, MEDIUM = 300_000, 900_000


def _double(*columns: str) -> dict:
    return {c: F.col(c).cast("double") for c in columns}


@query("SELECT coalesce(city, 'Unknown') AS city, count(*) AS customers FROM customers WHERE balance >= 0 GROUP BY 1")
def bq01_active_customers_by_city(c: Core) -> DataFrame:
    """A customer is active unless the balance is below 0."""
    return c.customers.filter("balance >= 0").groupBy(F.coalesce("city", F.lit("Unknown")).alias("city")).agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT product_id, product_name, unit_price::DOUBLE AS unit_price FROM products ORDER BY products.unit_price DESC, product_id LIMIT 10")
def bq02_dearest_products(c: Core) -> DataFrame:
    return rel.topk(c.products, [F.desc("unit_price"), F.asc("product_id")], 10).select("product_id", "product_name", F.col("unit_price").cast("double").alias("unit_price"))


@query("SELECT order_date::DATE AS day, order_status, count(*) AS orders FROM core_orders GROUP BY 1, 2")
def bq03_orders_by_day_and_status(c: Core) -> DataFrame:
    return c.orders.groupBy(F.col("order_date").cast("date").alias("day"), "order_status").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT strftime(order_date + INTERVAL 7 HOUR, '%Y-%m') AS month, count(*) AS orders, sum(order_total)::DOUBLE AS revenue, sum(order_total)::DOUBLE / count(*) AS aov FROM core_orders WHERE order_status = 'completed' GROUP BY 1")
def bq04_revenue_and_aov_by_month(c: Core) -> DataFrame:
    g = _done(c).groupBy(rel.local_month(F.col("order_date")).alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.sum("order_total").cast("double").alias("revenue"))
    return g.withColumn("aov", F.col("revenue") / F.col("orders"))


@query("SELECT category_id, category_name, count(DISTINCT order_id) AS orders, sum(net)::DOUBLE AS revenue FROM items JOIN products USING (product_id) JOIN categories USING (category_id) GROUP BY ALL")
def bq05_revenue_by_category(c: Core) -> DataFrame:
    named = c.products.select("product_id", "category_id").join(c.categories.select("category_id", "category_name"), "category_id")
    return c.items.join(named, "product_id").groupBy("category_id", "category_name").agg(F.countDistinct("order_id").alias("orders"), F.sum("net").cast("double").alias("revenue"))


@query("SELECT customer_id, full_name, revenue::DOUBLE AS revenue FROM (SELECT customer_id, sum(order_total) AS revenue FROM core_orders WHERE order_status = 'completed' GROUP BY 1) t JOIN customers USING (customer_id) ORDER BY t.revenue DESC, customer_id LIMIT 10")
def bq06_top_customers(c: Core) -> DataFrame:
    """The ten are found before their names are."""
    spent = _done(c).join(c.customers.select("customer_id"), "customer_id", "left_semi").groupBy("customer_id").agg(F.sum("order_total").alias("revenue"))
    best = rel.topk(spent, [F.desc("revenue"), F.asc("customer_id")], 10)
    return best.join(c.customers.select("customer_id", "full_name"), "customer_id").withColumns(_double("revenue"))


@query("SELECT product_id, sum(quantity)::BIGINT AS units FROM items GROUP BY 1 ORDER BY units DESC, product_id LIMIT 10")
def bq07_top_products_by_quantity(c: Core) -> DataFrame:
    return rel.topk(c.items.groupBy("product_id").agg(F.sum("quantity").alias("units")), [F.desc("units"), F.asc("product_id")], 10)


@query("SELECT method, count(*) AS payments, count(*) FILTER (status = 'success') AS successes, 100.0::DOUBLE * count(*) FILTER (status = 'success') / count(*) AS success_pct FROM payments GROUP BY 1")
def bq08_payment_success_rate(c: Core) -> DataFrame:
    g = c.payments.groupBy("method").agg(F.count(F.lit(1)).alias("payments"), F.count_if(F.col("status") == "success").alias("successes"))
    return g.withColumn("success_pct", 100.0 * F.col("successes") / F.col("payments"))


@query("SELECT channel, count(*) AS orders, sum(order_total)::DOUBLE AS revenue FROM core_orders WHERE order_status = 'completed' GROUP BY 1")
def bq09_revenue_by_channel(c: Core) -> DataFrame:
    return _done(c).groupBy("channel").agg(F.count(F.lit(1)).alias("orders"), F.sum("order_total").cast("double").alias("revenue"))


@query("SELECT order_id, order_total::DOUBLE AS order_total, coalesce(net, 0)::DOUBLE AS items_net, (order_total - coalesce(net, 0))::DOUBLE AS diff FROM core_orders LEFT JOIN (SELECT order_id, sum(net) AS net FROM items GROUP BY 1) USING (order_id) WHERE order_total <> coalesce(net, 0)")
def bq10_orders_that_differ_from_their_items(c: Core) -> DataFrame:
    """Orders whose total is not the sum of their items; no items count as 0."""
    net = c.items.groupBy("order_id").agg(F.sum("net").alias("net"))
    both = c.orders.join(net, "order_id", "left").withColumn("items_net", F.coalesce("net", F.lit(0)))
    told = both.filter("order_total <> items_net").withColumn("diff", F.col("order_total") - F.col("items_net"))
    return told.select("order_id", "order_total", "items_net", "diff").withColumns(_double("order_total", "items_net", "diff"))


_SUM = "count(DISTINCT order_id) AS orders, sum(quantity)::BIGINT AS units, sum(gross)::DOUBLE AS gross, sum(discount)::DOUBLE AS discount, sum(revenue)::DOUBLE AS revenue, sum(revenue)::DOUBLE / count(DISTINCT order_id) AS aov"


def _summed(fact: DataFrame, *by) -> DataFrame:
    sums = [F.sum(k).cast("double").alias(k) for k in ("gross", "discount", "revenue")]
    out = fact.groupBy(*by).agg(F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("units"), *sums)
    return out.withColumn("aov", F.col("revenue") / F.col("orders"))


@query(f", {FACT} SELECT (date_key // 100)::INT AS month_key, {_SUM} FROM fact WHERE order_status = 'completed' GROUP BY 1")
def monthly_summary(c: Core) -> DataFrame:
    """Completed sales of each month of the mart."""
    return _summed(build_fact(c).filter("order_status = 'completed'"), F.floor(F.col("date_key") / 100).cast("int").alias("month_key"))


@query(f", {FACT} SELECT a.category_name AS category, coalesce(b.category_name, a.category_name) AS parent_category, count(DISTINCT product_id) AS products, {_SUM} FROM fact JOIN products USING (product_id) JOIN categories a USING (category_id) LEFT JOIN categories b ON a.parent_id = b.category_id WHERE order_status = 'completed' GROUP BY 1, 2")
def category_summary(c: Core) -> DataFrame:
    """Completed sales of each category, under its parent."""
    tree = rel.with_parent(c.categories, "category_id", "parent_id", "category_name").select("category_id", F.col("category_name").alias("category"), F.col("parent_name").alias("parent_category"))
    named = c.products.select("product_id", "category_id").join(tree, "category_id")
    sold = build_fact(c).filter("order_status = 'completed'").join(named, "product_id")
    by = ["category", "parent_category"]
    return _summed(sold, *by).join(sold.groupBy(*by).agg(F.countDistinct("product_id").alias("products")), by)


def tiers(customers: DataFrame, orders: DataFrame, low: float, medium: float) -> DataFrame:
    """(tier, customers, share_pct, least, most, mean) of all customers by what they spent on completed orders: Low below
    ``low``, Medium up to ``medium``. Who has no such order spent 0."""
    done = orders.filter("order_status = 'completed'").groupBy("customer_id").agg(F.sum("order_total").alias("spend"))
    spend = customers.select("customer_id").join(done, "customer_id", "left").withColumn("spend", F.coalesce("spend", F.lit(0)))
    tier = F.when(F.col("spend") < low, "Low").when(F.col("spend") <= medium, "Medium").otherwise("High").alias("tier")
    mean = F.round(F.sum("spend").cast("double") / F.count(F.lit(1)), 2)
    out = spend.groupBy(tier).agg(F.count(F.lit(1)).alias("customers"), F.min("spend").cast("double").alias("least"), F.max("spend").cast("double").alias("most"), mean.alias("mean"))
    return rel.share(out, "customers")


@query(
    ", s AS (SELECT customer_id, coalesce(sum(order_total), 0) AS spend FROM customers LEFT JOIN (SELECT * FROM core_orders WHERE order_status = 'completed') USING (customer_id) GROUP BY 1) "
    f"SELECT CASE WHEN spend < {LOW} THEN 'Low' WHEN spend <= {MEDIUM} THEN 'Medium' ELSE 'High' END AS tier, count(*) AS customers, min(spend)::DOUBLE AS least, max(spend)::DOUBLE AS most, "
    "round(sum(spend)::DOUBLE / count(*), 2) AS mean, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM s), 2) AS share_pct FROM s GROUP BY 1"
)
def spending_tiers_with_mean(c: Core) -> DataFrame:
    return tiers(c.customers, c.orders, LOW, MEDIUM)


@query(
    f", {_MONTHS}, last AS (SELECT max(m) AS hi FROM month_orders), back AS (SELECT DISTINCT customer_id FROM month_orders JOIN cohorts USING (customer_id) WHERE m > c0) "
    "SELECT strftime(c0, '%Y-%m') AS cohort_month, count(*) AS size, count(back.customer_id) AS returned, round(100.0::DOUBLE * count(back.customer_id) / count(*), 2) AS returned_pct, "
    "datediff('month', c0, (SELECT hi FROM last))::INT AS months_observed FROM cohorts LEFT JOIN back USING (customer_id) GROUP BY c0"
)
def retention_observed(c: Core) -> DataFrame:
    """Cohorts by first month: how many came back in any later one, and over how many months that was watched."""
    months, cohorts = _months(c)
    spans = months.groupBy("customer_id").agg(F.min("m").alias("c0"), (F.max("m") > F.min("m")).cast("long").alias("again"))
    g = spans.groupBy("c0").agg(F.count(F.lit(1)).alias("size"), F.sum("again").alias("returned"))
    g = g.crossJoin(F.broadcast(months.agg(F.max("m").alias("_hi"))))
    pct = F.round(100.0 * F.col("returned") / F.col("size"), 2)
    return g.select(F.date_format("c0", "yyyy-MM").alias("cohort_month"), "size", "returned", pct.alias("returned_pct"), F.months_between("_hi", "c0").cast("int").alias("months_observed"))


def long_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Result tables of (dimension_key, dimension_name, metric_count, total_revenue) under one another, with their names and
    numbers in the order given."""
    parts = [
        df.select(F.lit(name).alias("result_table"), F.lit(n).alias("table_no"), F.col("dimension_key").cast("string").alias("dimension_key"), F.col("dimension_name").cast("string").alias("dimension_name"), F.col("metric_count").cast("long").alias("metric_count"), F.col("total_revenue").cast("double").alias("total_revenue"))
        for n, (name, df) in enumerate(tables.items(), 1)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    f", {FACT}, done AS (SELECT * FROM fact WHERE order_status = 'completed'), months AS (SELECT strftime(strptime(date_key::VARCHAR, '%Y%m%d'), '%Y-%m') AS k, order_id, revenue FROM done) "
    "SELECT 'monthly_revenue' AS result_table, 1 AS table_no, k AS dimension_key, k AS dimension_name, count(DISTINCT order_id) AS metric_count, sum(revenue)::DOUBLE AS total_revenue FROM months GROUP BY k "
    "UNION ALL SELECT 'category_revenue', 2, category_id, category_name, count(DISTINCT order_id), sum(revenue)::DOUBLE FROM done JOIN products USING (product_id) JOIN categories USING (category_id) GROUP BY category_id, category_name "
    "UNION ALL SELECT 'segment_revenue', 3, segment, segment, count(DISTINCT order_id), sum(revenue)::DOUBLE FROM done JOIN customers USING (customer_id) GROUP BY segment"
)
def result_tables_long(c: Core) -> DataFrame:
    """Monthly, category and segment revenue of completed sales in one long table."""
    done = build_fact(c).filter("order_status = 'completed'")
    told = [F.countDistinct("order_id").alias("metric_count"), F.sum("revenue").alias("total_revenue")]
    month = F.date_format(F.to_date(F.col("date_key").cast("string"), "yyyyMMdd"), "yyyy-MM")
    by_category = c.products.select("product_id", "category_id").join(c.categories.select("category_id", "category_name"), "category_id")
    return long_tables({
        "monthly_revenue": done.groupBy(month.alias("dimension_key"), month.alias("dimension_name")).agg(*told),
        "category_revenue": done.join(by_category, "product_id").groupBy(F.col("category_id").alias("dimension_key"), F.col("category_name").alias("dimension_name")).agg(*told),
        "segment_revenue": done.join(c.customers.select("customer_id", "segment"), "customer_id").groupBy(F.col("segment").alias("dimension_key"), F.col("segment").alias("dimension_name")).agg(*told),
    })
