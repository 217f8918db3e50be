"""Customer analytics and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martline.operators import relational as rel
from martline.plans.book import query
from martline.plans.views import Core


def _done(c: Core) -> DataFrame:
    return c.orders.filter("order_status = 'completed'")


_MONTHS = "month_orders AS (SELECT DISTINCT customer_id, date_trunc('month', order_date + INTERVAL 7 HOUR)::DATE AS m FROM core_orders WHERE order_status = 'completed'), cohorts AS (SELECT customer_id, min(m) AS c0 FROM month_orders GROUP BY 1)"


def _months(c: Core) -> tuple[DataFrame, DataFrame]:
    local = F.col("order_date") + F.make_dt_interval(F.lit(0), F.lit(7))
    months = _done(c).select("customer_id", F.trunc(local.cast("date"), "month").alias("m")).distinct()
    return months, months.groupBy("customer_id").agg(F.min("m").alias("c0"))


@query(", s AS (SELECT customer_id, coalesce(sum(order_total), 0) AS spend FROM customers LEFT JOIN (SELECT * FROM core_orders WHERE order_status = 'completed') USING (customer_id) GROUP BY 1) SELECT CASE WHEN spend < 300000 THEN 'Low' WHEN spend < 900000 THEN 'Medium' ELSE 'High' END AS tier, count(*) AS customers, min(spend)::DOUBLE AS least, max(spend)::DOUBLE AS most, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM s), 2) AS share_pct FROM s GROUP BY 1")
def spending_tiers(c: Core) -> DataFrame:
    spend = c.customers.select("customer_id").join(_done(c), "customer_id", "left").groupBy("customer_id").agg(F.coalesce(F.sum("order_total"), F.lit(0)).alias("spend"))
    tier = F.when(F.col("spend") < 300000, "Low").when(F.col("spend") < 900000, "Medium").otherwise("High")
    tiers = spend.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("customers"), F.min("spend").cast("double").alias("least"), F.max("spend").cast("double").alias("most"))
    return rel.share(tiers, "customers")


@query("SELECT min(n) AS least, max(n) AS most, avg(n) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, 100.0::DOUBLE * count(*) FILTER (n = 1) / count(*) AS one_time_pct FROM (SELECT customer_id, count(*) AS n FROM core_orders WHERE order_status = 'completed' GROUP BY 1)")
def order_frequency_stats(c: Core) -> DataFrame:
    n = _done(c).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), (100.0 * F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("one_time_pct"))


@query("SELECT customer_id, sum(order_total)::DOUBLE / count(*) AS aov FROM core_orders WHERE order_status = 'completed' GROUP BY 1")
def customer_aov(c: Core) -> DataFrame:
    return _done(c).groupBy("customer_id").agg((F.sum("order_total").cast("double") / F.count(F.lit(1))).alias("aov"))


@query(f", {_MONTHS}, back AS (SELECT c0, count(*) AS size, count(*) FILTER (customer_id IN (SELECT customer_id FROM month_orders JOIN cohorts k USING (customer_id) WHERE m > k.c0)) AS returned FROM cohorts GROUP BY 1) SELECT strftime(c0, '%Y-%m') AS cohort_month, size, returned, 100.0::DOUBLE * returned / size AS returned_pct FROM back")
def retention_simple(c: Core) -> DataFrame:
    months, cohorts = _months(c)
    again = months.join(cohorts, "customer_id").filter("m > c0").select("customer_id", F.lit(1).alias("again")).distinct()
    out = cohorts.join(again, "customer_id", "left").groupBy("c0").agg(F.count(F.lit(1)).alias("size"), F.count("again").alias("returned"))
    return out.select(F.date_format("c0", "yyyy-MM").alias("cohort_month"), "size", "returned", (100.0 * F.col("returned") / F.col("size")).alias("returned_pct"))


@query(
    f", {_MONTHS}, size AS (SELECT c0, count(*) AS n FROM cohorts GROUP BY 1), last AS (SELECT max(m) AS hi FROM month_orders), grid AS (SELECT c0, n, k FROM size, range(6) AS r(k), last WHERE c0 + to_months(k::INT) <= hi), act AS (SELECT c0, datediff('month', c0, m) AS k, count(*) AS a FROM month_orders JOIN cohorts USING (customer_id) GROUP BY 1, 2), cell AS (SELECT c0, n, k, 100.0::DOUBLE * coalesce(a, 0) / n AS p FROM grid LEFT JOIN act USING (c0, k)) SELECT strftime(c0, '%Y-%m') AS cohort_month, max(n) AS cohort_size, "
    + ", ".join(f"max(p) FILTER (k = {k}) AS m{k}" for k in range(6))
    + " FROM cell GROUP BY c0"
)
def cohort_matrix(c: Core) -> DataFrame:
    """Percent of a cohort active k months on: null where that month is not observed yet, 0 where nobody came."""
    months, cohorts = _months(c)
    size = cohorts.groupBy("c0").agg(F.count(F.lit(1)).alias("n"))
    last = months.agg(F.max("m").alias("hi"))
    grid = size.crossJoin(F.broadcast(last)).select("c0", "n", F.explode(F.sequence(F.lit(0), F.least(F.lit(5), F.months_between("hi", "c0").cast("int")))).alias("k"))
    active = months.join(cohorts, "customer_id").groupBy("c0", F.months_between("m", "c0").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    cells = grid.join(active, ["c0", "k"], "left").withColumn("p", 100.0 * F.coalesce("a", F.lit(0)) / F.col("n"))
    wide = cells.groupBy("c0", F.col("n").alias("cohort_size")).pivot("k", list(range(6))).agg(F.max("p"))
    return wide.select(F.date_format("c0", "yyyy-MM").alias("cohort_month"), "cohort_size", *[F.col(str(k)).alias(f"m{k}") for k in range(6)])


def _rfm(c: Core) -> DataFrame:
    as_of = c.orders.agg(F.max("order_date").alias("as_of"))
    got = _done(c).groupBy("customer_id").agg(F.max("order_date").alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum("order_total").alias("monetary"))
    return got.crossJoin(F.broadcast(as_of)).select("customer_id", F.greatest(F.datediff("as_of", "last"), F.lit(0)).alias("recency_days"), "frequency", "monetary")


_RFM = "rfm AS (SELECT customer_id, greatest(datediff('day', max(order_date), (SELECT max(order_date) FROM core_orders)), 0)::INT AS recency_days, count(*) AS frequency, sum(order_total) AS monetary FROM core_orders WHERE order_status = 'completed' GROUP BY 1)"


@query(f", {_RFM} SELECT customer_id, recency_days, frequency, monetary::DOUBLE AS monetary FROM rfm")
def rfm(c: Core) -> DataFrame:
    return _rfm(c).withColumn("monetary", F.col("monetary").cast("double"))


#: The segments in the order in which they are tried.
_SEGMENTS = """CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 THEN 'Loyal' WHEN r >= 4 AND f <= 2 THEN 'New / Promising'
    WHEN r <= 2 AND f >= 3 THEN 'At Risk' WHEN r <= 2 AND f <= 2 THEN 'Hibernating' ELSE 'Need Attention' END"""


@query(
    f", {_RFM}, s AS (SELECT *, ceil(5 * cume_dist() OVER (ORDER BY recency_days DESC))::INT AS r, ceil(5 * cume_dist() OVER (ORDER BY frequency))::INT AS f, "
    f"ceil(5 * cume_dist() OVER (ORDER BY monetary))::INT AS m FROM rfm) SELECT customer_id, r || '' || f || '' || m AS code, {_SEGMENTS} AS segment, "
    "monetary::DOUBLE / nullif(frequency, 0) AS aov, monetary::DOUBLE AS ltv FROM s"
)
def rfm_segments(c: Core) -> DataFrame:
    s = rel.quintile(_rfm(c), "recency_days", ascending=False, name="r")
    s = rel.quintile(rel.quintile(s, "frequency", name="f"), "monetary", name="m")
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    segment = F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions").when((r >= 3) & (f >= 3), "Loyal").when((r >= 4) & (f <= 2), "New / Promising")
    segment = segment.when((r <= 2) & (f >= 3), "At Risk").when((r <= 2) & (f <= 2), "Hibernating").otherwise("Need Attention")
    spent = F.col("monetary").cast("double")
    return s.select("customer_id", F.concat("r", "f", "m").alias("code"), segment.alias("segment"), (spent / F.nullif("frequency", F.lit(0))).alias("aov"), spent.alias("ltv"))


@query("SELECT customer_id, datediff('day', max(order_date), (SELECT max(order_date) FROM core_orders))::INT AS days_since, sum(order_total)::DOUBLE AS lifetime FROM core_orders GROUP BY 1 HAVING max(order_date) < (SELECT max(order_date) FROM core_orders) - INTERVAL 30 DAY")
def churn_30d(c: Core) -> DataFrame:
    last = c.orders.agg(F.max("order_date").alias("as_of"))
    got = c.orders.groupBy("customer_id").agg(F.max("order_date").alias("last"), F.sum("order_total").cast("double").alias("lifetime")).crossJoin(F.broadcast(last))
    return got.filter(F.col("last") < F.col("as_of") - F.expr("interval 30 days")).select("customer_id", F.datediff("as_of", "last").alias("days_since"), "lifetime")


@query(", m AS (SELECT strftime(order_date + INTERVAL 7 HOUR, '%Y-%m') AS month, sum(order_total) AS total FROM core_orders WHERE order_status = 'completed' GROUP BY 1) SELECT month, (sum(total) OVER (ORDER BY month))::DOUBLE AS cumulative, 100.0::DOUBLE * (sum(total) OVER (ORDER BY month))::DOUBLE / (sum(total) OVER ())::DOUBLE AS pct FROM m")
def cumulative_revenue(c: Core) -> DataFrame:
    m = _done(c).groupBy(rel.local_month(F.col("order_date")).alias("month")).agg(F.sum("order_total").alias("total"))
    up = F.sum("total").over(Window.orderBy("month")).cast("double")
    total = F.sum("total").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    return m.select("month", up.alias("cumulative"), (100.0 * up / total).alias("pct"))


_CAT = "cat AS (SELECT category_id, sum(net) AS revenue FROM items JOIN products USING (product_id) GROUP BY 1)"


@query(f", {_CAT} SELECT category_id, revenue::DOUBLE AS revenue, (rank() OVER (ORDER BY revenue DESC))::INT AS rank_no, 100.0::DOUBLE * (sum(revenue) OVER (ORDER BY revenue DESC))::DOUBLE / (sum(revenue) OVER ())::DOUBLE AS cumulative_pct FROM cat")
def category_pareto(c: Core) -> DataFrame:
    cat = c.items.join(c.products, "product_id").groupBy("category_id").agg(F.sum("net").alias("revenue"))
    w = Window.orderBy(F.desc("revenue"))
    up, total = F.sum("revenue").over(w).cast("double"), F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    return cat.select("category_id", F.col("revenue").cast("double").alias("revenue"), F.rank().over(w).alias("rank_no"), (100.0 * up / total).alias("cumulative_pct"))


@query(", m AS (SELECT strftime(order_date, '%Y-%m') AS month, sum(order_total)::DOUBLE AS total FROM core_orders GROUP BY 1) SELECT month, total, 100.0::DOUBLE * (total - lag(total) OVER (ORDER BY month)) / nullif(lag(total) OVER (ORDER BY month), 0) AS growth_pct FROM m")
def mom_growth(c: Core) -> DataFrame:
    m = c.orders.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.sum("order_total").cast("double").alias("total"))
    before = F.lag("total").over(Window.orderBy("month"))
    return m.select("month", "total", (100.0 * (F.col("total") - before) / F.nullif(before, F.lit(0.0))).alias("growth_pct"))


@query(", d AS (SELECT order_date::DATE AS day, sum(order_total) AS total FROM core_orders GROUP BY 1), days AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day), f AS (SELECT day, coalesce(total, 0)::DOUBLE AS total FROM days LEFT JOIN d USING (day)) SELECT day, total, CASE WHEN count(*) OVER w7 = 7 THEN avg(total) OVER w7 END AS avg7 FROM f WINDOW w7 AS (ORDER BY day ROWS 6 PRECEDING)")
def moving_average(c: Core) -> DataFrame:
    daily = c.orders.groupBy(F.col("order_date").cast("date").alias("day")).agg(F.sum("order_total").alias("total"))
    full = rel.fill_days(daily, "day", "total").withColumn("total", F.col("total").cast("double"))
    return rel.moving_average(full, "day", "total", 7, "avg7")


@query("SELECT 'segments' AS result_table, segment AS dimension_key, count(*)::DOUBLE AS metric FROM customers GROUP BY 2 UNION ALL SELECT 'status', order_status, sum(order_total)::DOUBLE FROM core_orders GROUP BY 2")
def result_union_long(c: Core) -> DataFrame:
    return rel.long_results({"segments": c.customers.groupBy(F.col("segment").alias("dimension_key")).agg(F.count(F.lit(1)).alias("metric")), "status": c.orders.groupBy(F.col("order_status").alias("dimension_key")).agg(F.sum("order_total").alias("metric"))})


@query("SELECT strftime(first, '%Y-%m') AS month, count(*) AS new_customers FROM (SELECT customer_id, min(order_date) AS first FROM core_orders WHERE order_status = 'completed' GROUP BY 1) GROUP BY 1")
def new_customers(c: Core) -> DataFrame:
    first = _done(c).groupBy("customer_id").agg(F.min("order_date").alias("first"))
    return first.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("new_customers"))


@query("SELECT strftime(order_date, '%Y-%m') AS month, count(DISTINCT customer_id) AS active_customers FROM core_orders WHERE order_status = 'completed' GROUP BY 1")
def active_customers(c: Core) -> DataFrame:
    return _done(c).groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.countDistinct("customer_id").alias("active_customers"))
