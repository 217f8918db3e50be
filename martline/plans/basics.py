"""Filters, joins, aggregates, windows and sets over the core tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martline.operators import relational as rel
from martline.plans.book import query
from martline.plans.views import Core

dbl = lambda c: F.col(c).cast("double")


@query("SELECT product_id, unit_price::DOUBLE AS unit_price FROM products WHERE unit_price > 1500")
def filter_threshold(c: Core) -> DataFrame:
    return c.products.filter("unit_price > 1500").select("product_id", dbl("unit_price").alias("unit_price"))


@query("SELECT order_id FROM core_orders WHERE order_status = 'completed' AND order_date >= TIMESTAMP '1996-01-31 17:00:00' AND order_date < TIMESTAMP '1996-02-29 17:00:00'")
def filter_period(c: Core) -> DataFrame:
    """February 1996 in UTC+7; the bounds are converted, so the filter reaches the scan."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-31 17:00:00", "1996-02-29 17:00:00"))
    return c.orders.filter((F.col("order_status") == "completed") & (F.col("order_date") >= lo) & (F.col("order_date") < hi)).select("order_id")


@query("SELECT order_status, count(*) AS n FROM core_orders WHERE order_status <> 'pending' GROUP BY 1")
def filter_status(c: Core) -> DataFrame:
    return c.orders.filter("order_status <> 'pending'").groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT customer_id, full_name FROM customers WHERE customer_id = 42")
def point_lookup(c: Core) -> DataFrame:
    return c.customers.filter("customer_id = 42").select("customer_id", "full_name")


@query("SELECT product_id FROM products WHERE product_name LIKE 'p%' OR product_name LIKE 'P%'")
def prefix_match(c: Core) -> DataFrame:
    return c.products.filter(F.col("product_name").startswith("p") | F.col("product_name").startswith("P")).select("product_id")


@query("SELECT item_id, gross::DOUBLE AS gross, net::DOUBLE AS net, (net / quantity)::DOUBLE AS net_each FROM items WHERE quantity > 0")
def project_derived(c: Core) -> DataFrame:
    return c.items.filter("quantity > 0").select("item_id", dbl("gross").alias("gross"), dbl("net").alias("net"), (dbl("net") / F.col("quantity")).alias("net_each"))


@query("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN unit_price < 1000 THEN 'Low' WHEN unit_price < 1500 THEN 'Medium' ELSE 'High' END AS tier FROM products) GROUP BY 1")
def case_bucket(c: Core) -> DataFrame:
    tier = F.when(F.col("unit_price") < 1000, "Low").when(F.col("unit_price") < 1500, "Medium").otherwise("High")
    return c.products.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT segment, city FROM customers")
def project_distinct(c: Core) -> DataFrame:
    return c.customers.select("segment", "city").distinct()


@query("SELECT item_id, order_status, net::DOUBLE AS net FROM items JOIN core_orders USING (order_id)")
def join_inner(c: Core) -> DataFrame:
    return c.items.join(c.orders, "order_id").select("item_id", "order_status", dbl("net").alias("net"))


@query("SELECT category_name, sum(net)::DOUBLE AS revenue FROM items JOIN core_orders USING (order_id) JOIN products USING (product_id) JOIN categories USING (category_id) WHERE order_status = 'completed' GROUP BY 1")
def join_star4(c: Core) -> DataFrame:
    joined = c.sold.join(c.orders.filter("order_status = 'completed'"), "order_id").join(c.products, "product_id").join(c.categories, "category_id")
    return joined.groupBy("category_name").agg(F.sum("net").cast("double").alias("revenue"))


@query("SELECT o.order_id, coalesce(sum(net), 0)::DOUBLE AS net FROM core_orders o LEFT JOIN items USING (order_id) GROUP BY 1")
def join_left_null(c: Core) -> DataFrame:
    return c.orders.select("order_id").join(c.items, "order_id", "left").groupBy("order_id").agg(F.coalesce(F.sum("net"), F.lit(0)).cast("double").alias("net"))


@query("SELECT customer_id FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM core_orders WHERE order_date < TIMESTAMP '1996-01-01')")
def join_anti(c: Core) -> DataFrame:
    early = c.orders.filter(F.col("order_date") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return rel.unmatched(c.customers, early, "customer_id").select("customer_id")


@query("SELECT customer_id FROM customers WHERE customer_id IN (SELECT customer_id FROM core_orders WHERE order_date < TIMESTAMP '1996-01-01')")
def join_semi(c: Core) -> DataFrame:
    early = c.orders.filter(F.col("order_date") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return rel.matched(c.customers, early, "customer_id").select("customer_id")


@query("SELECT order_id, 'no_items' AS side FROM core_orders WHERE order_id NOT IN (SELECT order_id FROM items) UNION ALL SELECT DISTINCT order_id, 'no_order' FROM items WHERE order_id NOT IN (SELECT order_id FROM core_orders)")
def join_mismatch_both_ways(c: Core) -> DataFrame:
    return rel.mismatches(c.orders, c.item_orders, ["order_id"], ("no_items", "no_order"))


@query(", a AS (SELECT channel, count(*) AS v FROM core_orders WHERE order_status = 'completed' GROUP BY 1), b AS (SELECT channel, count(*) AS v FROM core_orders WHERE order_status <> 'completed' GROUP BY 1) SELECT coalesce(a.channel, b.channel) AS channel, coalesce(a.v, 0) AS a_value, coalesce(b.v, 0) AS b_value, coalesce(a.v, 0) - coalesce(b.v, 0) AS diff FROM a FULL JOIN b ON a.channel IS NOT DISTINCT FROM b.channel")
def join_full_recon(c: Core) -> DataFrame:
    n = lambda p: c.orders.filter(p).groupBy("channel").agg(F.count(F.lit(1)).alias("v"))
    return rel.full_recon(n("order_status = 'completed'"), n("order_status <> 'completed'"), ["channel"], "v")


@query("SELECT segment, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM customers), 2) AS share_pct FROM customers GROUP BY 1")
def join_cross_scalar(c: Core) -> DataFrame:
    return rel.share(c.customers.groupBy("segment").agg(F.count(F.lit(1)).alias("n")), "n")


@query("SELECT item_id, unnest(range(1, quantity + 1))::INT AS unit_no FROM items WHERE item_id % 10 = 1")
def join_lateral_series(c: Core) -> DataFrame:
    return units(c.items.filter("item_id % 10 = 1"))


@query(None)
def join_lateral_series_all(c: Core) -> DataFrame:
    """All items; without SQL, as that of ``join_lateral_series`` holds line 1 of each order alone."""
    return units(c.items)


def units(items: DataFrame) -> DataFrame:
    """(item_id, unit_no) for each unit of each item; items of no unit have no rows."""
    return items.filter("quantity >= 1").select("item_id", F.explode(F.sequence(F.lit(1), F.col("quantity"))).alias("unit_no"))


@query("SELECT a.category_id, coalesce(b.category_name, a.category_name) AS parent_name FROM categories a LEFT JOIN categories b ON a.parent_id = b.category_id")
def join_self_hierarchy(c: Core) -> DataFrame:
    return rel.with_parent(c.categories, "category_id", "parent_id", "category_name").select("category_id", "parent_name")


@query("SELECT customer_id, count(order_id) AS n FROM customers LEFT JOIN (SELECT * FROM core_orders WHERE order_status = 'completed') USING (customer_id) GROUP BY 1")
def join_on_extra_predicate(c: Core) -> DataFrame:
    return c.customers.join(c.orders.filter("order_status = 'completed'"), "customer_id", "left").groupBy("customer_id").agg(F.count("order_id").alias("n"))


@query("SELECT a.customer_id, count(*) AS pairs FROM core_orders a JOIN core_orders b ON a.customer_id = b.customer_id AND b.order_date > a.order_date GROUP BY 1")
def join_theta_after_equi(c: Core) -> DataFrame:
    """Each date's orders times the customer's later ones, summed; no pair is listed. A customer's dates of one month stand in
    a window of their own, and the months' sums in another."""
    return later_pairs(c.orders, "customer_id", "order_date")


def later_pairs(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, pairs): how many pairs of rows of the key have a later and an earlier ``at``; keys without a pair are left out."""
    by = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.date_trunc("month", at).alias("_month"), at).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(key, "_month").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    within = by.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    months = within.groupBy(key, "_month").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_before")).alias("_pairs"))
    past = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_pairs", F.col("_pairs") + F.col("_n") * F.coalesce(F.sum("_n").over(past), F.lit(0)))
    return months.groupBy(key).agg(F.sum("_pairs").alias("pairs")).filter("pairs > 0")


@query("SELECT customer_id, EXISTS (SELECT 1 FROM core_orders o WHERE o.customer_id = c.customer_id AND order_status = 'pending') AS has_pending FROM customers c")
def join_correlated_exists_case(c: Core) -> DataFrame:
    keys = c.orders.filter("order_status = 'pending'").select("customer_id", F.lit(True).alias("_p")).distinct()
    return c.customers.join(keys, "customer_id", "left").select("customer_id", F.col("_p").isNotNull().alias("has_pending"))


@query("SELECT count(*) AS n, coalesce(sum(order_total), 0)::DOUBLE AS total FROM core_orders WHERE order_date < TIMESTAMP '1900-01-01'")
def agg_global(c: Core) -> DataFrame:
    old = c.orders.filter(F.col("order_date") < F.lit("1900-01-01").cast("timestamp_ntz"))
    return old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("order_total"), F.lit(0)).cast("double").alias("total"))


@query("SELECT order_status, channel, count(*) AS n, sum(order_total)::DOUBLE AS total FROM core_orders GROUP BY 1, 2")
def agg_group(c: Core) -> DataFrame:
    return c.orders.groupBy("order_status", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("order_total").cast("double").alias("total"))


@query("SELECT strftime(order_date + INTERVAL 7 HOUR, '%Y-%m') AS month, sum(order_total)::DOUBLE AS total FROM core_orders GROUP BY 1")
def agg_group_month(c: Core) -> DataFrame:
    return c.orders.groupBy(rel.local_month(F.col("order_date")).alias("month")).agg(F.sum("order_total").cast("double").alias("total"))


@query("SELECT order_status, count(DISTINCT customer_id) AS customers FROM core_orders GROUP BY 1")
def agg_count_distinct(c: Core) -> DataFrame:
    return c.orders.groupBy("order_status").agg(F.countDistinct("customer_id").alias("customers"))


@query("SELECT channel, count(DISTINCT customer_id) AS customers, count(DISTINCT order_date) AS days FROM core_orders GROUP BY 1")
def agg_multi_distinct(c: Core) -> DataFrame:
    return c.orders.groupBy("channel").agg(F.countDistinct("customer_id").alias("customers"), F.countDistinct("order_date").alias("days"))


@query("SELECT customer_id, count(*) AS n FROM core_orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(c: Core) -> DataFrame:
    return c.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("SELECT order_status, sum(order_total)::DOUBLE / count(*) AS aov FROM core_orders GROUP BY 1")
def agg_avg_round(c: Core) -> DataFrame:
    return c.orders.groupBy("order_status").agg((F.sum("order_total").cast("double") / F.count(F.lit(1))).alias("aov"))


@query("SELECT channel, count(*) FILTER (order_status = 'completed') AS completed, count(DISTINCT customer_id) FILTER (order_status = 'completed') AS buyers FROM core_orders GROUP BY 1")
def agg_filter_clause(c: Core) -> DataFrame:
    done = F.col("order_status") == "completed"
    return c.orders.groupBy("channel").agg(F.count_if(done).alias("completed"), F.countDistinct(F.when(done, F.col("customer_id"))).alias("buyers"))


@query("SELECT channel, quantile_cont(order_total::DOUBLE, 0.5) AS median FROM core_orders GROUP BY 1")
def agg_percentile(c: Core) -> DataFrame:
    return c.orders.groupBy("channel").agg(F.percentile(dbl("order_total"), 0.5).alias("median"))


@query("SELECT order_id, method FROM payments WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY payment_date DESC, payment_id DESC) = 1")
def agg_argmax_latest(c: Core) -> DataFrame:
    return rel.latest_per_key(c.payments.filter("status = 'success'"), ["order_id"], ["payment_date", "payment_id"], ["method"])


@query("SELECT channel, count(*) FILTER (order_status = 'completed') AS completed, count(*) FILTER (order_status = 'shipped') AS shipped, count(*) FILTER (order_status = 'pending') AS pending FROM core_orders GROUP BY 1")
def agg_pivot_filter(c: Core) -> DataFrame:
    return c.orders.groupBy("channel").pivot("order_status", ["completed", "shipped", "pending"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT city, count(*) AS customers, count(CASE WHEN balance < 0 THEN 1 END) AS negative FROM customers GROUP BY 1")
def agg_count_nullable(c: Core) -> DataFrame:
    return c.customers.groupBy("city").agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("balance") < 0, 1)).alias("negative"))


@query("SELECT 'orders' AS tbl, count(*) AS n FROM core_orders UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'customers', count(*) FROM customers UNION ALL SELECT 'products', count(*) FROM products")
def agg_scalar_subqueries(c: Core) -> DataFrame:
    out = None
    for name in ("orders", "items", "customers", "products"):
        part = getattr(c, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) AS n_rows, (count(*) - count(DISTINCT (event_type, user_id)))::BIGINT AS n_duplicates, 0::BIGINT AS missing_event_type, 0::BIGINT AS missing_user_id FROM events")
def agg_profile(c: Core) -> DataFrame:
    return rel.profile(c.raw("events").select("event_type", "user_id"))


@query("SELECT (count(*) FILTER (status = 'success'))::DOUBLE / count(*) AS success_rate, sum(amount)::DOUBLE / count(DISTINCT order_id) AS paid_per_order FROM payments")
def agg_ratio_kpis(c: Core) -> DataFrame:
    return c.payments.agg((F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("success_rate"), (F.sum("amount").cast("double") / F.countDistinct("order_id")).alias("paid_per_order"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_grain_check(c: Core) -> DataFrame:
    return c.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


_TEXT = " || '|' || ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in ("channel", "customer_id", "order_date", "order_id", "order_status", "order_total"))
_HALVES = " || ':' || ".join(f"sum(('0x' || substr(h, {at}, 15))::BIGINT::DECIMAL(20,0))::VARCHAR" for at in (1, 17))


@query(f", h AS (SELECT order_id, md5({_TEXT}) AS h FROM core_orders) SELECT count(*) AS n_rows, count(DISTINCT order_id) AS n_keys, {_HALVES} AS digest FROM h")
def agg_table_fingerprint(c: Core) -> DataFrame:
    return rel.fingerprint(c.orders, "order_id")


_SPEND = "SELECT customer_id, sum(order_total) AS spend FROM core_orders GROUP BY 1"


def _spend(c: Core) -> DataFrame:
    return c.orders.groupBy("customer_id").agg(F.sum("order_total").alias("spend"))


@query(f"SELECT customer_id, spend::DOUBLE AS spend, (row_number() OVER (ORDER BY spend DESC, customer_id))::INT AS rank_no FROM ({_SPEND}) QUALIFY rank_no <= 20")
def win_row_number(c: Core) -> DataFrame:
    return rel.ranked_topk(_spend(c), [F.desc("spend"), F.asc("customer_id")], 20).select("customer_id", dbl("spend").alias("spend"), "rank_no")


@query("SELECT customer_id, n, rank() OVER (ORDER BY n DESC) AS rank, dense_rank() OVER (ORDER BY n DESC) AS dense_rank FROM (SELECT customer_id, count(*) AS n FROM core_orders GROUP BY 1)")
def win_rank_dense(c: Core) -> DataFrame:
    return rel.rank_all(c.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("SELECT order_id, (row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id))::INT AS seq, count(*) OVER (PARTITION BY customer_id) AS total FROM core_orders")
def win_seq_per_key(c: Core) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("customer_id")
    return c.orders.select("order_id", F.row_number().over(by.orderBy("order_date", "order_id")).alias("seq"), F.count(F.lit(1)).over(by).alias("total"))


@query("SELECT order_id, lag(order_total) OVER w::DOUBLE AS prev_total, lead(order_id) OVER w AS next_order FROM core_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)".replace("lag(order_total) OVER w::DOUBLE", "(lag(order_total) OVER w)::DOUBLE"))
def win_lag_lead(c: Core) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    return c.orders.select("order_id", F.lag("order_total").over(w).cast("double").alias("prev_total"), F.lead("order_id").over(w).alias("next_order"))


@query("SELECT order_id, (sum(order_total) OVER (ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM core_orders")
def win_running_rows(c: Core) -> DataFrame:
    return rel.running_sum(c.orders, ["order_date", "order_id"], "order_total", F.date_trunc("day", "order_date")).select("order_id", dbl("running").alias("running"))


@query("SELECT month, (sum(total) OVER (ORDER BY month))::DOUBLE AS cumulative FROM (SELECT strftime(order_date, '%Y-%m') AS month, sum(order_total) AS total FROM core_orders GROUP BY 1)")
def win_running_range(c: Core) -> DataFrame:
    from pyspark.sql import Window

    months = c.orders.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.sum("order_total").alias("total"))
    return months.select("month", F.sum("total").over(Window.orderBy("month")).cast("double").alias("cumulative"))


@query(f"SELECT customer_id, ceil(5 * cume_dist() OVER (ORDER BY spend))::INT AS score FROM ({_SPEND})")
def win_cume_dist_score(c: Core) -> DataFrame:
    return rel.quintile(_spend(c), "spend").select("customer_id", "score")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) > 1 AS is_duplicate FROM lineitem")
def win_dedup_keep_first(c: Core) -> DataFrame:
    order = [F.asc_nulls_first(x) for x in ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")]
    return rel.split_duplicates(c.raw("lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "is_duplicate")


@query("SELECT product_id, unit_price::DOUBLE AS unit_price FROM products ORDER BY unit_price DESC, product_id LIMIT 10")
def topk(c: Core) -> DataFrame:
    return rel.topk(c.products, [F.desc_nulls_last("unit_price"), F.asc("product_id")], 10).select("product_id", dbl("unit_price").alias("unit_price"))


@query("SELECT order_id FROM core_orders ORDER BY order_date DESC, order_id DESC LIMIT 5")
def latest_n(c: Core) -> DataFrame:
    return rel.topk(c.orders, [F.desc_nulls_last("order_date"), F.desc("order_id")], 5).select("order_id")


@query("SELECT 'customer' AS kind, count(*) AS n FROM customers UNION ALL SELECT 'product', count(*) FROM products")
def union_all(c: Core) -> DataFrame:
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(c.customers, "customer").unionByName(n(c.products, "product"))


@query(", a AS (SELECT DISTINCT customer_id FROM core_orders WHERE order_status = 'completed'), b AS (SELECT DISTINCT customer_id FROM core_orders WHERE order_status = 'pending') SELECT 'both' AS kind, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_completed', count(*) FROM (FROM a EXCEPT FROM b)")
def key_set_ops(c: Core) -> DataFrame:
    a, b = (c.orders.filter(F.col("order_status") == s).select("customer_id") for s in ("completed", "pending"))
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only_completed"))
