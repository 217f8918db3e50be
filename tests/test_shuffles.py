"""How often queries read and deal lines: once, whatever is asked of them; and that what they tell is whole."""

import os

import pytest
from pyspark.sql import functions as F

import compare
from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.plans import mart, star, warehouse
from martline.plans.views import Core
from martline.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df):
    """Scans of lineitem; the one table with a tax or a line number."""
    return sum("l_linenumber" in x or "l_orderkey" in x for x in plan(df).splitlines() if "Relation " in x)


@pytest.mark.parametrize("name", ["kpi_month_category", "kpi_top_products", "bq05_revenue_by_category", "join_star4", "join_as_of_version", "fact_sales_full"])
def test_lines_are_read_once_and_dealt_by_order(spark, name):
    """F14 to F18: keys that come more than once were told first, and lines then shuffled by them for items and payments."""
    df = QUERIES[name](spark, SF)
    assert scans(df) == 1 and plan(df).count("RepartitionByExpression") == 1


@pytest.fixture
def odd(spark, tmp_path):
    """Tables of which lines have nulls, some in lines that come again."""
    for t in compare.TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    raw = spark.read.parquet(f"{SF}/lineitem.parquet")
    null = lambda c, k: raw.filter(F.col("l_orderkey") % k == 0).withColumn(c, F.lit(None).cast(raw.schema[c].dataType))
    more = null("l_discount", 3).unionByName(null("l_extendedprice", 4)).unionByName(null("l_shipdate", 5)).unionByName(raw.filter("l_orderkey % 6 = 0"))
    raw.unionByName(more.unionByName(null("l_partkey", 7).withColumn("l_linenumber", F.col("l_linenumber") + 40))).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["fact_sales_full", "star_fact_sales", "kpi_revenue_by_category", "category_share", "join_mismatch_both_ways", "recon_four_kpis"])
def test_lines_with_nulls_that_come_again_equal_the_sql(spark, odd, name):
    compare.compare(spark, QUERIES[name], ORACLES[name], odd)


def test_star_fact_shuffles_no_item_for_what_its_order_tells(spark):
    """the fact is not joined by its surrogate keys again, and its items once by product."""
    df = QUERIES["star_kpi_by_dimensions"](spark, SF)
    assert scans(df) == 1 and scans(QUERIES["star_fact_sales"](spark, SF)) == 1
    assert not any(f"{k}_key" in x for x in plan(df).splitlines() for k in ("customer", "product", "payment_method") if x.strip(" :+-").startswith("Join"))


def test_methods_are_told_once(spark):
    """the dimension, its ledger and the ledger before that each went over all payments."""
    assert scans(QUERIES["star_dim_payment_method"](spark, SF)) == 0
    c = Core(spark, SF)
    star.member(c, "dim_customer")
    assert "methods" not in vars(c)


def test_shares_of_categories_are_of_all_revenue(spark):
    """the total has the items of unknown products too, as in the SQL; F12: neither total reads the lines again."""

    class Few(Core):
        @property
        def products(self):
            return super().products.filter("category_id <> 'N3'")

    whole = {r["category_id"]: r["share_pct"] for r in mart.kpi_revenue_by_category(Core(spark, SF)).collect()}
    few = {r["category_id"]: r["share_pct"] for r in mart.kpi_revenue_by_category(Few(spark, SF)).collect()}
    assert few == {k: v for k, v in whole.items() if k != "N3"}
    assert scans(mart.kpi_revenue_by_category(Core(spark, SF))) == scans(warehouse.category_share(Core(spark, SF))) == 0


def test_invariant_is_counted_once(spark):
    """the statistics that a report reads twice went over all rows each time."""
    assert scans(QUERIES["dq_report"](spark, SF)) == 0


def test_four_figures_in_several_states(spark):
    """F7, F8: the fact was made for each state, and its rows tripled to count orders."""
    df = QUERIES["recon_four_kpis"](spark, SF)
    assert scans(df) == 1 and "Expand" not in plan(df)
    fact = spark.createDataFrame([(1, "completed", 2), (1, "completed", 3), (2, "shipped", 4), (10, "completed", 5)], "order_id long, order_status string, revenue int")
    got = {r["kpi"]: (r["few"], r["all"]) for r in warehouse.four_kpis_of(fact, {"few": F.col("order_id") % 10 != 0, "all": F.lit(True)}).collect()}
    assert got == {"revenue": (9, 14), "orders": (2, 3), "completed_orders": (1, 2), "items": (3, 4)}
    assert [r["v"] for r in warehouse.four_kpis(fact.limit(0)).collect()] == [0, 0, 0, 0]


def test_refresh_that_adds_facts_makes_each_line_once(spark):
    """three reads of the fact share one exchange of its lines."""
    df = QUERIES["fact_sales_incremental"](spark, SF)
    df.collect()
    last = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert last.count("REPARTITION_BY_COL") - last.count("ReusedExchange") <= 1


def test_orders_without_items_need_no_first_lines(spark):
    """which orders have items is told without dropping lines that come again."""
    shape = plan(QUERIES["join_mismatch_both_ways"](spark, SF))
    assert "Window" not in shape and "Join" not in shape and shape.count("Aggregate") == 1
    a, b = (spark.createDataFrame(rows, "k int, j int") for rows in ([(1, 1), (1, 1), (2, 1), (None, 1)], [(2, 1), (3, 1), (3, 1), (None, 1)]))
    assert sorted(map(str, rel.mismatches(a, b, ["k", "j"], ("l", "r")).collect())) == sorted(f"Row(k={k}, j=1, side='{s}')" for k, s in ((1, "l"), (3, "r"), (None, "l"), (None, "r")))


def test_orphans_are_counted_by_key(spark):
    """rows are counted by key before they meet the reference; a key that none breaks is told too."""
    rows = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    told = lambda known: tuple(dq.orphans(rows, "k", spark.createDataFrame([(x,) for x in known], "id long"), "id", "X").first())
    assert told([2, 2, None]) == ("X", 2) and told([1, 2]) == ("X", 0)


@pytest.mark.parametrize("name", ["kpi_month_category", "join_star4", "kpi_top_products"])
def test_revenue_by_product_shuffles_no_more_of_lines_than_it_needs(spark, odd, name):
    """F15, F16, F17: quantity, flag and date of shipment were shuffled with each line and told nothing."""
    shape = plan(QUERIES[name](spark, SF))
    assert not any(c in x for x in shape.splitlines() if "Relation " not in x for c in ("l_quantity", "l_returnflag", "l_shipdate"))
    compare.compare(spark, QUERIES[name], ORACLES[name], odd)
