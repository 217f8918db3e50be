"""The star's refresh: stable keys, unknown members, the calendar, no version for nothing; and contracts that name what is broken."""

import datetime

import pytest
from pyspark.sql import functions as F

from martline.operators import quality as dq
from martline.operators import state
from martline.plans import star
from martline.plans.contract import shop_contracts
from martline.plans.views import Core

SF = "/root/testdata/sf0.001"


class Some(Core):
    """The core tables with some orders, and customers that may be renamed or missing."""

    def __init__(self, spark, orders, customers="true", rename=False):
        super().__init__(spark, SF)
        self.which, self.known, self.rename = orders, customers, rename

    @property
    def orders(self):
        return super().orders.filter(self.which)

    @property
    def customers(self):
        out = super().customers.filter(self.known)
        return out.withColumn("full_name", F.concat(F.lit("new "), "full_name")) if self.rename else out


def test_two_refreshes_keep_keys_facts_and_attributes(spark, tmp_path):
    v = state.Versions(spark, f"file://{tmp_path}/mart")
    days = ("1990-01-01", "2030-12-31")
    assert star.refresh(Some(spark, "order_id % 2 = 0", "customer_id % 3 <> 0"), v, "r1", *days) == 1
    keys = {r["customer_id"]: r["customer_key"] for r in v.read("dim_customer").collect()}
    facts = {r["order_item_id"]: r for r in v.read("fact_sales").collect()}
    assert min(keys.values()) == 1 and max(keys.values()) == len(keys)
    unknown = v.read("dim_payment_method").filter("payment_method_key = 0").first()
    assert (unknown["payment_method"], unknown["is_digital"]) == ("unknown", False)
    assert any(r["customer_key"] == 0 for r in facts.values())  # a customer that the dimension lacks
    assert star.refresh(Some(spark, "true", rename=True), v, "r2", *days) == 2
    again = {r["customer_id"]: (r["customer_key"], r["full_name"]) for r in v.read("dim_customer").collect()}
    assert all(again[k][0] == key for k, key in keys.items()) and len({k for k, _ in again.values()}) == len(again) > len(keys)
    assert all(name.startswith("new ") for _, name in again.values())
    later = {r["order_item_id"]: r for r in v.read("fact_sales").collect()}
    assert len(later) > len(facts) and all(later[k] == row for k, row in facts.items())  # facts that stand stay
    assert star.refresh(Some(spark, "true", rename=True), v, "r3", *days) == 2 and v.sequence() == 2  # nothing new, no version
    assert star.refresh(Some(spark, "true", rename=True), v, "r4", *days, full=True) == 3
    assert v.read("fact_sales").filter("customer_key = 0").isEmpty()


def test_days_outside_the_calendar_are_refused(spark, tmp_path):
    v = state.Versions(spark, f"file://{tmp_path}/mart")
    with pytest.raises(ValueError, match="outside the calendar"):
        star.refresh(Some(spark, "true"), v, "r1", "1990-01-01", "1994-12-31")
    assert v.sequence() == 0 and v.read("fact_sales") is None


def test_a_broken_fact_is_refused_by_name(spark):
    fact = spark.createDataFrame([(1, 1, 0, 0, 0, 1, 19970101, 0, 5.0, 1.0, 5.0, 5.0)] * 2, "order_item_id long, order_id long, customer_key long, product_key long, payment_method_key long, order_status_key long, date_key int, quantity int, unit_price double, discount double, gross_amount double, revenue double")
    with pytest.raises(ValueError, match=r"quantity > 0 \(2\), revenue = gross_amount - discount \(2\), unique order_item_id \(1\)"):
        star.audit_star({"fact_sales": fact, "dim_date": fact})


def test_contracts_name_every_violation(spark):
    t = datetime.datetime(2026, 1, 1)
    key = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    contracts = shop_contracts("2026-06-30", key("customer_id", "c"), key("product_id", "p"), key("order_id", "o"), key("category_id", "k"), key("order_status", "pending"))

    def broken(table, schema, *rows):
        return {r["check"]: r["violations"] for r in contracts[table].audit(spark.createDataFrame(list(rows), schema)).collect() if r["violations"]}

    person = "customer_id string, full_name string, email string, customer_segment string, status string"
    assert broken("customers", person, ("1", "a", "a@b.co", "s", "active"), ("2", "b", "b@b.co", "s", "inactive")) == {}
    assert broken("customers", person, ("1", None, "a@b.co", "s", "gone"), ("1", "b", "a@b.co", "s", "active"), ("3", "c", "nobody", "s", None)) == {
        "full_name is not null": 1, "status is not null": 1, "status is allowed": 1, "email is an address": 1, "unique customer_id": 1, "unique email": 1}
    product = "product_id string, category_id string, product_name string, unit_price decimal(9,2), cost_price decimal(9,2), status string"
    D = __import__("decimal").Decimal
    assert broken("products", product, ("1", "k", "x", D(5), D(6), "active"), ("2", "z", "y", D(-1), D(-2), "sold")) == {
        "unit_price >= 0": 1, "cost_price >= 0": 1, "status is allowed": 1, "unit_price >= cost_price": 1, "category_id is known": 1}
    payment = "payment_id string, order_id string, payment_date timestamp, payment_method string, payment_status string, amount decimal(9,2)"
    late = datetime.datetime(2026, 7, 1)
    assert broken("payments", payment, ("1", "o", t, "cash", "success", D(1)), ("2", "q", late, "shells", "maybe", D(0)), ("2", None, t, "card", "failed", D(3))) == {
        "order_id is not null": 1, "amount > 0": 1, "payment_method is allowed": 1, "payment_status is allowed": 1, "payment_date is past": 1, "unique payment_id": 1, "order_id is known": 1}
    assert dq.audit(spark.createDataFrame([], person), [dq.Check("x", F.col("status") == "y")], [["email"]]).collect() == [("x", 0), ("unique email", 0)]


def test_figures_before_and_after_are_written(spark, tmp_path):
    v, reports = state.Versions(spark, f"file://{tmp_path}/mart"), f"file://{tmp_path}/reports"
    days = ("1990-01-01", "2030-12-31")
    first = {r["kpi"]: r for r in star.refresh_and_compare(Some(spark, "order_id % 2 = 0"), v, "r1", *days, reports).collect()}
    assert all(r["before"] == 0 and r["diff"] == r["after"] > 0 for r in first.values()) and len(first) == 4
    second = {r["kpi"]: r for r in star.refresh_and_compare(Some(spark, "true"), v, "r2", *days, reports).collect()}
    assert all(second[k]["before"] == r["after"] and second[k]["diff"] == second[k]["after"] - r["after"] > 0 for k, r in first.items())
    with pytest.raises(ValueError):
        star.refresh_and_compare(Some(spark, "true"), v, "r3", "1990-01-01", "1990-01-02", reports, full=True)
    rows = {r["kpi"]: r for r in spark.read.option("header", True).csv(f"{reports}/run_id=r2/csv").collect()}
    assert rows["order_count"]["diff"].isdigit() and rows["total_revenue"]["diff"][-3] == "." and not (tmp_path / "reports" / "run_id=r3").exists()
    older = v.read("fact_sales").drop("net_amount")
    assert star.kpis(older, v.read("dim_order_status")).collect() == star.kpis(v.read("fact_sales"), v.read("dim_order_status")).collect()


def test_not_a_number_is_null_in_the_load_path(spark):
    from martline.functions.normalize import normalize

    rows = normalize(spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "Amount double")).collect()
    assert [r["amount"] for r in rows] == [1.5, None, None]
