import json

import pytest
from pyspark.sql import functions as F

from martline.operators import quality as dq
from martline.operators import run as daily
from martline.operators import state
from martline.sources import files

@pytest.fixture
def contract(spark):
    return {
        "customers": daily.Dataset(["customer_id", "email", "updated_at"], ["customer_id"], [dq.email("email")]),
        "orders": daily.Dataset(["order_id", "customer_id", "updated_at"], ["order_id"], references=[("customer_id", "customers", "customer_id", "FK_CUSTOMER_NOT_FOUND")]),
    }


def frames(spark, customers, orders):
    return {"customers": spark.createDataFrame(customers, "customer_id string, email string, updated_at string"), "orders": spark.createDataFrame(orders, "order_id string, customer_id string, updated_at string")}


def test_a_run_loads_rejects_audits_and_repeats_nothing(spark, tmp_path, contract):
    versions, bad = state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad"
    batch = frames(spark, [("c1", "a@shop.org", "2026-07-01"), ("c1", "a@shop.org", "2026-07-02"), ("c2", "nobody", "2026-07-09")], [("o1", "c1", "2026-07-01"), ("o2", "c2", "2026-07-03")])
    mart = lambda t: {"per_customer": t["orders"].groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))}
    told = {r["dataset"]: tuple(r)[2:] for r in daily.run(spark, "r1", batch, contract, versions, bad, mart=mart).collect()}
    assert told == {"customers": (3, 1, 2, 1, 0), "orders": (2, 1, 1, 1, 0)}
    assert {r["resource"]: str(r["watermark"])[:10] for r in versions.read("watermarks").collect()} == {"customers": "2026-07-01", "orders": "2026-07-01"}
    codes = sorted(r["error_code"] for n in contract for r in spark.read.parquet(f"{bad}/run_id=r1/dataset={n}").collect())
    assert codes == ["DUPLICATE_PRIMARY_KEY", "FK_CUSTOMER_NOT_FOUND", "INVALID_EMAIL"]
    assert [tuple(r) for r in versions.read("per_customer").collect()] == [("c1", 1)] and spark.read.json(f"{bad}/reports/run_id=r1/json").count() == 3
    seq = versions.sequence()
    assert daily.run(spark, "r1", batch, contract, versions, bad, mart=mart).count() == 2 and versions.sequence() == seq
    # an older and an empty increment move no mark; a parent of an earlier run is known
    later = frames(spark, [], [("o3", "c1", "2026-06-01")])
    told = {r["dataset"]: tuple(r)[2:] for r in daily.run(spark, "r2", later, contract, versions, bad).collect()}
    assert told["orders"] == (1, 1, 0, 1, 0)
    assert {str(r["watermark"])[:10] for r in versions.read("watermarks").collect()} == {"2026-07-01"} and versions.read("run_audit").filter("run_id = 'r1'").count() == 2
    daily.replay(spark, frames(spark, [("c1", "b@shop.org", "2027-01-01")], []), "r1", contract=contract, versions=versions, quarantine=bad)
    assert versions.read("customers").first()["email"] == "b@shop.org" and {str(r["watermark"])[:10] for r in versions.read("watermarks").collect()} == {"2026-07-01"}


def test_a_failed_run_publishes_nothing(spark, tmp_path, contract):
    versions = state.Versions(spark, f"file://{tmp_path}/core")
    for rows in ([(None, "a@shop.org", "2026-07-01")],):
        with pytest.raises(ValueError, match="null key"):
            daily.run(spark, "r1", frames(spark, rows, []), contract, versions, f"file://{tmp_path}/bad")
    assert versions.sequence() == 0 and versions.read("customers") is None


def test_invariant_holds_in_every_dataset(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "dataset string")
    assert dq.check_invariant(one("a", "a", "b"), one("a", "b"), one("a")).count() == 2
    with pytest.raises(ValueError):
        dq.check_invariant(one("a", "a", "b"), one("a", "b", "b"), one())


def test_guard_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    state.guard(df, ["id", "name"], ["id"])
    for columns, keys in ((["id"], ["id"]), (["id", "name"], ["key"])):
        with pytest.raises(ValueError):
            state.guard(df, columns, keys)


def test_sources_by_mode_staging_and_places(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("B,A\n1,2\n,4\n")
    (tmp_path / "orders.json").write_text(json.dumps([{"id": "1", "updated_at": "2026-07-02"}]))
    columns = {"customers": ["B", "A"], "orders": ["id", "updated_at"]}
    paths = {"customers": f"file://{tmp_path}/customers.csv", "orders": f"file://{tmp_path}/orders.json"}
    api = {"orders": spark.createDataFrame([("1", "2026-07-01"), ("2", "2026-07-03")], "id string, updated_at string"), "customers": spark.createDataFrame([("x", "y")], "B string, A string")}
    got = lambda mode, mark=None: {n: d.count() for n, d in files.source_frames(spark, mode, paths, api, {"orders": mark}, columns).items()}
    assert got("file") == {"customers": 2, "orders": 1} and got("both", "2026-07-02") == {"customers": 2, "orders": 1} and got("api", "2027-01-01") == {"customers": 1, "orders": 0}
    with pytest.raises(ValueError):
        got("ftp")
    assert [tuple(r) for r in files.read_positional(spark, paths["customers"], ["a", "b"]).collect()] == [("1", "2"), (None, "4")]
    told = files.stage({"a": api["orders"], "b": api["orders"]}, f"file://{tmp_path}/stage", lambda n, d: d if n == "a" else d.select("none"))
    assert told["a"] == "ok" and told["b"].startswith("AnalysisException") and spark.read.parquet(f"file://{tmp_path}/stage/a").count() == 2
