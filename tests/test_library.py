import json

import pytest
from pyspark.sql import functions as F

from martline.functions.normalize import normalize
from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.operators import state
from martline.sources import files
from martline.streaming.daily import stream_daily


def test_normalize(spark):
    df = spark.createDataFrame([(" a\t", " PENDING ", "abc", "nope"), (None, "X", " 1.50 ", "2026-07-01T07:00:00+07:00")], [" Order_ID ", "Status", "amount", "created_at"])
    rows = normalize(df, lower=("status",), numeric=("amount",)).collect()
    assert rows[0]["order_id"] == "a" and rows[0]["status"] == "pending" and rows[0]["amount"] is None and rows[0]["created_at"] is None
    assert float(rows[1]["amount"]) == 1.5 and str(rows[1]["created_at"]) == "2026-07-01 00:00:00"
    with pytest.raises(ValueError):
        normalize(spark.createDataFrame([(1, 2)], ["A", "a "]))


def test_email(spark):
    """An address is a local part, an at sign, a name, a dot and an ending; cases are made by breaking each part in turn."""
    parts = ["sales", "@", "shop-7", ".", "vn"]
    broken = ["".join(parts[:i] + parts[i + 1 :]) for i in range(5)]  # a part is missing
    broken += ["".join(parts[:i] + [gap, *parts[i:]]) for i in range(1, 5) for gap in (" ", "\t")] + ["".join(parts) + "\n", "\n" + "".join(parts)]
    broken += ["".join(parts[:2] + parts[1:])]  # the at sign twice
    fine = ["".join(parts), "".join(parts + parts[3:]), "a@b.c", " ", "", None]
    df = spark.createDataFrame([(v, v in broken) for v in broken + fine], "email string, bad boolean")
    wrong = dq.tag(df, [dq.email("email")]).filter("bad <> coalesce(error_code = 'INVALID_EMAIL', false)")
    assert [r["email"] for r in wrong.collect()] == []


def test_rules_keep_their_order_and_split_is_a_partition(spark):
    df = spark.createDataFrame([(1, "0", "-1"), (2, "1", "1"), (3, None, None)], "id int, qty string, price string")
    tagged = dq.tag(df, [dq.at_least_zero("qty", "QTY", strict=True), dq.at_least_zero("price", "PRICE")])
    valid, rejected = dq.split(tagged)
    assert [r["error_code"] for r in rejected.collect()] == ["QTY|PRICE"] and sorted(r["id"] for r in valid.collect()) == [2, 3]


def test_completeness_counts_blank_as_missing_and_zero_as_present(spark):
    row = dq.completeness(spark.createDataFrame([("a", " ", "0", "x")], "a string, b string, c string, d string"), ["a", "b", "c", "d"]).first()
    assert row["score"] == 75 and row["missing_cols"] == ["b"]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2")], "id int, name string, ingested string")
    batch = spark.createDataFrame([(2, None), (3, "c"), (3, "d")], "id int, name string")
    got = {r["id"]: (r["name"], r["ingested"], r["_op"]) for r in state.upsert(target, batch, ["id"]).collect()}
    assert got == {1: ("a", "t1", "keep"), 2: (None, "t2", "update"), 3: ("d", None, "insert")}
    with pytest.raises(ValueError):
        state.upsert(target, batch.withColumn("other", F.lit(1)), ["id"])


def test_scd2_closes_opens_and_overwrites(spark):
    src = lambda *rows: spark.createDataFrame(list(rows), "id int, price int")
    empty = spark.createDataFrame([], "id int, price int, valid_from date, valid_to date, is_current boolean")
    one = state.scd2(empty, src((1, 5), (2, None)), "id", ["price"], "2026-01-01")
    two = state.scd2(one, src((1, 6), (2, None)), "id", ["price"], "2026-02-01")
    three = state.scd2(two, src((1, 7), (2, 1)), "id", ["price"], "2026-02-01")
    rows = sorted((r["id"], r["price"], str(r["valid_from"]), str(r["valid_to"]), r["is_current"]) for r in three.filter("id = 1").collect())
    assert rows == [(1, 5, "1900-01-01", "2026-01-31", False), (1, 7, "2026-02-01", "9999-12-31", True)]
    assert state.check_scd2(three, "id").count() == 0


def test_surrogate_keys_are_stable(spark):
    known = spark.createDataFrame([("b", 1)], "name string, key long")
    got = {r["name"]: r["key"] for r in state.assign_keys(known, spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "name string"), "name").collect()}
    assert got["b"] == 1 and sorted(got.values()) == [1, 2, 3]


def test_versions_publish_or_leave_everything(spark, tmp_path):
    v = state.Versions(spark, f"file://{tmp_path}/tables")
    assert v.read("t") is None and v.publish("r1", {"t": spark.range(3)}) == 1

    def refuse(staged):
        raise ValueError("no")

    with pytest.raises(ValueError):
        v.publish("r2", {"t": spark.range(9)}, refuse)
    assert v.read("t").count() == 3 and v.publish("r1", {"t": spark.range(7)}) == 1 and v.read("t").count() == 3


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,phone\n1,0955\n".encode())
    (tmp_path / "b.csv").write_text("id,phone\n")
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"id": "1", "phone": "09"}]}))
    assert files.read_dataset(spark, f"{tmp_path}/a.csv", ["id", "phone"]).first()["phone"] == "0955"
    assert files.read_dataset(spark, f"{tmp_path}/c.json", ["id", "phone"]).first()["phone"] == "09"
    for bad in ("b.csv", "d.txt"):
        with pytest.raises(ValueError):
            files.read_dataset(spark, f"{tmp_path}/{bad}", ["id", "phone"])
    (tmp_path / "pages").mkdir()
    for n in (1, 3):
        (tmp_path / "pages" / f"{n}.json").write_text(json.dumps({"page": n, "page_size": 1, "total": 3, "has_next": n < 3, "data": [{"id": str(n)}]}))
    rows, audit = files.read_pages(spark, f"{tmp_path}/pages", files.T.StructType([files.T.StructField("id", files.T.StringType())]))
    told = audit.first()
    assert rows.count() == 2 and told["missing_pages"] == 1 and told["complete"] and told["total"] == 3
    files.save_raw(rows, f"{tmp_path}/raw", "r1", "x")
    with pytest.raises(Exception):
        files.save_raw(rows, f"{tmp_path}/raw", "r1", "x")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("id,email\n1,a@b.co\n2,bad\n")
    v = state.Versions(spark, f"file://{tmp_path}/tables")
    run = lambda: stream_daily(spark, f"{tmp_path}/in", "id string, email string", f"{tmp_path}/ck", v, "customers", ["id"], [dq.email("email")], f"{tmp_path}/quarantine").awaitTermination(120)
    run()
    assert [r["id"] for r in v.read("customers").collect()] == ["1"]
    (tmp_path / "in" / "2.csv").write_text("id,email\n1,new@b.co\n3,c@d.ee\n")
    run()
    assert {r["id"]: r["email"] for r in v.read("customers").collect()} == {"1": "new@b.co", "3": "c@d.ee"}
    assert spark.read.parquet(f"{tmp_path}/quarantine").count() == 1


def test_scale_forms_equal_plain_windows(spark):
    df = spark.createDataFrame([(i, i % 7, i // 10) for i in range(100)], "id int, v int, b int")
    plain = {r["id"]: r["x"] for r in df.selectExpr("id", "sum(v) over (order by id) as x").collect()}
    assert {r["id"]: r["running"] for r in rel.running_sum(df, ["id"], "v", F.col("b")).collect()} == plain
    plain = {r["id"]: r["x"] for r in df.selectExpr("id", "cast(ceil(5 * cume_dist() over (order by v)) as int) as x").collect()}
    assert {r["id"]: r["score"] for r in rel.quintile(df, "v").collect()} == plain


def test_parents_that_are_referred_to_are_not_deleted(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "order_id int")
    orders, items = state.delete_with_children(ids(1, 2, 3), ids(1, 1, 2), ids(1), "order_id", [ids(2)])
    assert sorted(r[0] for r in orders.collect()) == [2, 3] and [r[0] for r in items.collect()] == [2]
    with pytest.raises(ValueError, match="still referred to"):
        state.delete_with_children(ids(1, 2), ids(1), ids(1), "order_id", [ids(5), ids(1)])
