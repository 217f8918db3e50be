"""The daily run from its sources: marks, arrival, ledger, refusals, raw store, commits, staging."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.operators import run as daily
from martline.operators import state
from martline.sources import files

UTC = datetime.timezone.utc
CUSTOMERS, ORDERS = ["customer_id", "email", "updated_at"], ["order_id", "customer_id", "order_date", "updated_at"]


def contract():
    return {
        "customers": daily.Dataset(CUSTOMERS, ["customer_id"], [dq.email("email")]),
        "orders": daily.Dataset(ORDERS, ["order_id"], references=[("customer_id", "customers", "customer_id", "FK_CUSTOMER_NOT_FOUND")]),
    }


class Shop:
    """A shop with files of a day, an api, and published versions."""

    def __init__(self, spark, tmp_path):
        self.spark, self.dir, self.calls, self.landed = spark, tmp_path, [], {}
        self.versions = state.Versions(spark, f"file://{tmp_path}/core")
        self.bad, self.raw = f"file://{tmp_path}/bad", f"file://{tmp_path}/raw"
        self.paths = {"customers": f"file://{tmp_path}/customers.csv", "orders": f"file://{tmp_path}/orders.json"}
        self.write([("C1", "one@shop.org", "2026-07-01T09:00:00+07:00"), ("C1", "again@shop.org", "2026-07-09"), ("C2", "bad", "2026-08-01")], [("O1", "C1", "2026-07-01", "2026-07-01")])

    def write(self, customers, orders):
        (self.dir / "customers.csv").write_text("\n".join([",".join(CUSTOMERS), *(",".join(r) for r in customers)]) + "\n")
        (self.dir / "orders.json").write_text(json.dumps([dict(zip(ORDERS, r)) for r in orders]))

    def api(self, name, mark):
        self.calls.append((name, mark))
        columns = CUSTOMERS if name == "customers" else ORDERS
        return self.spark.createDataFrame(self.landed.get(name, []), ", ".join(f"{c} string" for c in columns))

    def run(self, run_id, mode="file", **how):
        return daily.daily(self.spark, run_id, mode, contract(), self.versions, self.bad, self.raw, self.paths, self.api, batch="day-1", **how)

    def marks(self):
        return {k: str(v) for k, v in daily.marks_of(self.versions).items()}


@pytest.fixture
def shop(spark, tmp_path):
    return Shop(spark, tmp_path)


def test_marks_are_instants_and_fall_back_row_by_row(spark):
    rows = spark.createDataFrame([("2026-07-01T09:00:00+07:00", "2026-08-01T00:00:00Z"), (None, "2026-07-02T00:00:00Z"), ("never", "2026-07-03T00:00:00Z")], "updated_at string, created_at string")
    assert str(files.high_watermark(rows).first()[0]) == "2026-07-03 00:00:00"
    assert files.high_watermark(spark.createDataFrame([("x",)], "id string")).first()[0] is None
    zones = spark.createDataFrame([("2026-07-01T23:00:00+07:00",), ("2026-07-01T17:30:00Z",)], "updated_at string")
    assert str(files.high_watermark(zones).first()[0]) == "2026-07-01 17:30:00"


def test_file_mode_moves_no_mark_and_enters_the_ledger(shop):
    status, audit = shop.run("r1")
    told = {r["dataset"]: tuple(r)[2:] for r in audit.collect()}
    assert status == "success" and told == {"customers": (3, 1, 2, 1, 0), "orders": (1, 1, 0, 1, 0)}
    assert shop.marks() == {} and shop.calls == [] and [r["batch"] for r in shop.versions.read("file_batches").collect()] == ["day-1"]
    assert shop.versions.read("customers").first()["email"] == "one@shop.org"
    seq = shop.versions.sequence()
    assert shop.run("r2", skip_processed=True) == ("skipped", None) and shop.versions.sequence() == seq
    log = shop.versions.read("run_log").first()
    assert (log["source"], log["status"], log["batch"]) == ("file", "success", "day-1") and log["started_at"] <= log["finished_at"]


def test_api_marks_come_from_valid_rows_and_never_go_back(shop):
    shop.landed = {"customers": [("C1", "one@shop.org", "2026-06-29T00:00:00Z"), ("C2", "bad", "2026-08-01T00:00:00Z")], "orders": [("O1", "C1", "2026-06-29", "2026-06-30T00:00:00Z")]}
    shop.run("r1", "api")
    assert shop.marks() == {"customers": "2026-06-29 00:00:00", "orders": "2026-06-30 00:00:00"}
    assert shop.versions.read("file_batches") is None
    shop.landed = {"orders": [("O2", "C1", "2026-06-01", "2026-06-01T00:00:00Z")]}
    shop.run("r2", "api")
    assert shop.marks()["orders"] == "2026-06-30 00:00:00" and [m for n, m in shop.calls if n == "orders"] == [None, datetime.datetime(2026, 6, 30)]


def test_masters_from_files_move_no_mark_and_an_empty_increment_is_stored(shop):
    status, audit = shop.run("r1", "both")
    assert status == "success" and shop.marks() == {} and [n for n, _ in shop.calls] == ["orders"]
    assert {r["dataset"]: r["input"] for r in audit.collect()} == {"customers": 3, "orders": 0}
    assert files.raw_resources(shop.spark, shop.raw, "r1") == ["orders"] and files.read_raw(shop.spark, shop.raw, "r1", "orders", ORDERS).count() == 0


def test_a_processed_batch_is_not_read_while_the_api_goes_on(shop):
    shop.run("r1")
    for name in ("customers.csv", "orders.json"):
        (shop.dir / name).unlink()
    shop.landed = {"orders": [("O2", "C1", "2026-07-02", "2026-07-02T00:00:00Z")]}
    before = shop.versions.path("customers")
    status, audit = shop.run("r2", "both", skip_processed=True)
    assert status == "success" and {r["dataset"]: r["inserted"] for r in audit.collect()} == {"customers": 0, "orders": 1}
    assert shop.versions.path("customers") == before  # a dataset without rows keeps its version
    assert [r["batch"] for r in shop.versions.read("file_batches").collect()] == ["day-1"]


def test_unknown_source(shop):
    with pytest.raises(ValueError, match="unknown source"):
        shop.run("r1", "ftp")


def test_the_first_of_a_key_stays_and_the_last_wins_over_files_and_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(6):
        rows = "".join(f"k{i},f{n}-{place}\n" for place in range(3) for i in range(40))
        (tmp_path / "in" / f"{n}.csv").write_text("id,value\n" + rows)
    df = files.read_dataset(spark, f"file://{tmp_path}/in/*.csv", ["id", "value"], arrival=True).repartition(5)
    spec = {"t": daily.Dataset(["id", "value"], ["id"], mark=None)}
    v = state.Versions(spark, f"file://{tmp_path}/core")
    audit = daily.run(spark, "r1", {"t": df}, spec, v, f"file://{tmp_path}/bad").first()
    assert (audit["input"], audit["valid"]) == (720, 40) and {r["value"] for r in v.read("t").collect()} == {"f0-0"}
    target = spark.createDataFrame([], "id string, value string")
    assert {r["value"] for r in state.upsert(target, df, ["id"]).collect()} == {"f5-2"}
    rows = spark.createDataFrame([("1", "z"), ("1", "b")], "id string, value string")
    assert state.upsert(target, rows, ["id"]).first()["value"] == "b"


def test_shapes_are_refused_before_a_row_is_read(spark, tmp_path):
    v, bad = state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad"
    poison = lambda *columns: spark.range(1).select(*[F.raise_error(F.lit("read")).cast("string").alias(c) for c in columns])
    for frames, what in (
        ({"stock": poison("id")}, "unknown datasets: stock"),
        ({"customers": poison("email")}, "customers: missing columns: customer_id, updated_at"),
        ({"customers": poison(*CUSTOMERS, "shoe_size")}, "unknown columns: shoe_size"),
        ({"orders": poison(*ORDERS)}, "orders: no table of customers"),
    ):
        with pytest.raises(ValueError, match=what):
            daily.run(spark, "r1", frames, contract(), v, bad)
    assert v.sequence() == 0


def test_the_header_of_a_file_tells_missing_and_unknown_columns(shop):
    (shop.dir / "customers.csv").write_text("customer_id,shoe_size\nC1,7\n")
    with pytest.raises(ValueError, match="customers: missing columns: email, updated_at"):
        shop.run("r1")
    (shop.dir / "customers.csv").write_text(",".join([*CUSTOMERS, "shoe_size"]) + "\nC1,a@b.co,2026-07-01,7\n")
    with pytest.raises(ValueError, match="customers: unknown columns: shoe_size"):
        shop.run("r1")
    assert shop.versions.sequence() == 0


def test_columns_that_are_not_required_keep_their_values(spark, tmp_path):
    v, bad = state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad"
    spec = {"t": daily.Dataset(["id", "name", "note"], ["id"], mark=None, required=["id", "name"])}
    daily.run(spark, "r1", {"t": spark.createDataFrame([("1", "a", "kept")], "id string, name string, note string")}, spec, v, bad)
    daily.run(spark, "r2", {"t": spark.createDataFrame([("1", "b"), ("2", "c")], "id string, name string")}, spec, v, bad)
    assert sorted(tuple(r) for r in v.read("t").collect()) == [("1", "b", "kept"), ("2", "c", None)]


def test_names_of_the_source_become_those_of_the_core(spark, tmp_path):
    v, bad = state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad"
    spec = {"orders": daily.Dataset(["order_id", "order_status"], ["order_id"], [dq.one_of("order_status", ["open"])], mark=None, renames={"status": "order_status"})}
    (tmp_path / "orders.json").write_text('[{"order_id": "1", "status": "open"}, {"order_id": "2", "status": "lost"}]')
    daily.daily(spark, "r1", "file", spec, v, bad, f"file://{tmp_path}/raw", {"orders": f"file://{tmp_path}/orders.json"})
    assert [tuple(r) for r in v.read("orders").collect()] == [("1", "open")]
    assert spark.read.parquet(f"{bad}/run_id=r1/dataset=orders").first()["error_code"] == "INVALID_ORDER_STATUS"


def test_chronology_and_orphans_in_a_run(spark, tmp_path):
    v, bad = state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad"
    link = [("order_id", "orders", "order_id", "FK_ORDER_NOT_FOUND")]
    spec = {
        "orders": daily.Dataset(["order_id", "at"], ["order_id"], mark=None),
        "payments": daily.Dataset(["payment_id", "order_id", "paid"], ["payment_id"], references=link, mark=None, after=("paid", "orders", "order_id", "at", "PAYMENT_BEFORE_ORDER")),
    }
    t = lambda text: datetime.datetime.fromisoformat(text)
    orders = spark.createDataFrame([("o1", t("2026-07-01T10:00:00"))], "order_id string, at timestamp")
    payments = spark.createDataFrame([("p1", "o1", t("2026-07-01T09:59:59")), ("p2", "o1", t("2026-07-01T10:00:00")), ("p3", "o9", t("2026-07-01T09:00:00")), ("p4", "o1", None)], "payment_id string, order_id string, paid timestamp")
    daily.run(spark, "r1", {"orders": orders, "payments": payments}, spec, v, bad)
    assert sorted(r["payment_id"] for r in v.read("payments").collect()) == ["p2", "p4"]
    rejects = {r["payment_id"]: r["error_code"] for r in spark.read.parquet(f"{bad}/run_id=r1/dataset=payments").collect()}
    assert rejects == {"p1": "PAYMENT_BEFORE_ORDER", "p3": "FK_ORDER_NOT_FOUND"}


def test_a_run_that_is_refused_leaves_all_and_can_be_run_again(shop):
    def refuse(written):
        assert written["customers"].count() == 1
        raise ValueError("not today")

    with pytest.raises(ValueError, match="not today"):
        shop.run("r1", audit=refuse)
    assert shop.versions.sequence() == 0 and shop.spark.read.parquet(f"{shop.bad}/run_id=r1/dataset=customers").count() == 2
    assert shop.run("r1")[0] == "success" and shop.spark.read.parquet(f"{shop.bad}/run_id=r1/dataset=customers").count() == 2


def test_each_input_is_scanned_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("1", "a@b.co", "2026-07-01")] * 5, ", ".join(f"{c} string" for c in CUSTOMERS))

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    daily.run(spark, "r1", {"customers": df.mapInArrow(count, df.schema)}, contract(), state.Versions(spark, f"file://{tmp_path}/core"), f"file://{tmp_path}/bad")
    assert reads.value == 5


def test_replay_of_the_stored_raw_changes_nothing(shop):
    shop.landed = {"customers": [("C1", "one@shop.org", "2026-07-01"), ("C3", "no", "2026-07-01")], "orders": [("O1", "C1", "2026-07-01", "2026-07-01"), ("O2", "C9", "2026-07-01", "2026-07-01")]}
    shop.run("r1", "api")
    kpi = lambda: shop.versions.read("orders").groupBy("customer_id").count().collect()
    before, marks = kpi(), shop.marks()
    daily.replay(shop.spark, shop.raw, "r1", contract=contract(), versions=shop.versions, quarantine=shop.bad)
    told = {r["dataset"]: r for r in daily.replay_check(shop.versions, "r1").collect()}
    assert told.keys() == {"customers", "orders"} and all(r["inserted"] == 0 and r["updated"] == 1 and r["same_content"] and r["idempotent"] for r in told.values())
    assert kpi() == before and shop.marks() == marks
    with pytest.raises(ValueError, match="no raw snapshot"):
        daily.replay(shop.spark, shop.raw, "r7", contract=contract(), versions=shop.versions, quarantine=shop.bad)
    changed = shop.spark.createDataFrame([("C1", "new@shop.org", "2026-07-05")], ", ".join(f"{c} string" for c in CUSTOMERS))
    daily.replay(shop.spark, {"customers": changed}, "r1b", contract=contract(), versions=shop.versions, quarantine=shop.bad)
    assert not daily.replay_check(shop.versions, "r1b").first()["same_content"]


def test_raw_snapshots_are_immutable_and_counted(spark, tmp_path):
    root = f"file://{tmp_path}/raw"
    rows = spark.createDataFrame([("1",), ("2",)], "id string")
    files.save_raw(rows, root, "r1", "x", "2026-07-01T00:00:00+00:00")
    with pytest.raises(Exception, match="exists"):
        files.save_raw(rows, root, "r1", "x")
    about = spark.read.json(f"{root}/run_id=r1/resource=x/about").first()
    assert (about["total"], about["updated_after"]) == (2, "2026-07-01T00:00:00+00:00") and about["fetched_at"]
    for part in (tmp_path / "raw" / "run_id=r1" / "resource=x" / "data").glob("part-*"):
        part.unlink()
    with pytest.raises(ValueError, match="rows, not 2"):
        files.read_raw(spark, root, "r1", "x", ["id"])


def test_of_writers_that_race_one_commits(spark, tmp_path):
    v = [state.Versions(spark, f"file://{tmp_path}/core") for _ in range(6)]
    won, lost, start = [], [], threading.Barrier(len(v))

    def write(n):
        start.wait()
        try:
            v[n]._commit(1, json.dumps({"seq": 1, "run": f"r{n}", "table": "t", "path": f"p{n}"}) + "\n")
            won.append(n)
        except state.Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(len(v))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5 and v[0].path("t") == f"p{won[0]}"


def test_a_run_published_meanwhile_is_a_conflict(spark, tmp_path):
    a, b = (state.Versions(spark, f"file://{tmp_path}/core") for _ in range(2))
    with pytest.raises(state.Conflict):
        a.publish("r1", {"t": spark.range(1)}, lambda written: b.publish("r2", {"t": spark.range(2)}) and None)
    assert a.read("t").count() == 2 and a.sequence() == 1 and a.publish("r3", {}) == 1


@pytest.mark.parametrize("content", ["{broken", '{"seq": "one", "run": "r", "table": "t", "path": "p"}', '{"seq": 1, "run": "r"}', "[1]"])
def test_a_malformed_manifest_fails_closed(spark, tmp_path, content):
    v = state.Versions(spark, f"file://{tmp_path}/core")
    v.publish("r1", {"t": spark.range(1)})
    bad = tmp_path / "core" / "_manifest" / "000000000002.json"
    bad.write_text(content)
    for ask in (v.sequence, lambda: v.read("t"), lambda: v.publish("r2", {"t": spark.range(2)})):
        with pytest.raises(ValueError, match="malformed manifest"):
            ask()
    assert bad.read_text() == content


def test_json_shapes(spark, tmp_path):
    for name, text in (("list", '[{"id": "1"}, {"id": "2", "more": 3}]'), ("wrapped", '﻿{"total": 1, "data": [{"id": "7"}]}')):
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name: [r["id"] for r in files.read_dataset(spark, f"file://{tmp_path}/{name}.json", ["id"]).collect()]
    assert read("list") == ["1", "2"] and read("wrapped") == ["7"]
    for name, text in (("object", '{"nodata": 1}'), ("none", "[]"), ("broken", '[{"id": '), ("text", '"id"')):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="no data|MALFORMED|no list"):
            read(name)


def test_staging_tells_every_dataset_and_goes_on(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n1,x\n2,\n")
    root = f"file://{tmp_path}/stage"
    frames = {
        "gone": lambda: files.read_dataset(spark, f"file://{tmp_path}/gone.csv", ["id"]),
        "a": lambda: files.read_dataset(spark, f"file://{tmp_path}/a.csv", ["id", "name"]),
        "odd": spark.range(3),
    }
    before = files.file_checksums(spark, f"file://{tmp_path}/*.csv")
    outcomes, well = files.stage_outcomes(frames, root, lambda n, d: d.select("none") if n == "odd" else d)
    told = {o["dataset"]: o for o in outcomes}
    assert not well and [told[n]["status"] for n in frames] == ["failed", "ok", "failed"]
    assert told["a"]["rows"] == 3 and told["a"]["duplicates"] == 1 and told["a"]["missing"] == {"id": 0, "name": 1} and "none" in told["odd"]["error"]
    assert spark.read.parquet(f"{root}/a").count() == 3 and files.write_outcomes(spark, outcomes, root, "r1").filter("status = 'failed'").count() == 2
    assert files.changed_files(before, files.file_checksums(spark, f"file://{tmp_path}/*.csv")).isEmpty()


def test_a_batch_during_which_a_raw_file_changes_has_not_gone_well(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("id\n1\n")
    root, paths = f"file://{tmp_path}/stage", {"a": f"file://{tmp_path}/raw/a.csv"}
    outcomes, well = files.stage_batch(spark, f"file://{tmp_path}/raw/*", paths, {"a": ["id"]}, root, "r1", lambda n, d: d)
    assert well and [tuple(r)[:2] for r in outcomes.collect()] == [("a", "ok")]

    def meddle(name, df):
        (tmp_path / "raw" / "a.csv").write_text("id\n2\n")
        return df

    outcomes, well = files.stage_batch(spark, f"file://{tmp_path}/raw/*", paths, {"a": ["id"]}, root, "r2", meddle)
    assert not well and outcomes.filter("status = 'failed' and error like 'raw file modified%'").count() == 1


def test_a_filter_on_one_time_column_reaches_the_files(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = files.incremental(events, "2024-01-15 00:00:00", ("ts",))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan


def test_changed_files_are_named(spark, tmp_path):
    for name in ("same", "edited", "removed"):
        (tmp_path / f"{name}.csv").write_text(name)
    look = lambda: spark.createDataFrame(files.file_checksums(spark, f"file://{tmp_path}/*.csv").collect())
    before = look()
    (tmp_path / "edited.csv").write_text("other")
    (tmp_path / "removed.csv").unlink()
    (tmp_path / "new.csv").write_text("x")
    got = {r["path"].rpartition("/")[2]: r["change"] for r in files.changed_files(before, look()).collect()}
    assert got == {"edited.csv": "modified", "removed.csv": "removed", "new.csv": "added"}


def test_fingerprint_tells_content_not_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b")], "id int, x string, y string")
    one = rel.fingerprint(df, "id").first()
    assert one == rel.fingerprint(df.repartition(3).orderBy(F.desc("id")).select("y", "id", "x"), "id").first() and (one["n_rows"], one["n_keys"]) == (3, 2)
    swapped = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, None, "b")], "id int, x string, y string")
    assert rel.fingerprint(swapped, "id").first()["digest"] != one["digest"] and rel.fingerprint(df.limit(0), "id").first()["digest"] == "0:0"


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_by_ranges_equal_plain_windows(spark, descending):
    for kind, rows in (("decimal(8,2)", [(i, i * i % 997 / 4) for i in range(3000)]), ("string", [(i, "é" * (i % 3) + str(i % 400)) for i in range(2000)]), ("double", [(i, [float("nan"), -0.5, float(i % 9)][i % 3]) for i in range(300)])):
        df = spark.createDataFrame([*rows, (-1, None), (-2, None)], "id int, w " + ("string" if kind == "string" else "double")).select("id", F.col("w").cast(kind).alias("v"))
        way = "desc nulls last" if descending else "asc nulls last"
        plain = {r["id"]: (r["a"], r["b"], r["c"]) for r in df.selectExpr("id", f"rank() over (order by v {way}) a", f"dense_rank() over (order by v {way}) b", f"cast(ceil(5 * cume_dist() over (order by v {way})) as int) c").collect()}
        ranked = {r["id"]: (r["rank"], r["dense_rank"]) for r in rel.rank_all(df, "v", descending).collect()}
        scores = {r["id"]: r["score"] for r in rel.quintile(df, "v", ascending=not descending).collect()}
        assert {k: (*ranked[k], scores[k]) for k in ranked} == plain
    few = spark.createDataFrame([(1, 5)], "id int, v int")
    assert rel.rank_all(few, "v").first()["rank"] == 1 and rel.rank_all(few.limit(0), "v").count() == 0


def test_no_window_over_all_values(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 100)
    for out in (rel.rank_all(df, "v"), rel.quintile(df, "v")):
        assert "SinglePartition" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x)
        assert "specpartitioned" in out._jdf.queryExecution().optimizedPlan().toString().lower() or "windowspecdefinition(_part" in out._jdf.queryExecution().optimizedPlan().toString()


def test_new_keys_follow_the_natural_key(spark):
    none = spark.createDataFrame([], "name string, key long")
    members = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)] * 2, "name string")
    first = state.assign_keys(none, members.filter("name < 'n0300'"), "name")
    both = {r["name"]: r["key"] for r in state.assign_keys(first, members, "name").collect()}
    assert both == {f"n{i:04d}": i + 1 for i in range(500)}
