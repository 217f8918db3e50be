from collections import Counter
from datetime import datetime

from martline.plans import basics
from martline.plans.views import Core
from martline.registry import QUERIES


def test_later_pairs_equal_brute_force_and_join_nothing(spark):
    rows = [(k % 3, datetime(1996, 1 + k * 7 % 5, 1 + k * 11 % 4)) for k in range(90)] + [(None, datetime(1996, 1, 1)), (8, None), (9, datetime(1996, 1, 1))] + [(9, datetime(1996, 1, 1))]
    want = Counter(a for a, x in rows for b, y in rows if a is not None and a == b and x and y and y > x)
    got = basics.later_pairs(spark.createDataFrame(rows, "customer_id long, order_date timestamp_ntz"), "customer_id", "order_date")
    assert {r["customer_id"]: r["pairs"] for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_item_gets_a_row_for_each_unit(spark):
    sf = "/root/testdata/sf0.001"
    want = Counter((r["item_id"], n) for r in Core(spark, sf).items.select("item_id", "quantity").collect() for n in range(1, (r["quantity"] or 0) + 1))
    assert Counter(tuple(r) for r in QUERIES["join_lateral_series_all"](spark, sf).collect()) == want and len({i % 10 for i, _ in want}) > 1
    assert basics.units(spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, -1)], "item_id long, quantity int")).collect() == [(1, 1), (1, 2)]
