import pytest

import compare
from martline.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_sql(spark, name):
    if name in ORACLES:
        compare.compare(spark, QUERIES[name], ORACLES[name], SF)
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_no_python_in_plans(spark):
    for name, query in QUERIES.items():
        assert "Python" not in query(spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
