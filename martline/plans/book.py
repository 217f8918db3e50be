"""Where queries enter themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martline.plans.views import CTES, Core

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Enter a function of Core as a query under its name, with DuckDB SQL that may use the core CTEs."""

    def enter(f: Callable[[Core], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Core(spark, sf_dir))
        if sql:
            ORACLES[key] = f"WITH {CTES} {sql}" if not sql.lstrip().startswith(",") else f"WITH {CTES}{sql}"
        return f

    return enter
