"""Compare a query's Spark rows with those of its DuckDB SQL over the same tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows_of(names, cur.fetchall())


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = oracle_rows(sql, sf_dir)
    assert got[0] == want[0], f"columns {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"{len(got[1])} rows, the SQL gives {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)), f"{a}\n{b}\n{got[0]}"
    return len(got[1])
