"""Column functions that clean raw strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what an address must look like.
EMAIL = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode blanks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def money(c: Column) -> Column:
    """decimal(14,2), null for what is not a number."""
    return strip(c).try_cast("decimal(14,2)")


def instant(c: Column) -> Column:
    """A UTC time; offsets are honoured, what cannot be read is null."""
    return F.try_to_timestamp(strip(c))


def normalize(df: DataFrame, lower: tuple[str, ...] = (), numeric: tuple[str, ...] = ()) -> DataFrame:
    """Folded column names, stripped strings, lower-case enumerations, decimals, times for *_at and *_date,
    and null for not-a-number.
    Names that fold to the same raise ValueError."""
    names = [c.strip().lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after folding: {sorted(n for n in set(names) if names.count(n) > 1)}")
    df = df.toDF(*names)
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "string":
            c = money(c) if name in numeric else instant(c) if name.endswith(("_at", "_date")) else F.lower(strip(c)) if name in lower else strip(c)
        elif kind in ("double", "float"):
            c = F.nullif(c, F.lit(float("nan")))
        out.append(c.alias(name))
    return df.select(*out)
