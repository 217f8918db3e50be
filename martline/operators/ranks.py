"""Ranks over a whole table, without a window over the whole table.

The distinct values are counted, cut into ranges by splitters of a bounded sample, and summed by range. A value's rank is
what the ranges before its own hold, a list of at most ``PARTS`` + 1 totals, and what stands before it within its range,
a window over that range alone. Rows of one value are one row of the counts, so a hot value costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martline.plans.storage import materialize

#: Ranges that values are cut into, and values in the sample that tells where.
PARTS, SAMPLE = 64, 8192


def splitters(values: DataFrame, column: str, parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """One row with ``cuts``: up to parts - 1 rising values that cut the values of ``column``, distinct ones, into about equal
    parts. The sample is that of the least hashes, the same at every run."""
    drawn = values.select(column).filter(F.col(f"`{column}`").isNotNull()).orderBy(F.xxhash64(column), column).limit(sample)
    rows = [r[0] for r in drawn.orderBy(column).collect()]
    cuts = [rows[k * len(rows) // parts] for k in range(1, parts)] if len(rows) >= parts else rows[1:]
    kind = T.StructType([T.StructField("cuts", T.ArrayType(values.schema[column].dataType))])
    return values.sparkSession.createDataFrame([(cuts,)], kind)


def preceding(counts: DataFrame, column: str, weight: str, descending: bool = False) -> DataFrame:
    """``counts``, a written table of distinct values with a weight, with before (the weights of the values ahead of each
    in the order), place (how many values are ahead) and total (all weights). Null comes last in either order."""
    value, order = F.col(f"`{column}`"), F.col(f"`{column}`").desc_nulls_last() if descending else F.col(f"`{column}`").asc_nulls_last()
    part = F.size(F.filter("cuts", lambda cut: cut <= value))
    part = F.when(value.isNull(), F.lit(PARTS + 1)).otherwise(-part if descending else part)
    parted = counts.crossJoin(F.broadcast(splitters(counts, column))).withColumn("_part", part).drop("cuts")
    totals = parted.groupBy("_part").agg(F.sum(weight).cast("long").alias("weights"), F.count(F.lit(1)).alias("values"))
    totals = totals.agg(F.collect_list(F.struct("_part", "weights", "values")).alias("_totals"))  # PARTS + 1 of them
    ahead = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda name, rows: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, t: acc + t[name])
    before = F.filter("_totals", lambda t: t["_part"] < F.col("_part"))
    out = parted.withColumns({"_in": F.coalesce(F.sum(weight).over(ahead), F.lit(0)).cast("long"), "_at": F.count(F.lit(1)).over(ahead)})
    out = out.crossJoin(F.broadcast(totals))
    return out.select(
        *[F.col(f"`{c}`") for c in counts.columns], (F.col("_in") + summed("weights", before)).alias("before"),
        (F.col("_at") + summed("values", before)).alias("place"), summed("weights", F.col("_totals")).alias("total"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, _n) of the distinct values, null among them, written once."""
    return materialize(df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")), "counts")
