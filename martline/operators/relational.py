"""Joins, aggregates, windows and sets as reusable DataFrame operators. Windows never run over a whole table in one task:
global ranks and sums go over aggregated values, or by buckets whose totals are added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martline.operators import ranks


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right, on, "left_anti")


def matched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` with a partner, once each."""
    return left.join(right, on, "left_semi")


def mismatches(left: DataFrame, right: DataFrame, on: list[str], tags: tuple[str, str]) -> DataFrame:
    """Keys that only one side has, tagged; a key with a null has no partner. Both sides are gathered by key in one aggregate."""
    keys = [F.col(k) for k in on]
    side = lambda df, n: df.select(*on, F.lit(n == 0).alias("_a"), F.lit(n == 1).alias("_b"))
    both = side(left, 0).unionByName(side(right, 1)).groupBy(*on).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    null = reduce(lambda x, y: x | y, [k.isNull() for k in keys])
    told = [F.when(F.col(x) & (null | ~F.col(y)), F.lit(t)) for x, y, t in zip(("_a", "_b"), ("_b", "_a"), tags)]
    return both.select(*on, F.explode(F.array_compact(F.array(*told))).alias("side"))


def full_recon(a: DataFrame, b: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Full outer comparison of one measure by key; null keys equal each other, a missing side counts as 0."""
    x = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col(measure).alias("a_value"))
    y = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col(measure).alias("b_value"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = x.join(y, on, "full")
    return joined.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], zero(F.col("a_value")).alias("a_value"), zero(F.col("b_value")).alias("b_value"), (zero(F.col("a_value")) - zero(F.col("b_value"))).alias("diff"))


def with_parent(df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Adds parent_name; a root is its own parent."""
    up = df.select(F.col(key).alias("_k"), F.col(name).alias("parent_name"))
    return df.join(up, F.col(parent) == F.col("_k"), "left").drop("_k").withColumn("parent_name", F.coalesce("parent_name", name))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the row of greatest ``order`` for each key: one hash aggregate, no sort."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, "_v.*")


def split_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with is_duplicate: false for the first row of each key (null keys equal each other), true for later ones."""
    return df.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def topk(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked_topk(df: DataFrame, order: list[Column], k: int, name: str = "rank_no") -> DataFrame:
    """The first k rows numbered; the window runs over k rows."""
    return topk(df, order, k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_all(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """rank and dense_rank of every row by ``value``: of its distinct values, ranked by ranges, joined back."""
    ahead = ranks.preceding(ranks.value_counts(df, value), value, "_n", descending)
    ahead = ahead.select(F.col(value).alias("_value"), (F.col("before") + 1).alias("rank"), (F.col("place") + 1).alias("dense_rank"))
    return df.join(ahead, df[value].eqNullSafe(ahead["_value"])).drop("_value")


def quintile(df: DataFrame, value: str, ascending: bool = True, parts: int = 5, name: str = "score") -> DataFrame:
    """ceil(parts * cume_dist) by ``value``: equal values share a score. Distinct values are ranked by ranges."""
    ahead = ranks.preceding(ranks.value_counts(df, value), value, "_n", not ascending)
    score = F.ceil(parts * (F.col("before") + F.col("_n")) / F.col("total")).cast("int")
    ahead = ahead.select(F.col(value).alias("_value"), score.alias(name))
    return df.join(ahead, df[value].eqNullSafe(ahead["_value"])).drop("_value")


def running_sum(df: DataFrame, order: list[str], value: str, bucket: Column, name: str = "running") -> DataFrame:
    """Sum of ``value`` up to each row in ``order`` (a total order that rises with ``bucket``): totals of buckets are
    summed first, then a window runs within each bucket."""
    df = df.withColumn("_b", bucket)
    totals = df.groupBy("_b").agg(F.sum(value).alias("_t"))
    base = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.sum(value).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_w", within).join(base, "_b").withColumn(name, F.col("_w") + F.col("_base")).drop("_b", "_w", "_base")


def share(df: DataFrame, value: str, name: str = "share_pct", scale: int = 2, of: DataFrame | None = None) -> DataFrame:
    """``value`` in percent of its total, from a one-row aggregate; ``of``: the rows that make up the total, if others."""
    total = (df if of is None else of).agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_total") != 0, F.round(100.0 * F.col(value).cast("double") / F.col("_total").cast("double"), scale))).drop("_total")


def fill_days(df: DataFrame, day: str, value: str) -> DataFrame:
    """One row for each day between the first and the last, 0 where there was none."""
    span = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(df.select(day, value), day, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def moving_average(df: DataFrame, day: str, value: str, n: int, name: str) -> DataFrame:
    """Mean of the last n rows by day, null until there are n (``df`` has one row a day)."""
    w = Window.orderBy(day).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(F.col(value).cast("double")).over(w)))


def local_month(ts: Column, hours: int = 7) -> Column:
    """yyyy-MM of a zone-less UTC time in a zone ``hours`` ahead."""
    return F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(hours)), "yyyy-MM")


def profile(df: DataFrame) -> DataFrame:
    """n_rows, n_duplicates (rows beyond the first of equal ones) and missing_<column>, in two aggregates."""
    all_equal = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return all_equal.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("n_duplicates"), *[F.sum(F.when(F.col(c).isNull(), F.col("_n")).otherwise(0)).alias(f"missing_{c}") for c in df.columns])


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_keys (distinct) and digest, a hash of the content whatever the order of rows: each row's columns, by name
    and as text, go through md5, and both halves are summed as numbers, so parts of a table are hashed where they lie and
    the sums added. digest is the two sums, joined by a colon. Nulls differ from every text."""
    text = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    row = F.md5(F.concat_ws("|", *text).cast("binary"))
    half = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(half(at)), F.lit(0).cast("decimal(30,0)")).cast("string") for at in (1, 17)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.concat_ws(":", *sums).alias("digest"))


def long_results(frames: dict[str, DataFrame]) -> DataFrame:
    """Result tables of (dimension_key, metric) under one another, tagged with their name."""
    out = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias("result_table"), F.col("dimension_key").cast("string").alias("dimension_key"), F.col("metric").cast("double").alias("metric"))
        out = part if out is None else out.unionByName(part)
    return out
