"""The quality firewall: rules add codes to rows, and rows are split by them. Rules are column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martline.functions.normalize import EMAIL, strip
from martline.plans.storage import materialize


@dataclass(frozen=True)
class Rule:
    """A row that meets ``fails`` gets ``code``; null counts as passing."""

    code: str
    fails: Column


@dataclass(frozen=True)
class Check:
    """A table constraint: rows that meet ``fails`` break it; null counts as passing."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Contract:
    """What must hold in a table. ``unique``: keys of which no two rows are equal (rows with a null in the key are told
    apart). ``lookups``: (column, table, its column): a present value must be one of these."""

    checks: list[Check] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    lookups: list[tuple[str, DataFrame, str]] = field(default_factory=list)

    def audit(self, df: DataFrame) -> DataFrame:
        return audit(df, self.checks, self.unique, self.lookups)


def not_null(*columns: str) -> list[Check]:
    return [Check(f"{c} is not null", F.col(c).isNull()) for c in columns]


def audit(df: DataFrame, checks: list[Check], unique: list[list[str]] = (), lookups: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(check, violations), one row a constraint: all checks in one aggregate over ``df``, one more for each key that must
    be unique (the rows beyond the first of a key) and for each lookup (rows whose value it lacks, by its distinct values)."""
    row = lambda name, n: F.struct(F.lit(name).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("violations"))
    parts = [df.agg(F.array(*[row(k.name, F.count_if(F.coalesce(k.fails, F.lit(False)))) for k in checks]).alias("x"))] if checks else []
    for keys in unique:
        known = df.select(*keys).dropna().groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n"))
        parts.append(known.agg(F.array(row(f"unique {', '.join(keys)}", F.sum("n"))).alias("x")))
    for column, table, key in lookups:
        have = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        lacks = have.join(table.select(F.col(key).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left_anti")
        parts.append(lacks.agg(F.array(row(f"{column} is known", F.sum("n"))).alias("x")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(F.inline("x"))


def present(c: Column) -> Column:
    return c.isNotNull() & (strip(c.cast("string")) != "")


def email(col: str) -> Rule:
    return Rule("INVALID_EMAIL", present(F.col(col)) & ~F.col(col).rlike(EMAIL))


def one_of(col: str, allowed: list[str]) -> Rule:
    return Rule(f"INVALID_{col.upper()}", present(F.col(col)) & ~strip(F.col(col)).isin(allowed))


def at_least_zero(col: str, code: str, strict: bool = False) -> Rule:
    value = F.col(col).cast("string").try_cast("decimal(20,4)")
    return Rule(code, value <= 0 if strict else value < 0)


def require_columns(df: DataFrame, needed: list[str]) -> None:
    """Raises ValueError naming every missing column."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """Adds score (percent of the required columns that are present), missing_cols and is_complete."""
    missing = F.array_compact(F.array(*[F.when(~present(F.col(c)), F.lit(c)) for c in required]))
    return df.withColumn("missing_cols", missing).withColumn("score", F.round(100 * (len(required) - F.size("missing_cols")) / len(required)).cast("int")).withColumn("is_complete", F.size("missing_cols") == 0)


def tag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds error_codes (array, in the order of the rules) and error_code (joined by |, null if none)."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(r.fails, F.lit(False)), F.lit(r.code)) for r in rules]))
    return df.withColumn("error_codes", codes).withColumn("error_code", F.when(F.size("error_codes") > 0, F.array_join("error_codes", "|")))


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid without codes, rejected with error_code)."""
    return tagged.filter("error_code is null").drop("error_codes", "error_code"), tagged.filter("error_code is not null").drop("error_codes")


def foreign_key(df: DataFrame, col: str, reference: DataFrame, key: str, code: str) -> DataFrame:
    """Appends ``code`` to error_codes of rows whose present key the reference lacks. A join, not a collected set."""
    keys = reference.select(F.col(key).alias("_ref")).filter("_ref is not null").distinct().withColumn("_known", F.lit(True))
    out = df.join(keys, df[col] == keys["_ref"], "left")
    orphan = F.col(col).isNotNull() & F.col("_known").isNull()
    out = out.withColumn("error_codes", F.when(orphan, F.array_append("error_codes", F.lit(code))).otherwise(F.col("error_codes"))).drop("_ref", "_known")
    return out.withColumn("error_code", F.when(F.size("error_codes") > 0, F.array_join("error_codes", "|")))


def orphans(df: DataFrame, col: str, reference: DataFrame, key: str, code: str) -> DataFrame:
    """(code, n): how many rows have a present key that the reference lacks, one row; rows are counted by key before the join."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    lacks = counts.join(reference.select(F.col(key).alias("_ref")), F.col("_key") == F.col("_ref"), "left_anti")
    return lacks.agg(F.lit(code).alias("code"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def violations(rejected: DataFrame) -> DataFrame:
    """(code, n) over the rejected rows."""
    return rejected.select(F.explode(F.split("error_code", r"\|")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def check_invariant(given: DataFrame, valid: DataFrame, rejected: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, input, valid, rejected), counted in the three frames; raises if input is not valid + rejected in every
    dataset, however the totals stand. The counts, one row a dataset, are written once."""
    one = lambda df, name: df.select(dataset, *[F.lit(int(name == n)).cast("long").alias(n) for n in ("input", "valid", "rejected")])
    every = one(given, "input").unionByName(one(valid, "valid")).unionByName(one(rejected, "rejected"))
    stats = materialize(every.groupBy(dataset).agg(*[F.sum(n).alias(n) for n in ("input", "valid", "rejected")]), "stats")
    if not stats.filter("input <> valid + rejected").isEmpty():
        raise ValueError("input is not valid + rejected")
    return stats


def exceeds_gross(quantity: str, price: str, discount: str) -> Rule:
    """A discount of more than the line's gross; equality passes."""
    return Rule("DISCOUNT_EXCEEDS_GROSS", F.col(discount) > F.col(quantity) * F.col(price))


def split_duplicate_keys(valid: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(first of every key, the later ones with error_code DUPLICATE_PRIMARY_KEY); null keys are told apart from others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = valid.withColumn("_n", F.row_number().over(w))
    return numbered.filter("_n = 1").drop("_n"), numbered.filter("_n > 1").drop("_n").withColumn("error_code", F.lit("DUPLICATE_PRIMARY_KEY"))


def reference_keys(history: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """What a foreign key may point to: keys loaded before and the valid ones of this batch."""
    return history.select(key).unionByName(valid.select(key)).filter(F.col(key).isNotNull()).distinct()


def chronology(tagged: DataFrame, orders: DataFrame, on: str, at: str, since: str, code: str = "PAYMENT_BEFORE_ORDER") -> DataFrame:
    """Appends ``code`` where the instant ``at`` lies before its order's ``since``; equality, orphans and nulls pass."""
    known = orders.select(F.col(on).alias("_on"), F.col(since).alias("_since")).dropDuplicates(["_on"])
    out = tagged.join(known, tagged[on] == known["_on"], "left")
    early = F.coalesce(F.col(at) < F.col("_since"), F.lit(False))
    out = out.withColumn("error_codes", F.when(early, F.array_append("error_codes", F.lit(code))).otherwise(F.col("error_codes"))).drop("_on", "_since")
    return out.withColumn("error_code", F.when(F.size("error_codes") > 0, F.array_join("error_codes", "|")))


def concat_rejects(*rejected: DataFrame) -> DataFrame:
    """All rejects of a dataset, whatever tier found them; columns that a tier lacks are null."""
    out = rejected[0]
    for more in rejected[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def listing(rejected: DataFrame, key: str) -> DataFrame:
    """(key, code, text): one readable line for each violation."""
    each = rejected.select(F.col(key).cast("string").alias("key"), F.explode(F.split("error_code", r"\|")).alias("code"))
    return each.withColumn("text", F.concat_ws(" ", "code", F.lit(f"{key} ="), F.coalesce("key", F.lit("null"))))


def report(stats: DataFrame, run_id: str) -> DataFrame:
    """The statistics of ``check_invariant`` with their run, shares and a last row of totals (dataset null)."""
    total = stats.agg(F.lit(None).cast("string").alias("dataset"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("input", "valid", "rejected")])
    out = stats.select(F.col("dataset").cast("string"), "input", "valid", "rejected").unionByName(total)
    return out.select(F.lit(run_id).alias("run_id"), "*", (100.0 * F.col("rejected") / F.nullif("input", F.lit(0))).alias("rejected_pct"), (F.col("rejected") == 0).alias("clean"))
