"""Snapshot operators: (current, changes) -> next, surrogate keys, type 2 dimensions, and published versions."""

from __future__ import annotations

import json
import pathlib
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martline.operators import ranks
from martline.sources.files import ARRIVAL


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``target`` after ``batch``, with _op (insert, update, keep). Columns that the batch does not supply keep their value,
    supplied nulls overwrite; of several rows of a key the greatest in ``order`` wins, the last to arrive if none is given.
    Arrival is the batch's column of that name (``sources.files``), which is not loaded, else the order of its rows."""
    if ARRIVAL not in batch.columns:
        batch = batch.withColumn(ARRIVAL, F.monotonically_increasing_id())
    if unknown := [c for c in batch.columns if c not in target.columns and c != ARRIVAL]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    rest = [c for c in batch.columns if c not in keys and c != ARRIVAL]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest] or [F.lit(1)]), F.struct(*(order or [ARRIVAL]))).alias("_new"), F.lit(True).alias("_in"))
    joined = target.withColumn("_had", F.lit(True)).join(last, keys, "full")
    cols = [F.col(c) if c in keys else F.when(F.col("_in"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in target.columns]
    op = F.when(F.col("_had").isNull(), "insert").when(F.col("_in"), "update").otherwise("keep").alias("_op")
    return joined.select(*cols, op)


def guard(batch: DataFrame, columns: list[str], keys: list[str]) -> None:
    """Raises ValueError before anything is written: key columns missing, columns unknown, or a key that is null."""
    guard_columns(batch.columns, columns, keys)
    if not batch.filter(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).isEmpty():
        raise ValueError(f"null key: {', '.join(keys)}")


def guard_columns(given: list[str], columns: list[str], keys: list[str], dataset: str = "") -> None:
    """The part of ``guard`` that no row is read for. Arrival is no unknown column."""
    of = f"{dataset}: " if dataset else ""
    if missing := [k for k in keys if k not in given]:
        raise ValueError(f"{of}missing key columns: {', '.join(missing)}")
    if unknown := [c for c in given if c not in columns and c != ARRIVAL]:
        raise ValueError(f"{of}unknown columns: {', '.join(unknown)}")


def as_of_version(facts: DataFrame, dim: DataFrame, key: str, day: str) -> DataFrame:
    """``facts`` with the columns of the version of their key that was valid on their day; the key is an equi-join, the
    interval a filter on it. Facts without a version keep nulls."""
    d = dim.withColumnsRenamed({key: "_key", "valid_from": "_from", "valid_to": "_to"})
    on = (facts[key] == d["_key"]) & facts[day].cast("date").between(d["_from"], d["_to"])
    return facts.join(d, on, "left").drop("_key", "_from", "_to")


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` overwritten (nulls too) where ``source``, of one row a key, has the key."""
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_in"))
    return target.join(s, keys, "left").select(*[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_with_children(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, blockers: list[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the keys in ``gone``; raises ValueError, deleting nothing, while a blocker refers to one."""
    gone = gone.select(key).distinct()
    for other in blockers:
        if not other.join(gone, key, "left_semi").isEmpty():
            raise ValueError(f"{key} is still referred to")
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def advance(before: DataFrame, loaded: DataFrame) -> DataFrame:
    """(resource, watermark): per resource the later of what stood and what was loaded; neither an empty increment nor an
    older one moves it back."""
    return before.unionByName(loaded).groupBy("resource").agg(F.max("watermark").alias("watermark"))


def append_new(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the rows of ``batch`` whose key it lacks; existing rows never change."""
    return target.unionByName(batch.dropDuplicates(keys).join(target, keys, "left_anti"), allowMissingColumns=True)


def assign_keys(known: DataFrame, members: DataFrame, natural: str, key: str = "key") -> DataFrame:
    """(natural, key): known members keep theirs, new ones are numbered after the greatest, in order of the natural key. New
    members are ranked by ranges of the natural key, so no window holds them all; null is no member."""
    new = members.select(natural).filter(F.col(natural).isNotNull()).distinct().join(known, natural, "left_anti")
    ranked = ranks.preceding(ranks.value_counts(new, natural), natural, "_n")
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = ranked.crossJoin(F.broadcast(top)).select(natural, (F.col("_top") + F.col("place") + 1).cast("long").alias(key))
    return known.select(natural, key).unionByName(numbered)


def scd2(dim: DataFrame, source: DataFrame, key: str, tracked: list[str], day: str) -> DataFrame:
    """Next state of a type 2 dimension (key, tracked..., valid_from, valid_to, is_current) as of ``day``.

    A change of a tracked column (null-safe) on a later day closes the current version the day before and opens a new one;
    on the day it began it is overwritten in place. A key's first version starts 1900-01-01."""
    today, end = F.lit(day).cast("date"), F.lit("9999-12-31").cast("date")
    src = source.select(key, *[F.col(c).alias(f"_{c}") for c in tracked], F.lit(True).alias("_in"))
    current = dim.filter("is_current").join(src, key, "left")
    same = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = F.col("_in").isNotNull() & ~same
    later = changed & (today > F.col("valid_from"))
    closed = current.select(key, *[F.when(changed & ~later, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in tracked], "valid_from", F.when(later, F.date_sub(today, 1)).otherwise(F.col("valid_to")).alias("valid_to"), (~F.coalesce(later, F.lit(False))).alias("is_current"))
    opened = current.filter(later).select(key, *[F.col(f"_{c}").alias(c) for c in tracked], today.alias("valid_from"), end.alias("valid_to"), F.lit(True).alias("is_current"))
    fresh = source.join(dim.select(key).distinct(), key, "left_anti").select(key, *tracked, F.lit("1900-01-01").cast("date").alias("valid_from"), end.alias("valid_to"), F.lit(True).alias("is_current"))
    return dim.filter("not is_current").select(*closed.columns).unionByName(closed).unionByName(opened).unionByName(fresh)


def check_scd2(dim: DataFrame, key: str) -> DataFrame:
    """Keys that break a rule: not exactly one current row, an interval that ends before it starts, or an overlap."""
    w = Window.partitionBy(key).orderBy("valid_from")
    seen = dim.withColumn("_next", F.lead("valid_from").over(w))
    bad = seen.groupBy(key).agg(F.count_if("is_current").alias("current_rows"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("reversed"), F.count_if(F.col("_next") <= F.col("valid_to")).alias("overlaps"))
    return bad.filter("current_rows <> 1 or reversed > 0 or overlaps > 0")


@dataclass(frozen=True)
class Staged:
    """A table that is written but not published."""

    path: str
    table: DataFrame


class Conflict(RuntimeError):
    """Another run was published meanwhile."""


class Versions:
    """Tables published together: data under <root>/<table>/v=<id>, named by the commits under <root>/_manifest, one file a
    sequence number. The greatest number is current. A commit's file is made only if none has its number, so of two
    writers that read the same state one wins and the other changes nothing; a failed audit leaves what was published
    before. A commit that cannot be read is an error, never an empty state."""

    SCHEMA = "seq long, run string, table string, path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(self.SCHEMA).option("mode", "FAILFAST").json(f"{self.root}/_manifest")
        except AnalysisException as error:  # nothing has been published yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        try:
            if not rows.filter("seq is null or run is null or table is null or path is null").isEmpty():
                raise ValueError(f"malformed manifest under {self.root}: a field is missing")
        except (PySparkException, Py4JJavaError) as error:
            raise ValueError(f"malformed manifest under {self.root}") from error
        return rows

    def sequence(self) -> int:
        manifest = self._manifest()
        return 0 if manifest is None else manifest.agg(F.max("seq")).first()[0] or 0

    def path(self, table: str) -> str | None:
        """Where the current version of ``table`` lies."""
        manifest = self._manifest()
        row = None if manifest is None else manifest.filter(F.col("table") == table).orderBy(F.desc("seq")).first()
        return None if row is None else row["path"]

    def read(self, table: str) -> DataFrame | None:
        path = self.path(table)
        return None if path is None else self.spark.read.parquet(path)

    def is_published(self, run: str) -> bool:
        manifest = self._manifest()
        return manifest is not None and not manifest.filter(F.col("run") == run).isEmpty()

    def stage(self, name: str, df: DataFrame) -> Staged:
        """Write the next version of a table without publishing it."""
        path = f"{self.root}/{name}/v={uuid.uuid4().hex}"
        df.write.parquet(path)
        return Staged(path, self.spark.read.schema(df.schema).parquet(path))

    def publish(self, run: str, tables: dict[str, DataFrame | Staged], audit=None, since: int | None = None) -> int:
        """Write, audit, publish. ``audit(staged)`` gets the written tables and raises to refuse. A run that is already
        published is skipped, so a replayed batch changes nothing, and so is one without tables. ``since``: the sequence
        number that the tables were made from, now if none is given; Conflict is raised if another followed it."""
        seq = self.sequence() if since is None else since
        if self.is_published(run) or not tables:
            return self.sequence()
        staged = {name: t if isinstance(t, Staged) else self.stage(name, t) for name, t in tables.items()}
        if audit:
            audit({name: t.table for name, t in staged.items()})
        if self.sequence() != seq:
            raise Conflict("another run was published meanwhile")
        self._commit(seq + 1, "".join(json.dumps({"seq": seq + 1, "run": run, "table": n, "path": t.path}) + "\n" for n, t in staged.items()))
        return seq + 1

    def _commit(self, seq: int, lines: str) -> None:
        """Make the commit's file, or raise Conflict if its number is taken."""
        path = f"{self.root}/_manifest/{seq:012d}.json"
        if path.startswith("file:") or "://" not in path:
            local = pathlib.Path(re.sub("^file:(//)?", "", path))
            local.parent.mkdir(parents=True, exist_ok=True)
            try:
                with local.open("x", encoding="utf-8") as out:
                    out.write(lines)
            except FileExistsError as error:
                raise Conflict("another run was published meanwhile") from error
            return
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = store.create(where, False)
        except Py4JJavaError as error:
            if store.exists(where):
                raise Conflict("another run was published meanwhile") from error
            raise
        try:
            out.write(bytearray(lines, "utf-8"))
        finally:
            out.close()
