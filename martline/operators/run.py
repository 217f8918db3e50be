"""One daily run over published versions: extract, clean, check, load, report, refresh, checkpoint.

Each dataset of a run is read once. Its rows are written with their places and the codes of their rules, then once more
with those of duplicate keys, foreign keys and chronology; counts, quarantine, upsert, marks, children and the mart read
these tables. Rejects and the report are written before anything is published, so a run that dies in between is simply
run again. Tables, marks, ledger, audit, fingerprints and the log of the run are one commit.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Collection
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martline.operators import quality as dq
from martline.operators import relational as rel
from martline.operators import state
from martline.plans.storage import materialize
from martline.sources import files
from martline.sources.files import ARRIVAL, write_rejects, write_report

MASTERS = ("customers", "products")
LOG = "run_id string, source string, batch string, status string, started_at timestamp, finished_at timestamp"


@dataclass(frozen=True)
class Dataset:
    """What a run knows of a dataset. ``references``: (column, dataset, its key, code) of each foreign key. ``mark``: None
    if its rows never move a mark. ``required``: the columns a batch must have, all of them if None. ``after``: (column,
    dataset, its key, its column, code): an instant that must not lie before that of the row's parent. ``renames``: names of
    the source that are others in the core tables; they are changed before anything is checked."""

    columns: list[str]
    keys: list[str]
    rules: list[dq.Rule] = field(default_factory=list)
    references: list[tuple[str, str, str, str]] = field(default_factory=list)
    mark: str | None = "updated_at"
    required: list[str] | None = None
    after: tuple[str, str, str, str, str] | None = None
    renames: dict[str, str] = field(default_factory=dict)


def check_shape(contract: dict[str, Dataset], frames: dict[str, DataFrame], versions: state.Versions) -> None:
    """Raises ValueError, before a row is read, that names datasets without contract, every required column that is missing,
    unknown columns, and parents that neither come nor were published."""
    if strange := [n for n in frames if n not in contract]:
        raise ValueError(f"unknown datasets: {', '.join(strange)}")
    for name, frame in frames.items():
        spec = contract[name]
        needed = spec.columns if spec.required is None else spec.required
        if missing := [c for c in needed if c not in frame.columns]:
            raise ValueError(f"{name}: missing columns: {', '.join(missing)}")
        state.guard_columns(frame.columns, spec.columns, spec.keys, name)
        parents = {r[1] for r in spec.references} | ({spec.after[1]} if spec.after else set())
        if absent := sorted(p for p in parents if p not in frames and versions.path(p) is None):
            raise ValueError(f"{name}: no table of {', '.join(absent)}")


def _judged(spec: Dataset, frame: DataFrame, parent: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of a dataset, with arrival and error_code (null: valid), written. Keys are judged among rows that no rule
    rejects, parents among the first rows of their key."""
    if ARRIVAL not in frame.columns:
        frame = frame.withColumn(ARRIVAL, F.monotonically_increasing_id())
    tagged = materialize(dq.tag(frame, spec.rules), "tagged")
    passed = tagged.filter("error_code is null")
    first = passed.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(spec.keys)]).agg(F.min(ARRIVAL).alias("_first"))
    on = F.lit(True)
    for n, k in enumerate(spec.keys):
        on = on & passed[k].eqNullSafe(F.col(f"_k{n}"))
    again = passed.join(first, on).withColumn("_again", F.col(ARRIVAL) != F.col("_first")).drop("_first", *[f"_k{n}" for n in range(len(spec.keys))])
    later = again.filter("_again").drop("_again").withColumn("error_codes", F.array(F.lit("DUPLICATE_PRIMARY_KEY")))
    unique = again.filter("not _again").drop("_again")
    for column, name, key, code in spec.references:
        unique = dq.foreign_key(unique, column, parent(name), key, code)
    if spec.after:
        at, name, key, since, code = spec.after
        link = next(r[0] for r in spec.references if r[1] == name)
        told = parent(name).select(F.col(key).alias(link), F.col(since).alias(f"_{since}"))
        unique = dq.chronology(unique, told, link, at, f"_{since}", code)
    every = tagged.filter("error_code is not null").unionByName(later).unionByName(unique)
    joined = F.when(F.size("error_codes") > 0, F.array_join("error_codes", "|"))
    return materialize(every.withColumn("error_code", joined).drop("error_codes"), "judged")


def run(
    spark: SparkSession, run_id: str, frames: dict[str, DataFrame], contract: dict[str, Dataset], versions: state.Versions, quarantine: str,
    clean: Callable[[str, DataFrame], DataFrame] = lambda n, d: d, mart: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None,
    move_marks: bool | Collection[str] = True, source: str = "file", batch: str | None = None, audit: Callable[[dict[str, DataFrame]], None] | None = None,
) -> DataFrame:
    """Load the frames of one run, parents before children as ``contract`` lists them, and return its audit rows (run_id,
    dataset, input, valid, rejected, inserted, updated).

    Rows failing a rule, later rows of a key in the order of arrival, and orphans (of what is published or valid in this
    batch) go to quarantine. All tables, marks, mart tables and the audit are published together or, if any check fails, not
    at all; a run that is already published changes nothing and returns its audit. A dataset without valid rows keeps its
    version. ``move_marks``: whether, or of which datasets, the valid rows move the mark. ``batch`` enters the ledger of
    batches. ``audit`` gets the written tables and may refuse them."""
    if versions.is_published(run_id):
        return versions.read("run_audit").filter(F.col("run_id") == run_id)
    began, since = datetime.datetime.now(datetime.timezone.utc), versions.sequence()
    frames = {n: clean(n, frame).withColumnsRenamed(contract[n].renames if n in contract else {}) for n, frame in frames.items()}
    check_shape(contract, frames, versions)
    staged: dict[str, state.Staged] = {}

    def current(name: str) -> DataFrame | None:
        return staged[name].table if name in staged else versions.read(name)

    rejects, marks, counts, prints = {}, [], [], []
    for name, spec in ((n, s) for n, s in contract.items() if n in frames):
        judged = _judged(spec, frames[name], current)
        valid, rejects[name] = judged.filter("error_code is null").drop("error_code"), judged.filter("error_code is not null").drop(ARRIVAL)
        seen = judged.agg(F.count(F.lit(1)).alias("n"), F.count("error_code").alias("bad"), F.count_if(F.col("error_code").isNull() & F.greatest(*[F.col(k).isNull() for k in spec.keys], F.lit(False))).alias("keyless")).first()
        if seen["keyless"]:
            raise ValueError(f"{name}: null key: {', '.join(spec.keys)}")
        old, inserted, updated = versions.read(name), 0, 0
        came = [c for c in frames[name].columns if c != ARRIVAL]
        if old is None or seen["n"] > seen["bad"]:
            target = old if old is not None else valid.select(*came, *[F.lit(None).cast("string").alias(c) for c in spec.columns if c not in came]).select(*spec.columns).limit(0)
            following = materialize(state.upsert(target, valid.select(*came, ARRIVAL), spec.keys), "following")
            ops = {r["_op"]: r["count"] for r in following.groupBy("_op").count().collect()}
            inserted, updated = ops.get("insert", 0), ops.get("update", 0)
            staged[name] = versions.stage(name, following.drop("_op"))
        counts.append((run_id, name, seen["n"], seen["n"] - seen["bad"], seen["bad"], inserted, updated))
        print_of = rel.fingerprint(current(name), spec.keys[0])
        prints.append(print_of.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("dataset"), "*"))
        if spec.mark and (move_marks is True or move_marks is not False and name in move_marks):
            marks.append(files.high_watermark(valid).filter("watermark is not null").select(F.lit(name).alias("resource"), "watermark"))

    tables: dict[str, DataFrame | state.Staged] = dict(staged)
    if mart:
        tables |= mart({n: t for n in contract if (t := current(n)) is not None})
    if marks:
        before = versions.read("watermarks")
        moved = marks[0]
        for more in marks[1:]:
            moved = moved.unionByName(more)
        tables["watermarks"] = state.advance(before if before is not None else moved.limit(0), moved)
    audited = spark.createDataFrame(counts, "run_id string, dataset string, input long, valid long, rejected long, inserted long, updated long").coalesce(1)
    tables["run_audit"] = _with_past(versions, "run_audit", audited)
    if prints:
        told = prints[0]
        for more in prints[1:]:
            told = told.unionByName(more)
        tables["fingerprints"] = _with_past(versions, "fingerprints", told.coalesce(1))
    if batch is not None:
        tables["file_batches"] = _with_past(versions, "file_batches", spark.createDataFrame([(batch,)], "batch string")).distinct().coalesce(1)

    def checked(written: dict[str, DataFrame]) -> None:
        for name in staged:
            if not written[name].groupBy(*contract[name].keys).count().filter("count > 1").isEmpty():
                raise ValueError(f"{name}: duplicate keys")
        if audit:
            audit(written)

    for name, rows in rejects.items():
        write_rejects(rows, quarantine, run_id, name, "overwrite")
    stats = audited.select("dataset", "input", "valid", "rejected")
    write_report(dq.report(stats, run_id).drop("run_id"), f"{quarantine}/reports", run_id, "overwrite")
    log = spark.createDataFrame([(run_id, source, batch, "success", began, datetime.datetime.now(datetime.timezone.utc))], LOG)
    tables["run_log"] = _with_past(versions, "run_log", log).coalesce(1)
    versions.publish(run_id, tables, checked, since)
    return versions.read("run_audit").filter(F.col("run_id") == run_id)


def _with_past(versions: state.Versions, table: str, rows: DataFrame) -> DataFrame:
    past = versions.read(table)
    return rows if past is None else past.unionByName(rows)


def marks_of(versions: state.Versions) -> dict[str, datetime.datetime]:
    """resource -> its mark, an instant. A row without resource or mark is an error."""
    table = versions.read("watermarks")
    rows = [] if table is None else table.select("resource", "watermark").collect()
    if any(r["resource"] is None or not isinstance(r["watermark"], datetime.datetime) for r in rows):
        raise ValueError("malformed watermarks")
    return {r["resource"]: r["watermark"] for r in rows}


def daily(
    spark: SparkSession, run_id: str, mode: str, contract: dict[str, Dataset], versions: state.Versions, quarantine: str, raw: str,
    paths: dict[str, str] | None = None, api: Callable[[str, datetime.datetime | None], DataFrame] | None = None, batch: str | None = None,
    skip_processed: bool = False, masters: tuple[str, ...] = MASTERS, **how,
) -> tuple[str, DataFrame | None]:
    """(status, audit) of a run from its sources: success, or skipped if its whole input is a batch of the ledger.

    ``file``: all datasets from ``paths``; ``api``: what ``api(resource, mark)`` landed after each mark; ``both``: masters from
    files, the rest from the api. Each increment is stored under ``raw`` first, one without rows too, and read from there.
    With ``skip_processed`` a batch that the ledger has is not read again: in ``both`` masters come without rows and the api
    goes on. Only valid rows of the api move marks; only files enter the ledger."""
    if mode not in ("file", "api", "both"):
        raise ValueError(f"unknown source: {mode}")
    ledger = versions.read("file_batches")
    done = skip_processed and batch is not None and ledger is not None and not ledger.filter(F.col("batch") == batch).isEmpty()
    if mode == "file" and done:
        return "skipped", None
    marks, frames, landed = marks_of(versions), {}, []
    for name, spec in contract.items():
        needed = spec.columns if spec.required is None else spec.required
        if mode == "file" or mode == "both" and name in masters:
            none = spark.createDataFrame([], ", ".join(f"{c} string" for c in needed)) if done else None
            # a CSV comes with the columns of its header, so that missing and unknown ones can be told
            back = {core: source for source, core in spec.renames.items()}
            named = None if paths[name].endswith(".csv") else [back.get(c, c) for c in spec.columns]
            frames[name] = none if done else files.read_dataset(spark, paths[name], named, arrival=True)
        else:
            mark = marks.get(name)
            if not files.raw_stored(spark, raw, run_id, name):  # else a run that died is going on
                files.save_raw(api(name, mark), raw, run_id, name, mark.isoformat() if mark else None)
            frames[name] = files.read_raw(spark, raw, run_id, name)
            landed.append(name)
    entered = batch if mode in ("file", "both") else None
    return "success", run(spark, run_id, frames, contract, versions, quarantine, move_marks=landed, source=mode, batch=entered, **how)


def replay(spark: SparkSession, raw: dict[str, DataFrame] | str, run_id: str, **how) -> DataFrame:
    """Rebuild from a stored raw snapshot (its frames, or the folder that ``daily`` stored it in): the same run over its
    rows, which moves no mark."""
    if isinstance(raw, str):
        contract = how["contract"]
        stored = files.raw_resources(spark, raw, run_id)
        if not stored:
            raise ValueError(f"no raw snapshot of run {run_id}")
        raw = {n: files.read_raw(spark, raw, run_id, n) for n in contract if n in stored}
    return run(spark, f"replay-{run_id}", raw, source="replay", **how | {"move_marks": False})


def replay_check(versions: state.Versions, run_id: str) -> DataFrame:
    """(dataset, inserted, updated, valid, same_content, idempotent) of the last replay of a run against the run: a replay
    inserts nothing, updates what came, and leaves every table as the run had left it."""
    name = f"replay-{run_id}"
    audit, prints = versions.read("run_audit"), versions.read("fingerprints")
    of = lambda rid, tag: prints.filter(F.col("run_id") == rid).select("dataset", F.struct("n_rows", "n_keys", "digest").alias(tag))
    both = audit.filter(F.col("run_id") == name).join(of(run_id, "was"), "dataset", "left").join(of(name, "now"), "dataset", "left")
    same = F.coalesce(F.col("was") == F.col("now"), F.lit(False))
    return both.select("dataset", "inserted", "updated", "valid", same.alias("same_content"), ((F.col("inserted") == 0) & (F.col("updated") == F.col("valid")) & same).alias("idempotent"))
