"""Files in and out: CSV, JSON and landed API pages, immutable raw snapshots, quarantine and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martline.operators import relational as rel
from martline.plans.storage import materialize


#: The column that tells when a row came: file, place of the block in it, place of the row. It is never loaded.
ARRIVAL = "_arrival"


def with_arrival(df: DataFrame) -> DataFrame:
    """``df``, read from files of lines, with its rows' places: files go by their paths, rows as they stand in them."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("*", place.alias(ARRIVAL))


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None, arrival: bool = False) -> DataFrame:
    """A CSV with header or a JSON list (or {"data": [...]}) as strings; ValueError for another suffix, no rows, or a JSON
    object without data. ``columns``: those of the file, in its order; None takes a CSV's from its header. ``arrival`` adds
    the rows' places in their files. ``path`` may have globs."""
    schema = columns and T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = with_arrival((reader.option("enforceSchema", False).schema(schema) if schema else reader).csv(path))
    elif path.endswith(".json") and not schema:
        raise ValueError(f"the columns of a JSON file must be named: {path}")
    elif path.endswith(".json"):
        df = _json_rows(spark, path, schema)
    else:
        raise ValueError(f"unsupported file type: {path}")
    if df.isEmpty():
        raise ValueError(f"no data: {path}")
    return df if arrival else df.drop(ARRIVAL)


def _json_rows(spark: SparkSession, path: str, item: T.StructType) -> DataFrame:
    """Rows of JSON files, each a list or an envelope, read once: as text, for the shape of each file to be told."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    body = F.btrim("value", F.lit(" \t\r\n\ufeff"))
    envelope = T.StructType([T.StructField("data", T.ArrayType(item))])
    listed = F.from_json(body, T.ArrayType(item), {"mode": "FAILFAST"})
    wrapped = F.from_json(body, envelope, {"mode": "FAILFAST"})["data"]
    refused = F.raise_error(F.concat(F.lit("no list and no data in "), F.col("file"))).cast(T.ArrayType(item))
    rows = F.when(body.startswith("["), listed).when(body.startswith("{"), F.coalesce(wrapped, refused)).otherwise(refused)
    each = text.select("file", F.posexplode(rows).alias("row", "item"))
    return each.select("item.*", F.struct("file", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")).alias(ARRIVAL))


def read_pages(spark: SparkSession, path: str, item: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, audit) of page envelopes {page, page_size, total, has_next, data}: the audit compares the rows with the total
    told, and tells the missing pages and whether the last page came."""
    envelope = T.StructType([T.StructField("page", T.LongType()), T.StructField("page_size", T.LongType()), T.StructField("total", T.LongType()), T.StructField("has_next", T.BooleanType()), T.StructField("data", T.ArrayType(item))])
    pages = spark.read.schema(envelope).option("multiLine", True).json(path)
    audit = pages.agg(F.max("total").alias("total"), F.sum(F.size("data")).alias("rows"), (F.max("page") - F.countDistinct("page")).alias("missing_pages"), F.bool_or(~F.col("has_next")).alias("complete"))
    return pages.select(F.inline("data")), audit


def save_raw(df: DataFrame, root: str, run_id: str, resource: str, updated_after: str | None = None) -> str:
    """An immutable snapshot, of no rows too; a second write of the same run and resource fails. Beside the rows (``data``)
    stands what they are: resource, run_id, fetched_at, updated_after, total, columns."""
    spark, path = df.sparkSession, f"{root}/run_id={run_id}/resource={resource}"
    df.write.mode("errorifexists").json(f"{path}/data")
    stored = spark.read.schema(df.schema).json(f"{path}/data")
    names = [F.lit(v).cast("string").alias(k) for k, v in (("resource", resource), ("run_id", run_id), ("updated_after", updated_after))]
    columns = F.array(*[F.lit(c) for c in df.columns]).alias("columns")
    about = stored.agg(F.count(F.lit(1)).alias("total")).select(*names, F.current_timestamp().alias("fetched_at"), "total", columns)
    about.coalesce(1).write.mode("errorifexists").json(f"{path}/about")
    return path


def read_raw(spark: SparkSession, root: str, run_id: str, resource: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a snapshot as strings with their places, with the columns that it was stored with unless others are
    named; ValueError if the run stored none of that resource, or if there are not as many rows as the snapshot says."""
    path = f"{root}/run_id={run_id}/resource={resource}"
    try:
        total, stored = spark.read.schema("total long, columns array<string>").json(f"{path}/about").first()
    except (AnalysisException, TypeError) as error:
        raise ValueError(f"no raw snapshot of {resource} in run {run_id}") from error
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or stored])
    rows = with_arrival(spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/data"))
    if (n := rows.count()) != total:
        raise ValueError(f"raw snapshot of {resource} in run {run_id} has {n} rows, not {total}")
    return rows


def raw_stored(spark: SparkSession, root: str, run_id: str, resource: str) -> bool:
    """Whether a run has a whole snapshot of the resource."""
    try:
        return not spark.read.schema("total long").json(f"{root}/run_id={run_id}/resource={resource}/about").isEmpty()
    except AnalysisException:
        return False


def raw_resources(spark: SparkSession, root: str, run_id: str) -> list[str]:
    """The resources that a run stored."""
    try:
        return sorted(r["resource"] for r in spark.read.schema("resource string").json(f"{root}/run_id={run_id}/resource=*/about").collect())
    except AnalysisException:
        return []


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change: added, removed or modified) between two tables of ``file_checksums``; no rows if nothing changed."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def write_rejects(df: DataFrame, root: str, run_id: str, dataset: str, mode: str = "errorifexists") -> bool:
    """Quarantine rows with their codes under run and dataset; nothing is written for none. ``mode`` overwrite is for a run
    that is tried again before anything of it was published."""
    if df.isEmpty():
        return False
    df.write.mode(mode).parquet(f"{root}/run_id={run_id}/dataset={dataset}")
    return True


STAMPS = ("updated_at", "created_at")


def _changed(df: DataFrame, columns: tuple[str, ...] = STAMPS):
    """When a row changed: the first of ``columns`` that it has a time in. A column of times is taken as it is, so that a
    filter on one alone reaches the files; text is parsed row by row."""
    kinds = dict(df.dtypes)
    told = [F.col(c) if kinds[c].startswith("timestamp") else F.try_to_timestamp(c) for c in columns if c in kinds]
    return told[0] if len(told) == 1 else F.coalesce(*told, F.lit(None).cast("timestamp"))


def high_watermark(df: DataFrame) -> DataFrame:
    """The latest of updated_at, else created_at, of each row, as an instant."""
    return df.agg(F.max(_changed(df)).alias("watermark"))


def incremental(df: DataFrame, watermark, columns: tuple[str, ...] = STAMPS) -> DataFrame:
    """Rows changed strictly after the watermark (a time or its text)."""
    kind = dict(df.dtypes).get(columns[0], "timestamp")
    return df.filter(_changed(df, columns) > F.lit(watermark).cast(kind if kind.startswith("timestamp") else "timestamp"))


def read_positional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose columns go by their place, whatever its header says; empty values are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("header", True).option("enforceSchema", True).option("nullValue", "").schema(schema).csv(path)


def source_frames(spark: SparkSession, mode: str, files: dict[str, str], api: dict[str, DataFrame], marks: dict[str, str], columns: dict[str, list[str]], masters: tuple[str, ...] = ("customers", "products")) -> dict[str, DataFrame]:
    """The datasets of a run. ``file``: all from files; ``api``: of each landed resource what changed after its mark; ``both``:
    masters from files, the others from the api. An empty increment is a frame without rows and with its columns."""
    if mode not in ("file", "api", "both"):
        raise ValueError(f"unknown source: {mode}")
    out = {}
    for name, needed in columns.items():
        if mode == "file" or mode == "both" and name in masters:
            out[name] = read_dataset(spark, files[name], needed)
        else:
            rows = api[name].select(*needed)
            out[name] = incremental(rows, marks[name]) if marks.get(name) else rows
    return out


def stage(frames: dict[str, DataFrame | Callable[[], DataFrame]], root: str, clean) -> dict[str, str]:
    """Read (where a frame comes as a function), profile, clean and write every dataset to staging; (dataset -> "ok" or the
    error). One that fails, in reading too, does not stop the others."""
    return {r["dataset"]: "ok" if r["status"] == "ok" else r["error"] for r in stage_outcomes(frames, root, clean)[0]}


def stage_outcomes(frames: dict[str, DataFrame | Callable[[], DataFrame]], root: str, clean) -> tuple[list[dict], bool]:
    """(outcomes, whether all went well). An outcome: dataset, status (ok or failed), error, rows, duplicates and missing
    (column -> how many), of what came in. Each dataset is read once, into staging as it came; a failed one leaves what
    staging had."""
    outcomes = []
    for name, frame in frames.items():
        told = {"dataset": name, "status": "ok", "error": None, "rows": None, "duplicates": None, "missing": {}}
        try:
            came = frame() if callable(frame) else frame
            came.write.mode("overwrite").parquet(f"{root}/_came/{name}")
            came = came.sparkSession.read.schema(came.schema).parquet(f"{root}/_came/{name}")
            seen = rel.profile(came).first()
            told |= {"rows": seen["n_rows"] or 0, "duplicates": seen["n_duplicates"] or 0, "missing": {c: seen[f"missing_{c}"] or 0 for c in came.columns}}
            clean(name, came).write.mode("overwrite").parquet(f"{root}/{name}")
        except Exception as error:  # told to the caller for each dataset
            told |= {"status": "failed", "error": f"{type(error).__name__}: {error}"}
        outcomes.append(told)
    return outcomes, all(o["status"] == "ok" for o in outcomes)


def write_outcomes(spark: SparkSession, outcomes: list[dict], root: str, run_id: str) -> DataFrame:
    """The outcomes of a batch as a table under its run; a failed dataset is a row there, not a gap."""
    kind = "dataset string, status string, error string, rows long, duplicates long, missing map<string, long>"
    path = f"{root}/_outcomes/run_id={run_id}"
    spark.createDataFrame(outcomes, kind).coalesce(1).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def stage_batch(spark: SparkSession, raw: str, paths: dict[str, str], columns: dict[str, list[str]], root: str, run_id: str, clean) -> tuple[DataFrame, bool]:
    """Stage the files of a batch; (outcomes, whether all went well). The files under ``raw`` are digested before and after:
    a batch during which one changed, came or went has not gone well, and that file is an outcome too."""
    before = materialize(file_checksums(spark, raw), "digests")
    frames = {name: lambda name=name: read_dataset(spark, paths[name], columns[name]) for name in paths}
    outcomes, well = stage_outcomes(frames, root, clean)
    changed = changed_files(before, file_checksums(spark, raw)).collect()
    none = {"rows": None, "duplicates": None, "missing": {}}
    outcomes += [{"dataset": r["path"], "status": "failed", "error": f"raw file {r['change']} during the batch"} | none for r in changed]
    return write_outcomes(spark, outcomes, root, run_id), well and not changed


def write_report(report: DataFrame, root: str, run_id: str, mode: str = "errorifexists") -> None:
    """A report of a few rows as one CSV and one JSON file; money keeps two places."""
    money = [F.col(f.name).cast("decimal(20,2)").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in report.schema]
    rows = report.select(*money).coalesce(1)
    rows.write.mode(mode).option("header", True).csv(f"{root}/run_id={run_id}/csv")
    rows.write.mode(mode).json(f"{root}/run_id={run_id}/json")
