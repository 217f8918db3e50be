"""Shared-storage helpers: cut lineage with written tables, broadcast only what is known to be small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a written table may be broadcast; a table that grows past them joins by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Whether the shuffle files of a query go when it ends; else they wait until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where it is unset, a temporary one is set if driver
    and executors are one process; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='martline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back: the plan above restarts from files,
    so a lost executor costs a re-read and never the work below. What the write shuffled is read by nothing else and goes
    with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more; other frames are left alone."""
    if path := getattr(table, "_written_to", None):
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, beyond its place in the row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType))
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda acc, x: acc + 8 + _bytes(x, kind.elementType).cast("long"))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) + 8 for f in kind), F.lit(16))
    else:
        return F.lit(0)
    return F.coalesce(size, F.lit(0)).cast("long")


def held_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) + 8 for f in df.schema), F.lit(32))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` (already materialised) for broadcast if its rows take at most ``most`` bytes;
    beyond that it is returned as it is and the join shuffles."""
    return F.broadcast(df) if held_bytes(df) <= most else df
