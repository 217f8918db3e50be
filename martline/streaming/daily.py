"""Arriving files through the firewall into published tables, as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from martline.operators import quality as dq
from martline.operators.state import Versions, upsert
from martline.sources.files import write_rejects


def run_batch(spark: SparkSession, batch: DataFrame, run_id: str, versions: Versions, table: str, keys: list[str], rules: list[dq.Rule], quarantine: str, clean: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict:
    """Clean, tag, split, quarantine, upsert and publish one batch; a run already published changes nothing."""
    tagged = dq.tag(clean(batch), rules).persist()
    try:
        valid, rejected = dq.split(tagged)
        counts = {"input": tagged.count(), "valid": valid.count(), "rejected": rejected.count()}
        target = versions.read(table)
        following = upsert(target if target is not None else valid.limit(0), valid, keys).drop("_op")

        def audit(staged: dict[str, DataFrame]) -> None:
            if not staged[table].groupBy(*keys).count().filter("count > 1").isEmpty():
                raise ValueError(f"{table}: duplicate keys")

        # rejects first: a batch that dies before it is published is run again, one that is published is not
        if not versions.is_published(run_id):
            write_rejects(rejected, quarantine, run_id, table, "overwrite")
        if counts["valid"]:
            versions.publish(run_id, {table: following}, audit)
        return counts
    finally:
        tagged.unpersist()


def stream_daily(spark: SparkSession, incoming: str, schema: str, checkpoint: str, versions: Versions, table: str, keys: list[str], rules: list[dq.Rule], quarantine: str) -> StreamingQuery:
    """Process the CSV files that have arrived, each once; batch ids name the runs, so a replayed batch is skipped."""
    source = spark.readStream.schema(schema).option("header", True).csv(incoming)
    each = lambda df, n: run_batch(spark, df, f"batch-{n}", versions, table, keys, rules, quarantine)
    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
