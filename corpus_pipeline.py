"""The corpus pipeline: documents through the stages of STAGES, each rereading what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martline.llm import bpe, lines, mixing, neardup, quality
from martline.llm.queries import PATTERN, RANKS
from martline.llm.rowkey import KEY, keyed, renamed, same
from martline.plans.storage import broadcast_if_small, materialize, shared_dir


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (of ``keyed``) but for the keys in ``gone``, which is written first so that its size decides
    how it is joined; without the key."""
    gone = broadcast_if_small(materialize(renamed(gone.select(*KEY)), "gone"))
    return docs.join(gone, same(docs, gone), "left_anti").drop(*KEY[1:])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by its own verdict."""
    docs = keyed(docs)
    judged = quality.judge(docs.select(*KEY, "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.filter("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; those of which no line with a word stays are copies, and go."""
    cleaned = lines.dedup_lines(docs)
    return cleaned.filter("n_lines = 0 or n_kept > 0").withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (shingles of five words)."""
    docs = keyed(docs)
    return _without(docs, neardup.verdicts(docs).filter("not kept"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each row by its own copies."""
    rows = keyed(docs)
    mixed = materialize(mixing.mix(rows), "mixed")
    return mixing.expand(rows, mixed).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (unsigned little-endian 32-bit), their number and the digest of the decoded text."""
    coded = bpe.code(docs.select("doc_id", "source", "text"), RANKS, PATTERN)
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("encode", encode)]
#: The stages go through MinHash and a tokenizer, which SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{n}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{n}-{name}")
    return docs
