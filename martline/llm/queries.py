"""The queries of this subpackage: thin wrappers that give each operator its whole table and derive the result's columns."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martline.llm import bpe, chat, lines, mixing, neardup, periodic, quality, secrets, sharding, spelling, spotpairs, spotsigs, sql, toxicity, urlfilter
from martline.llm.text import words
from martline.plans.storage import materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = lambda d: spotsigs.with_fingerprint(d, "text", "fingerprint")
    both = spotsigs.with_next(docs, ["text", "fingerprint_set"], told=told)
    both = both.withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text"))).withColumn("n_chars", F.char_length("text").cast("long")).drop("text", "next_text")
    both = spotsigs.with_fingerprint(both, "edited", "edited_fingerprint")
    near_edited = spotsigs.likeness(F.col("fingerprint_set"), F.col("edited_fingerprint_set"))
    near_next = spotsigs.likeness(F.col("fingerprint_set"), F.col("next_fingerprint_set"))
    both = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near_edited.alias("near_edited"), near_next.alias("near_next"), "fingerprint_set",
    )
    named = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
    return spotpairs.classed(materialize(both, "spot-compared")).select(*named)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_back(*chat.build(conversations.unionByName(own)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


#: The rank file and the pattern of op8; a path of the machine that starts the query.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.code(_read(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    joined = found.select("doc_id", "n_assign", "n_access", "n_hex", secrets.written(F.col("base_spans")).alias("base"), secrets.written(F.col("spans")).alias("spans"))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = _read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    scored = toxicity.score(_read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    # every tenth document repeats p of its words from word a on
    w, h = words(F.col("text")), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size(w), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    told = F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    docs = docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), told).otherwise(F.col("text")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    found = periodic.find_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("group"))
    placed = sharding.assign(docs, F.col("group"), F.col("size"), F.col("doc_id"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def planted(doc_id: str, word: str) -> str:
    """The word, or for one in 199 (document, word) the word without one letter."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"), edit=planted)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_spotsigs": op2_spotsigs, "op3_line_dedup": op3_line_dedup, "op4_chat_tree": op4_chat_tree, "op5_near_dedup": op5_near_dedup, "op6_mixing": op6_mixing, "op7_url_filter": op7_url_filter, "op8_byte_bpe": op8_byte_bpe, "op9_secrets": op9_secrets, "op10_toxicity": op10_toxicity, "op11_periodic_runs": op11_periodic_runs, "op12_sharding": op12_sharding, "op13_spelling": op13_spelling}
ORACLES = {"op1_quality_rules": sql.OP1, "op2_spotsigs": sql.OP2, "op3_line_dedup": sql.OP3, "op4_chat_tree": sql.OP4, "op5_near_dedup": sql.OP5, "op6_mixing": sql.OP6, "op7_url_filter": sql.OP7, "op9_secrets": sql.OP9, "op13_spelling": sql.OP13}
