"""A key of every row of a table of documents, so that each row meets its own verdict and not that of its id.

Where an id stands once, the key is the id with two zeros. Rows that share an id (or have none) are told apart by the
hash of their text, and full repeats by an ordinal that is 0 for one of them. Such rows are written to the shared folder
with their ordinals, so that every plan over them reads the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martline.plans.storage import broadcast_if_small, materialize

KEY = ("doc_id", "row_hash", "row_nth")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with row_hash and row_nth: together with doc_id no two rows have the same."""
    zeros = {"row_hash": F.lit(0).cast("long"), "row_nth": F.lit(0).cast("long")}
    shared = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id")), "shared-ids")
    if shared.isEmpty():
        return docs.withColumns(zeros)
    shared = broadcast_if_small(shared)
    on = docs["doc_id"].eqNullSafe(shared["_id"])
    many = docs.join(shared, on, "left_semi").withColumns({"row_hash": F.xxhash64("text"), "row_nth": F.monotonically_increasing_id()})
    many = materialize(many, "shared-rows")
    first = many.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(F.min("row_nth").alias("_first"))
    first = broadcast_if_small(materialize(first, "shared-firsts"))
    many = many.join(first, many["doc_id"].eqNullSafe(first["_id"]) & (many["row_hash"] == first["_hash"])).withColumn("row_nth", F.col("row_nth") - F.col("_first"))
    return docs.join(shared, on, "left_anti").withColumns(zeros).unionByName(many.select(*docs.columns, "row_hash", "row_nth"))


def renamed(keys: DataFrame) -> DataFrame:
    """``keys`` with the columns of the key under names of their own, for a join by ``same``."""
    return keys.withColumnsRenamed({k: f"_key_{k}" for k in KEY})


def same(rows: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of ``rows`` has the key of one of ``keys`` (as of ``renamed``)."""
    return rows["doc_id"].eqNullSafe(keys["_key_doc_id"]) & (rows["row_hash"] == keys["_key_row_hash"]) & (rows["row_nth"] == keys["_key_row_nth"])


CARRIED = "_carried"


def carried(docs: DataFrame, used: list[str], made: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` makes of the columns ``used``, with the other columns of ``docs`` as they were, whatever their names.

    The operator gets the used columns and one struct of all others, so that no name of its own can clash; it returns the
    struct with the used columns and those in ``made``. Columns of ``docs`` with a name in ``made`` are replaced."""
    own = {c.lower() for c in used}
    rest = [c for c in docs.columns if c.lower() not in own]
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("boolean").alias("none"))
    out = operator(docs.select(*used, others.alias(CARRIED)))
    new = {c.lower() for c in made}
    kept = [c for c in docs.columns if c.lower() not in new and c.lower() in {x.lower() for x in out.columns} | {x.lower() for x in rest}]
    return out.select(*[F.col(c) if c.lower() in own else F.col(CARRIED)[c].alias(c) for c in kept], *made)
