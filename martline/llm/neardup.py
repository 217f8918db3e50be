"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set are the hashes of its word shingles; documents are linked where the Jaccard coefficient of their full
sets is at least ``percent``, and every component keeps one row, that of least id. Equal sets are one class from the start
and copies are never compared; classes are sketched (see ``sketch``), the sketches cut into bands, and classes that share
a band are candidates: at a coefficient of 0.8 a pair is missed with a chance of (1 - 0.8 ** ROWS) ** BANDS, 1 in 14,000,
less at higher ones. Candidates are verified on their full sets (see ``links``).

Words are runs of characters other than \\x20 and \\x09-\\x0D, A-Z lower-cased. Defined cases: null, empty and blank texts
have the empty set, are linked with nothing and kept; a text shorter than a shingle is one shingle; rows with the same id
are documents of their own, each linked by its own text, and of those of least id in a component one is kept (by its
``rowkey``); a null id counts only where no other id is in the component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.llm import links, sketch
from martline.llm.rowkey import KEY, keyed, renamed, same
from martline.plans.storage import broadcast_if_small, materialize

BANDS, ROWS = 24, 5
WIDTH, PERCENT = 5, 80


def _sets(texts: list, width: int):
    """(start, end, elements, owner) for slices of the texts: the distinct shingles of each."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for a, b in sketch.chunks([len(t) for t in raw]):
        elements, owner = sketch.word_shingles(raw[a:b], width)
        yield a, b, *sketch.distinct(elements, owner, b - a)


def digests(elements: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit digest of each set (int64), the same for the same elements in any order."""
    out = np.zeros(count, np.uint64)
    np.add.at(out, owner, sketch.mix(elements ^ np.uint64(0x5851F42D4C957F2D)))
    return sketch.mix(out + np.bincount(owner, minlength=count).astype(np.uint64)).view(np.int64)


def as_lists(keys: np.ndarray, has: np.ndarray) -> pa.ListArray:
    """The rows of ``keys`` as lists, empty where ``has`` is false."""
    ends = np.concatenate([[0], np.cumsum(np.where(has, keys.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].ravel()))


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keyed_by, texts = batch.select(list(KEY)), batch.column("text").to_pylist()
            for a, b, elements, owner in _sets(texts, width):
                n = np.bincount(owner, minlength=b - a)
                keys = sketch.bands(sketch.sketch(elements, owner, b - a, bands * rows), rows)
                yield pa.RecordBatch.from_arrays(
                    [*keyed_by.slice(a, b - a).columns, pa.array(n.astype(np.int64)), pa.array(digests(elements, owner, b - a)), as_lists(keys, n > 0)], names=[*KEY, "n_shingles", "node", "bands"]
                )

    return run


def _full(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, elements, owner in _sets(batch.column(0).to_pylist(), width):
                at = np.searchsorted(owner, np.arange(b - a + 1))
                sets = pa.array([elements[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(digests(elements, owner, b - a)), sets], names=["id", "content"])

    return run


def unpack(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(elements, owner) of sets kept as the bytes of their sorted hashes."""
    sizes = pa.compute.binary_length(contents).to_numpy(zero_copy_only=False) // 8
    return np.frombuffer(b"".join(contents.to_pylist()), np.uint64), np.repeat(np.arange(len(contents)), sizes)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return verdicts(keyed(docs.select("doc_id", "text")), width, percent, bands, rows).drop(*KEY[1:])


def verdicts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with the key of each row, of the rows of ``keyed``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *KEY[1:], "text")
    rows_ = materialize(docs.mapInArrow(_sketched(width, bands, rows), "doc_id long, row_hash long, row_nth long, n_shingles long, node long, bands array<long>"), "sketches")
    # the class of a set goes by the set's digest, and has the least key of its rows; null ids come last
    head = F.struct(F.col("doc_id").isNull().alias("none"), *KEY)
    classes = materialize(rows_.filter("n_shingles > 0").groupBy("node").agg(F.min(head).alias("head"), F.first("bands").alias("bands")), "classes")
    members = links.shared_buckets(classes.select(F.explode("bands").alias("bucket"), F.col("node").alias("id")))
    wanted = materialize(classes.select("node", "head").join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "candidates")
    few = broadcast_if_small(renamed(wanted.select("head.*").drop("none")))
    sets = docs.join(few, same(docs, few), "left_semi").select("text").mapInArrow(_full(width), "id long, content binary")
    labels = links.connect(members, materialize(sets, "sets"), unpack, percent)
    labels = materialize(labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct()), "labels")
    named = labels.join(classes.select(F.col("node").alias("id"), "head"), "id")
    named = named.join(named.groupBy("component").agg(F.min("head").alias("least")), "component").select(F.col("id").alias("node"), "least")
    classes = classes.join(broadcast_if_small(materialize(named, "named")), "node", "left").select("node", F.coalesce("least", "head").alias("least"))
    out = rows_.drop("bands").join(classes, "node", "left")
    empty = F.col("n_shingles") == 0
    own = F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select(*KEY, "n_shingles", own.alias("component_id"), (empty | head.eqNullSafe(F.col("least"))).alias("kept"))
