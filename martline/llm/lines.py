"""Fuzzy line dedup by MinHash signatures of character shingles.

A line is the text between newlines. Lines are linked where the Jaccard coefficient of their sets of ``WIDTH``-character
shingles is at least 0.8; of every component of links the first line (least id, then place) stays and the others are
removed from their documents. Equal lines are one node from the start, known by 64 bits of their hash. Signatures come
from ``sketch``, are cut into BANDS bands of ROWS values (a pair at 0.8 is missed with a chance of 1 in 560, one at 0.9 of
1 in 45,000), candidates are verified on their full sets and components found as in ``links``.

Defined cases: a null text stays null and an empty one empty; lines without a word (blank) are never removed; a line
shorter than a shingle is its own one shingle; a document whose every line with a word was removed keeps its blank lines
(n_kept is 0); rows with the same id, or without one, are documents of their own, each cleaned by its own lines, in the
order of their ``rowkey``; null ids come last; an empty table gives an empty result.
Other columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.llm import links, sketch
from martline.llm.neardup import as_lists
from martline.llm.rowkey import KEY, carried, keyed, renamed, same
from martline.llm.text import WS
from martline.plans.storage import broadcast_if_small, materialize

WIDTH, PERCENT = 8, 80
BANDS, ROWS = 12, 4
#: Code points of lines that are sketched together, and lines that a task remembers.
CHUNK, SEEN = 1 << 18, 1 << 19


def _key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]):
    """(keys, places, lines) of slices of the lines with a word in batches of the key and the text."""
    for batch in batches:
        owner, places, lines = [], [], []
        total = 0
        keys = batch.select(list(KEY))
        for at, text in enumerate(batch.column("text").to_pylist()):
            for place, line in enumerate((text or "").split("\n")):
                if line.strip(WS):
                    owner.append(at)
                    places.append(place)
                    lines.append(line)
                    total += len(line)
                    if total >= CHUNK:
                        yield keys.take(pa.array(owner)), places, lines
                        owner, places, lines, total = [], [], [], 0
        if lines:
            yield keys.take(pa.array(owner)), places, lines


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a line that this task has met before needs no bands again: its node has them
        seen: set[int] = set()
        for keyed_by, places, lines in _lines(batches):
            nodes = [_key(x) for x in lines]
            has = np.zeros(len(lines), bool)
            for i, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    has[i] = True
            if len(seen) > SEEN:
                seen.clear()
            new = [lines[i] for i in np.flatnonzero(has)]
            elements, owner = sketch.char_shingles(new, width)
            keys = np.zeros((len(lines), bands), np.int64)
            keys[has] = sketch.bands(sketch.sketch(elements, owner, len(new), bands * rows), rows)
            yield pa.RecordBatch.from_arrays(
                [*keyed_by.columns, pa.array(places, pa.int32()), pa.array(nodes, pa.int64()), as_lists(keys, has)],
                names=[*KEY, "place", "node", "bands"],
            )

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, content) of the lines at the given places, from batches of (text, places)."""
    for batch in batches:
        lines = []
        for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            split = (text or "").split("\n")
            lines += [split[k] for k in places if k < len(split)]
        yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in lines], pa.int64()), pa.array(lines, pa.string())], names=["id", "content"])


def _unpack(width: int):
    def unpack(contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines, parts = contents.to_pylist(), []
        for a, b in sketch.chunks([len(x) for x in lines], CHUNK):
            elements, owner = sketch.distinct(*sketch.char_shingles(lines[a:b], width), b - a)
            parts.append((elements, owner + a))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    return unpack


def _contents(docs: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, content) of the lines in ``ids``, each read where it first stands."""
    first = found.select("node", *KEY, "place").join(broadcast_if_small(ids), found["node"] == ids["id"]).groupBy("node").agg(F.min(F.struct(*KEY, "place")).alias("at"))
    places = first.select("at.*").groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    places = broadcast_if_small(materialize(renamed(places), "line-places"))
    return docs.join(places, same(docs, places)).select("text", "places").mapInArrow(_texts, "id long, content string")


def dedup_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text cleaned, and n_lines and n_kept (lines with a word before and after), which
    replace columns of these names."""
    return carried(docs, ["doc_id", "text"], ["n_lines", "n_kept"], lambda own: _cleaned(own, width, percent, bands, rows))


def _cleaned(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    own, docs = docs.columns, keyed(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *KEY[1:], "text")
    found = materialize(texts.mapInArrow(_sketched(width, bands, rows), "doc_id long, row_hash long, row_nth long, place int, node long, bands array<long>"), "line-sketches")
    members = links.shared_buckets(found.select(F.explode("bands").alias("bucket"), F.col("node").alias("id")))
    contents = materialize(_contents(texts, found, materialize(members.select("id").distinct(), "line-candidates")), "line-texts")
    labels = materialize(links.connect(members, contents, _unpack(width), percent), "line-labels")
    few = broadcast_if_small(labels)
    node = found.select(*KEY, "place", "node").join(few, found["node"] == few["id"], "left").select(*KEY, "place", F.coalesce("component", "node").alias("node"))
    # null ids come last: the flag leads the order
    at = F.struct(F.col("doc_id").isNull().alias("none"), *KEY, "place")
    first = node.groupBy("node").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", "at")
    gone = node.join(broadcast_if_small(materialize(first, "line-firsts")), "node").filter(~at.eqNullSafe(F.col("at")))
    gone = renamed(materialize(gone.groupBy(*KEY).agg(F.collect_set("place").alias("_gone")), "line-removals"))
    worded = lambda x: F.btrim(x, F.lit(WS)) != ""
    # what goes grows with the documents, in rows of no fixed length: never broadcast, at any size
    out = docs.join(gone.hint("merge"), same(docs, gone), "left")
    out = out.withColumn("_lines", F.split("text", "\n", -1)).withColumn("n_lines", F.coalesce(F.size(F.filter("_lines", worded)), F.lit(0)).cast("long"))
    out = out.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i))))
    out = out.withColumn("n_kept", F.coalesce(F.size(F.filter("_left", worded)), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n")))
    return out.select(*own, "n_lines", "n_kept")
