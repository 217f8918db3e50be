"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A task cuts its texts into pieces by the tokenizer's pattern and encodes every piece that it has not met before: the rows
(piece, position, token) of a batch of pieces go through a recursive query that joins neighbouring tokens to the merge
table and contracts the leftmost pair of least rank of every piece, until no piece has a pair to merge; a piece without
one leaves the recursion. Documents are then put together from their pieces. Ids are decoded by a join with the
vocabulary and an aggregation in the order of their places.

The merge table holds each way to cut a vocabulary entry into two others; its rank is the entry's. A piece that is an
entry itself is that entry. A query keeps the rows of all its steps, so it makes at most as many steps as hold
``STEP_ROWS`` rows, and pieces that still have a pair go into the next one: memory is bounded for pieces of any length,
while the time of one of n bytes grows with n * n.

Defined cases: a null text is empty, an empty text has no ids and decodes to no bytes; no special tokens: their strings
are ordinary text; bytes that no entry covers cannot occur, as a byte-level vocabulary has all 256; repeated rows and ids
each get their result; other columns are carried unchanged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from martline.llm import sketch

#: Bytes of pieces in a query (or one longer piece), rows that its steps hold, and pieces that a worker remembers.
BATCH, STEP_ROWS, MEMORY = 1 << 19, 1 << 22, 250_000
#: Code points of texts that are coded together.
CHUNK = 1 << 21

MERGE = """
WITH RECURSIVE steps(n, piece, pos, token, rank, best) AS (
    SELECT 0, piece, pos, token, rank, min(rank << 32 | pos) OVER (PARTITION BY piece)
    FROM (SELECT piece, pos, token, lead(token) OVER (PARTITION BY piece ORDER BY pos) AS following FROM start) LEFT JOIN merges ON token = a AND following = b
    UNION ALL
    (WITH merged AS MATERIALIZED (
        SELECT n, piece, pos, CASE WHEN here THEN made ELSE token END AS token, CASE WHEN here OR there THEN fresh.rank ELSE old.rank END AS rank
        FROM (
            SELECT n + 1 AS n, piece, pos, token, rank, best & 4294967295 AS spot, (best >> 32)::INT AS made, lag(pos) OVER w AS before,
                pos = spot AS here, coalesce(lead(pos) OVER w = spot, false) AS there, lead(token, 2) OVER w AS after
            FROM steps WHERE best IS NOT NULL AND n < $steps WINDOW w AS (PARTITION BY piece ORDER BY pos)
        ) old LEFT JOIN merges fresh ON fresh.a = CASE WHEN here THEN made WHEN there THEN token END AND fresh.b = CASE WHEN here THEN after WHEN there THEN made END
        WHERE before IS DISTINCT FROM spot
    )
    SELECT n, piece, pos, token, rank, best FROM merged JOIN (SELECT piece, min(rank << 32 | pos) AS best FROM merged GROUP BY piece) USING (piece))
)
SELECT piece, best IS NOT NULL AS unfinished, list(token ORDER BY pos) AS tokens
FROM steps WHERE best IS NULL OR n = $steps GROUP BY ALL ORDER BY piece
"""

#: One thread hands the rows to the aggregate in the order of the subquery. Bytes stand as the code points 0 to 255.
DECODE = "SELECT doc, string_agg(bytes, '') AS bytes FROM (SELECT doc, bytes FROM ids JOIN vocabulary USING (token) ORDER BY pos) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.read().split(b"\n")))}


class Coder:
    """A worker's tables and what it has encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_to_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # pieces met lately, and before them: a piece that is met again moves up, so that common ones stay
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*cuts)) if cuts else (pa.array([], pa.int32()),) * 3
        self._table("merges", a=a, b=b, rank=r.cast(pa.int64()))
        self._table("vocabulary", token=pa.array(list(ranks.values()), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in ranks]))

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, by as many queries as its steps take."""
        out, number = [b""] * len(pieces), np.arange(len(pieces))
        size, tokens = np.array([len(p) for p in pieces], np.int64), self.bytes_to_token[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(number):
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
            self._table("start", piece=pa.array(np.repeat(number, size), pa.int32()), pos=pa.array(pos, pa.int64()), token=pa.array(tokens))
            found = self.con.sql(MERGE, params={"steps": max(16, STEP_ROWS // len(tokens))}).to_arrow_table()
            lists, open_ = found["tokens"].combine_chunks(), found["unfinished"].to_numpy().astype(bool)
            number, flat = found["piece"].to_numpy(), lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            ends, raw = np.cumsum(size) * 4, flat.astype("<u4").tobytes()
            for i, start, end, go_on in zip(number.tolist(), (ends - size * 4).tolist(), ends.tolist(), open_.tolist()):
                if not go_on:
                    out[i] = raw[start:end]
            tokens = flat[np.repeat(open_, size)]
            number, size = number[open_], size[open_]
        return out

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        new = []
        for piece in pieces.difference(self.known):
            if (old := self.older.get(piece)) is not None:
                self.known[piece] = old
                continue
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            else:
                new.append((piece, raw))
        new.sort(key=lambda x: len(x[1]))
        for i, j in sketch.chunks([len(raw) for _, raw in new], BATCH):
            self.known.update(zip((p for p, _ in new[i:j]), self.merge([raw for _, raw in new[i:j]])))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        self.con.register("ids", pa.table({"doc": pa.array(np.repeat(np.arange(len(ids)), size), pa.int32()), "pos": pa.array(np.arange(len(flat)), pa.int32()), "token": pa.array(flat.astype(np.int32))}))
        out = [b""] * len(ids)
        for doc, text in self.con.execute(DECODE).fetchall():
            out[doc] = text.encode("latin-1")
        self.con.unregister("ids")
        return out


_coders: dict = {}


def _coder(name: str, ranks, pattern: str) -> Coder:
    key = (name, pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks.value, pattern)
    return _coders[key]


def code(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (text, ...) with ids (binary: unsigned little-endian 32-bit each) and decoded (binary) in place of the text."""
    spark = docs.sparkSession
    table = read_ranks(path)
    ranks, name = spark.sparkContext.broadcast(table), hashlib.sha256(repr(sorted(table.items())).encode()).hexdigest()
    keep = [c for c in docs.columns if c not in ("text", "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, ranks, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rest = batch.select(keep)
            for a, b in sketch.chunks([len(t) for t in texts], CHUNK):
                ids = coder.encode(texts[a:b])
                columns = [*rest.slice(a, b - a).columns, pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(*keep, "text").mapInArrow(run, schema)
