"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Words are runs of letters, lower-cased. The index holds at most ``EXAMPLES`` labelled rows of each label (those of least
hash; a bounded sample by intent), and every word of these is a term: none is left out. A text is its TF-IDF vector,
(1 + log tf) * idf for each term, scaled to length 1; idf comes from all documents, and no label has a part in it. Words
that no example has cannot add to a cosine but by the text's own length, which the order of its neighbours does not depend
on; they are left out of that length.

The index keeps a posting list for each term: of the ``HEAD`` terms most examples have as dense rows with the largest
weight in each block of ``BLOCK`` examples, of the others as (example, weight). Texts are searched in batches: the rare
terms' postings are added up, which gives every block a bound with the common terms' block maxima, and the common terms
are added in those blocks alone whose bound reaches the ``NEIGHBOURS``-th best cosine found in the best two blocks. So the
neighbours are exactly those of a full scan (cosines are compared to six digits, ties go by the index's order).

A neighbour's vote is its cosine, of which each shared term's part counts as much as the term tells of the label: the
square of what its presence correlates with the label over all labelled rows to learn from. A row never votes for itself.
The share of the toxic votes is drawn to the rate of label 1 by ``PRIOR`` votes of that rate, so that a few weak votes say
little, and is calibrated on all labelled rows: in ``BINS`` of that share the rate of label 1 among them is read off after
pooling adjacent violators, so the score rises with the vote. A text without a neighbour takes the rate of such labelled
rows.

Defined cases: null and empty texts have no terms; a document with several labels counts as toxic if any says so; null
labels say nothing; of rows with one id the least text is the example; without labelled rows of both kinds the score is
the rate of label 1, or 0; repeated rows each get their score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.llm import sketch
from martline.plans.storage import broadcast_if_small, materialize

EXAMPLES, BLOCK, HEAD, NEIGHBOURS, BINS, PRIOR = 3000, 64, 512, 16, 20, 0.001
#: Code points of texts that are cut into words together, and texts that are searched together.
CHUNK, BATCH = 1 << 21, 256

_words = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = set().union(*map(words, batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["term"])


def counted(texts: list, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, counts): for each text, up to its end, the numbers of its terms in order and how often they stand."""
    lists = [[i for w in words(t) if (i := number.get(w)) is not None] for t in texts]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, len(owner))
    both, n = np.unique(owner << 32 | flat, return_counts=True)
    return np.searchsorted(both >> 32, np.arange(1, len(lists) + 1)), (both & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


def _vectors(sent):
    """(doc_id, terms, counts) of batches of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in sketch.chunks([len(t or "") for t in texts], CHUNK):
                ends, terms, n = counted(texts[a:b], sent.value)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(terms)), pa.ListArray.from_arrays(offsets, pa.array(n))], names=["doc_id", "terms", "counts"])

    return run


def _frequencies(size: int):
    """(t, n, pos, neg): in how many texts of a task each term is, and in how many labelled 1 and 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size), np.int64)
        for batch in batches:
            terms, toxic = batch.column("terms"), batch.column("toxic").fill_null(2).to_numpy()
            flat, label = terms.flatten().to_numpy(), np.repeat(toxic, np.diff(terms.offsets.to_numpy()))
            for row, part in enumerate((flat, flat[label == 1], flat[label == 0])):
                total[row] += np.bincount(part, minlength=size)
        [t] = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), *(pa.array(x[t]) for x in total)], names=["t", "n", "pos", "neg"])

    return run


def idf(n: np.ndarray, texts: int) -> np.ndarray:
    """What terms weigh that are in ``n`` of so many texts."""
    return np.log((texts + 1) / (n + 1)) + 1


def telling(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The squared correlation of presence and label, without what one degree of freedom gives by chance, of terms that so
    many rows of label 1 and of label 0 have."""
    both, all_ = pos + neg, toxic + clean
    below = np.maximum(both * (all_ - both) * float(toxic) * float(clean), 1.0)
    chi = (pos * (clean - neg) - neg * (toxic - pos)).astype(np.float64) ** 2 * all_ / below
    return np.maximum(chi - 1, 0) / max(all_, 1)


def _unit(owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    value = (1 + np.log(counts)) * weight[terms]
    length = np.sqrt(np.bincount(owner, value * value, minlength=rows))
    return value / np.maximum(length, 1e-12)[owner]


def _flat(terms: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy(), counts.flatten().to_numpy()


class Index:
    """Posting lists of the examples' terms, with block maxima of the common ones. ``weight`` is the terms' idf, ``tell`` what
    they tell of the label, ``rate`` the rate of label 1."""

    def __init__(
        self, ids: np.ndarray, toxic: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray,
        tell: np.ndarray, rate: float, block: int = BLOCK, head: int = HEAD,
    ):
        self.weight, self.tell, self.rate, self.block, rows = weight, tell, rate, block, len(ids)
        value = _unit(owner, terms, counts, weight, rows)
        # examples of the same heaviest term stand together, so that a block's largest weights are close to its rows'
        best = np.zeros(rows, np.int64)
        by = np.lexsort((value, owner))
        best[owner[by]] = terms[by]
        order = np.lexsort((ids, best))
        place = np.empty(rows, np.int64)
        place[order] = np.arange(rows)
        self.ids, self.toxic, row = ids[order], toxic[order], place[owner]
        self.size = -(-max(rows, 1) // block) * block
        often = np.bincount(terms, minlength=len(weight))
        common = np.argsort(-often, kind="stable")[:head]
        self.column = np.full(len(weight), -1, np.int64)
        self.column[common] = np.arange(len(common))
        at = self.column[terms]
        self.dense = np.zeros((len(common), self.size), np.float32)
        self.dense[at[at >= 0], row[at >= 0]] = value[at >= 0]
        self.most = self.dense.reshape(len(common), self.size // block, block).max(axis=2)
        # the terms of each example that tell of the label
        says = np.flatnonzero(tell[terms] > 0)
        says = says[np.argsort(row[says], kind="stable")]
        self.said, self.told, self.says = np.searchsorted(row[says], np.arange(rows + 1)), terms[says], value[says]
        term, row, value = terms[at < 0], row[at < 0], value[at < 0]
        by = np.lexsort((row, term))
        self.start = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.row, self.value = row[by].astype(np.int32), value[by]
        self.own: dict[int, int] = {int(x): i for i, x in enumerate(self.ids)}

    def nearest(self, without: list, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples of each text, best first; the cosine is 0 where there are fewer. A text
        has no neighbour of the id in ``without``."""
        n, block, blocks = len(without), self.block, self.size // self.block
        value = _unit(owner, terms, counts, self.weight, n)
        column = self.column[terms]
        query = np.zeros((n, len(self.dense)), np.float32)
        query[owner[column >= 0], column[column >= 0]] = value[column >= 0]
        rare = column < 0
        first = self.start[terms[rare]]
        long = self.start[terms[rare] + 1] - first
        posting = np.arange(long.sum()) + np.repeat(first - (np.cumsum(long) - long), long)
        cell = np.repeat(owner[rare] * self.size, long) + self.row[posting]
        score = np.bincount(cell, np.repeat(value[rare], long) * self.value[posting], minlength=n * self.size).astype(np.float32).reshape(n, self.size)
        for i, own in enumerate(without):
            if (at := self.own.get(own)) is not None:
                score[i, at] = -4
        bound = score.reshape(n, blocks, block).max(axis=2) + query @ self.most
        done = np.zeros((n, blocks), bool)

        def add(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(axis=0)):
                [q] = np.nonzero(need[:, b])
                score[q, b * block : (b + 1) * block] += query[q] @ self.dense[:, b * block : (b + 1) * block]
            done[need] = True

        two = np.argpartition(-bound, min(1, blocks - 1), axis=1)[:, :2]
        need = np.zeros((n, blocks), bool)
        np.put_along_axis(need, two, True, axis=1)
        add(need)
        seen = np.take_along_axis(score.reshape(n, blocks, block), two[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(seen, max(seen.shape[1] - k, 0), axis=1)[:, max(seen.shape[1] - k, 0)]
        add(~done & (bound >= least[:, None] - 1e-5) & (bound > 0))
        score[~np.repeat(done, block, axis=1)] = -4
        key = np.rint(score * 1e6).astype(np.int64) * self.size + np.arange(self.size - 1, -1, -1)
        key = -np.sort(np.partition(-key, min(k, self.size) - 1, axis=1)[:, :k], axis=1)
        rows = self.size - 1 - key % self.size
        return rows, np.maximum(np.floor_divide(key, self.size), 0) / 1e6

    def votes(self, near: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The votes of the examples in each row of ``near`` for the text of that row."""
        value, ends = _unit(owner, terms, counts, self.weight, len(near)), np.searchsorted(owner, np.arange(len(near) + 1))
        out, held = np.zeros(near.shape), np.zeros(len(self.weight))
        for i, rows in enumerate(near):
            own = terms[ends[i] : ends[i + 1]]
            held[own] = value[ends[i] : ends[i + 1]] * self.tell[own]
            long = self.said[rows + 1] - self.said[rows]
            at = np.arange(long.sum()) + np.repeat(self.said[rows] - (np.cumsum(long) - long), long)
            out[i] = np.bincount(np.repeat(np.arange(len(rows)), long), held[self.told[at]] * self.says[at], minlength=len(rows))
            held[own] = 0
        return out

    def shares(self, without: list, terms: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, list]:
        """The toxic share of the votes (-1 without a neighbour) and the ids of the neighbours."""
        if not len(self.ids):
            return np.full(len(without), -1.0), [[] for _ in without]
        flat = _flat(terms, counts)
        rows, cosine = self.nearest(without, *flat)
        rows = np.minimum(rows, len(self.ids) - 1)
        vote = np.where(cosine > 0, self.votes(rows, *flat), 0)
        share = ((vote * self.toxic[rows]).sum(axis=1) + PRIOR * self.rate) / (vote.sum(axis=1) + PRIOR)
        return np.where(cosine[:, 0] > 0, share, -1.0), [self.ids[r[c > 0]].tolist() for r, c in zip(rows, cosine)]


def _voting(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                part = batch.slice(start, BATCH)
                share, near = sent.value.shares(part.column("doc_id").to_pylist(), part.column("terms"), part.column("counts"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(share), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "toxic", "share", "evidence"])

    return run


def _pooled(rate: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rising values nearest to ``rate`` (pool adjacent violators)."""
    parts: list[list[float]] = []
    for r, w in zip(rate, weight):
        parts.append([r, w, 1])
        while len(parts) > 1 and parts[-2][0] > parts[-1][0]:
            b, a = parts.pop(), parts.pop()
            parts.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([[v] * n for v, _, n in parts])


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, score, evidence: ids of the neighbours) for every row of ``docs`` (doc_id, text); all of ``labels``
    (doc_id, toxic) may be learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labels = broadcast_if_small(materialize(labels.agg(F.max("toxic").cast("int").alias("toxic")), "toxic-labels"))
    known = docs.filter(F.col("text").rlike("\\p{L}")).select("doc_id").distinct().join(labels, "doc_id")
    taken = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for t in (0, 1)]
    taken = materialize(taken[0].unionByName(taken[1]), "toxic-examples")
    shown = docs.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # 2 * examples rows at most
    shown = materialize(shown, "toxic-texts")
    terms = shown.select("text").mapInArrow(_vocabulary, "term string").distinct().orderBy("term").toArrow()["term"].to_pylist()
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    schema = "doc_id long, terms array<int>, counts array<int>"
    found = materialize(docs.mapInArrow(_vectors(number), schema).join(labels, "doc_id", "left"), "toxic-vectors")
    told = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).first()
    seen = found.select("terms", "toxic").mapInArrow(_frequencies(len(terms)), "t int, n long, pos long, neg long").groupBy("t").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")]).toArrow()
    counts = np.zeros((3, len(terms)), np.int64)
    counts[:, _column(seen, "t").to_numpy()] = [_column(seen, c).to_numpy() for c in ("n", "pos", "neg")]
    rows = shown.select("doc_id", "text").mapInArrow(_vectors(number), schema).join(F.broadcast(taken), "doc_id").toArrow()
    n, pos, neg = counts
    rate = told["pos"] / max(told["pos"] + told["neg"], 1)
    index = Index(
        *(_column(rows, c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic")), *_flat(_column(rows, "terms"), _column(rows, "counts")),
        idf(n, told["n"]), telling(pos, neg, told["pos"], told["neg"]), rate,
    )
    voted = materialize(found.mapInArrow(_voting(spark.sparkContext.broadcast(index)), "doc_id long, toxic int, share double, evidence array<bigint>"), "toxic-votes")
    bin_ = F.when(F.col("share") < 0, -1).otherwise(F.least(F.floor(F.col("share") * BINS), F.lit(BINS - 1))).cast("int").alias("bin")
    held = voted.filter("toxic is not null").groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()
    by, total, toxic = {r["bin"]: (r["n"], r["t"]) for r in held}, sum(r["n"] for r in held), sum(r["t"] for r in held)
    rate = toxic / total if total else 0.0
    smooth = lambda b: ((by.get(b, (0, 0))[1] + rate) / (by.get(b, (0, 0))[0] + 1), by.get(b, (0, 0))[0] + 1)
    curve = _pooled(*map(np.array, zip(*[smooth(b) for b in range(BINS)])))
    # between bins the share itself decides, so that scores keep the votes' order
    table = F.array(*[F.lit(float(x)) for x in (*curve, curve[-1])])
    at = F.col("share") * (BINS - 1)
    low = F.floor(at).cast("int")
    value = F.get(table, low) + (F.get(table, low + 1) - F.get(table, low)) * (at - low)
    value = F.when(F.col("share") < 0, F.lit(float(smooth(-1)[0]))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return voted.select("doc_id", value.alias("score"), "evidence")
