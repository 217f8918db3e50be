"""Runs of repeated words inside texts, by maximal pairs.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is long enough: at least
``LEAST`` words and ``TIMES`` periods. A run of length L that starts at s is a maximal pair: the L - q words at s stand
at s + q too, with other words before them and after them. So the search lists maximal pairs (i, j) of common length l
and takes those whose distance d = j - i fits: l >= (TIMES - 1) * d and l + d >= LEAST. Each is a run (i, l + d, d) as it
stands; nothing is extended afterwards.

Pairs come from the suffix array of the text's words and the tree of its LCP intervals, walked bottom-up. An interval of
l holds the places of one string of l words; places from two of its children have other words after it, and places of two
left-word classes other words before it. The class lists of an interval are kept merged in the order of the text, each
place with its class. Places of a string of l words that are at most l / 2 apart form one progression whose difference is
the string's smallest period, and all but the first of them are of one class, so a pair of two classes with the smallest
period stands side by side in the list. A child goes into the larger list place by place and meets its two neighbours
there: n log n steps a text, however often a string occurs. A pair at a multiple of the period starts and ends as the run
does; the least distance stays.

Intervals of less than ``_shortest`` words cannot hold a run. Texts in which no string of that many words occurs twice
are told by sorted hashes and skip the tree.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Bytes of text that a task handles at a time.
SLICE = 4 << 20
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
#: Odd factors for the hashes of strings of words.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _shortest(least: int, times: int) -> int:
    """The least common length of a pair that can be a run."""
    length = 1
    while length + length // (times - 1) < least or length < times - 1:
        length += 1
    return length


def _repeats(hashes: np.ndarray, length: int) -> bool:
    """Whether a string of ``length`` words (or of the power of 2 below it) may occur twice; never false if one does."""
    step = 1
    for factor in _FACTORS:
        if 2 * step > length or len(hashes) <= step:
            break
        hashes = hashes[:-step] * factor + hashes[step:]
        step *= 2
    hashes = np.sort(hashes)
    return bool((hashes[1:] == hashes[:-1]).any())


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common length of each suffix with the next one), by ranks of strings of 1, 2, 4, ... words."""
    n, step = len(ids), 1
    distinct, rank = np.unique(ids, return_inverse=True)
    levels = [np.append(rank + 1, 0)]
    while len(distinct) < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:n]
        distinct, rank = np.unique(rank[:n] * (n + 1) + after, return_inverse=True)
        levels.append(np.append(rank + 1, 0))
        step *= 2
    order = np.argsort(levels.pop()[:n])
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        alike = (levels[level][a] == levels[level][b]) & (levels[level][a] > 0)
        for x in (a, b, common):
            x += alike.astype(np.int64) << level
    return order, common


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    low = _shortest(least, times)
    order, common = _suffixes(ids)
    word = [*ids.tolist(), -1]  # the place before the first and after the last is like no word
    found: dict[tuple[int, int], int] = {}

    def paired(i: int, j: int, length: int) -> None:
        d = j - i
        if d * (times - 1) <= length and length + d >= least and word[i - 1] != word[j - 1] and word[i + length] != word[j + length]:
            if found.get((i, length + d), d) >= d:
                found[i, length + d] = d

    def joined(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for p in b:
            k = bisect_left(a, p)
            if k:
                paired(a[k - 1], p, length)
            if k < len(a):
                paired(p, a[k], length)
            a.insert(k, p)
        return a

    # from the suffixes with a neighbour in an interval that can hold a run
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], common >= low, [False]]).astype(np.int8)))
    for first, last in zip(cuts[::2].tolist(), cuts[1::2].tolist()):
        places, lengths = order[first : last + 1].tolist(), common[first:last].tolist()
        open_intervals: list[list] = []
        done = [places[0]]
        for length, place in zip([*lengths, 0], [*places[1:], -1]):
            while open_intervals and open_intervals[-1][0] > length:
                l, held = open_intervals.pop()
                done = joined(held, done, l)
            if open_intervals and open_intervals[-1][0] == length:
                open_intervals[-1][1] = joined(open_intervals[-1][1], done, length)
            elif length:
                open_intervals.append([length, done])
            done = [place]
    return sorted(((start, length, d) for (start, length), d in found.items()), key=lambda r: (r[0], r[2]))


def _text_runs(words: list[bytes], least: int, times: int) -> list[tuple[int, int, int]]:
    if len(words) < least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    if not _repeats(hashes, _shortest(least, times)):
        return []
    number: dict[bytes, int] = {}
    return runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least, times)


def _searched(text: int, least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]))
        for part in (p for batch in batches for p in sliced(batch, text)):
            runs, collapsed = [], []
            for value in part.column(text).to_pylist():
                words = (value or "").encode().split()
                own = _text_runs(words, least, times)
                if own:
                    stays = np.ones(len(words), bool)
                    for start, length, period in own:
                        stays[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                runs.append([dict(zip(RUN.names, r)) for r in own])
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=[*part.schema.names, "runs", "collapsed"],
            )

    return run


def sliced(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of its column ``text``, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        base = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with runs, an array of (start, length, period) in words by start and period, and collapsed, the words of
    ``text`` joined by one space but for those that a run holds after its first period.

    A null or blank text has no runs and the empty text as collapsed. Rows are judged one by one, so nulls in other columns,
    repeated rows and ids change nothing; other columns are carried unchanged, but for columns already named runs or
    collapsed, which are replaced. Nothing is shuffled. ``times`` is 3 or more."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    place = [c.lower() for c in kept].index(text.lower())
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_searched(place, least, times), schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first by start and period. Null if none."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))
