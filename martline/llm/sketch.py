"""Hashing of shingles and fast similarity sketching, vectorised over batches of texts (numpy).

Shingles are hashed to 64 bits: a polynomial over the values of a span, taken from one running sum over the batch, then
mixed. Two different shingles of the same texts share a hash with a chance of about 2 ** -64 a pair.

Fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017) fills t bins: in each of the first t rounds every element
of a set is thrown into one bin at random, in round t + i all go to bin i, and a bin keeps the least (round, hash); a set
is done when all its bins are full, which takes one or two rounds for sets larger than t log t and 2 t at most. Each bin
agrees between two sets with the probability of their Jaccard coefficient, and the number of bins that agree is as
concentrated as that of independent MinHash functions.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def running(values: np.ndarray) -> np.ndarray:
    """Sums S with S[i] of the first i values times powers; ``span_hash`` reads spans from it."""
    up, _ = _table(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal for equal values wherever they stand."""
    _, down = _table(len(sums))
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def word_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner) of the shingles of ``width`` words of each text, repeats included; a text of fewer words has its
    whole sequence as its one shingle, and one without words none. Words are split at ASCII white space."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    words = span_hash(running(joined), start, end)
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, bounds)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(first[:-1], n) + _runs(n)
    size = np.repeat(np.minimum(counts, width), n)
    return span_hash(running(words), at, at + size), np.repeat(np.arange(len(texts)), n)


def char_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner) of the shingles of ``width`` code points of each text, repeats included; a shorter text is its own
    one shingle, an empty one has none."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.array([len(t) for t in texts], np.int64)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(np.cumsum(counts) - counts, n) + _runs(n)
    size = np.repeat(np.minimum(counts, width), n)
    return span_hash(running(points), at, at + size), np.repeat(np.arange(len(texts)), n)


def sketch(elements: np.ndarray, owner: np.ndarray, count: int, bins: int, seed: int = 1) -> np.ndarray:
    """The sketches of ``count`` sets as an array (count, bins); a set without elements keeps empty bins (all ones).

    The value of a bin holds the round above 48 bits of the hash, so that earlier rounds win."""
    out = np.full(count * bins, _FULL)
    seeds = mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed))
    some = np.zeros(count, bool)
    some[owner] = True
    for r in range(2 * bins):
        h = mix(elements ^ seeds[r])
        at = owner * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if r < bins else owner * bins + (r - bins)
        np.minimum.at(out, at, (h & np.uint64((1 << 48) - 1)) | np.uint64(r << 48))
        open_ = (out.reshape(count, bins) == _FULL).any(axis=1) & some
        if not open_.any():
            break
        left = open_[owner]
        elements, owner = elements[left], owner[left]
    return out.reshape(count, bins)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """Keys (count, bands) of int64: a hash of each run of ``rows`` bins and its place."""
    count, bins = sketches.shape
    key = np.repeat(np.arange(bins // rows, dtype=np.uint64)[None, :], count, axis=0)
    for j in range(rows):
        key = mix(key * np.uint64(0xE7037ED1A0B428DB) + sketches[:, j : bins // rows * rows : rows])
    return key.view(np.int64)


def distinct(elements: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, owner) without repeats, sorted within each owner."""
    if not len(elements):
        return elements, owner
    # by the hashes, then stably by their owners: small numbers are sorted by their bytes, faster than both at once
    order = np.argsort(elements)
    order = order[np.argsort(owner[order].astype(np.uint16 if count <= 1 << 16 else np.uint32), kind="stable")]
    elements, owner = elements[order], owner[order]
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    return elements[new], owner[new]


def chunks(lengths: list[int], most: int = 1 << 20):
    """Slices of consecutive texts of at most ``most`` units together (or one longer text)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)
