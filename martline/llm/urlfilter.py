"""URL filters: rules by host and path, and a cascade of Bloom filters over the corpus's own hosts.

The cascade answers whether a host is listed, exactly for every host of the universe it was built over: level 0 holds the
listed hosts; level 1 those unlisted ones that level 0 takes for listed; level 2 the listed ones that level 1 takes for
unlisted; and so on until a level takes nothing wrongly. A host is looked up level by level until one denies it; an odd
number of levels passed means listed. Hosts are known by 128 bits of their hash.

The universe is cut by hash into shards of about ``SHARD`` hosts, and each shard has a cascade of its own, built in one
task: all levels of a shard need LOAD bits a listed host and a few for a hundred unlisted ones. Shards are handed to the
pages in groups of at most ``LIMIT`` bytes, one pass over the pages' hosts a group, so that neither driver nor workers
ever hold more, at any size of the list.

Defined cases: a url that is null or has no :// has an empty host and path; an empty host is not listed; an empty list
gives no filter and lists nothing; repeated pages each get their verdict; columns host, path, rule and verdict of the
input are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martline.llm.rowkey import carried
from martline.plans.storage import materialize

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Names whose hosts are listed, as a part of the host between dots.
LISTED = ("spam-farm", "cheap-pills", "casino", "win-prize", "free-money", "click-bait", "malware", "phishing")
#: Bits a key, hash functions, hosts of a shard, and the most bytes of filters that are sent at once.
LOAD, HASHES, SHARD, LIMIT = 10, 5, 1 << 20, 64 << 20


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits)


def _bits(a: np.ndarray, b: np.ndarray, bits: int, level: int) -> np.ndarray:
    """(len(a), HASHES) bit numbers of keys of two 64-bit hashes."""
    step = (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)) | np.uint64(1)
    start = (a.view(np.uint64) ^ (b.view(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level)
    return ((start[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) >> np.uint64(11)) % np.uint64(bits)


def level_of(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A Bloom filter of the keys as 64-bit words."""
    words = max(1, -(-len(a) * LOAD // 64))
    at = np.unique(_bits(a, b, 64 * words, level))
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def passes(words: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    at = _bits(a, b, 64 * len(words), level)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def cascade(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """The levels for a universe of keys."""
    levels, wrong, rest = [], np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(wrong):
        level = len(levels)
        levels.append(level_of(a[wrong], b[wrong], level))
        # the keys that this level takes wrongly are what the next one holds, and those it holds are the next one's others
        wrong, rest = rest[passes(levels[-1], a[rest], b[rest], level)], wrong
    return levels


def lookup(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    depth, left = np.zeros(len(a), np.int64), np.arange(len(a))
    for level, words in enumerate(levels):
        left = left[passes(words, a[left], b[left], level)]
        depth[left] = level + 1
    return depth % 2 == 1


def _shard(table: pa.Table) -> pa.Table:
    """(shard, level, words) of one shard's (shard, a, b, listed)."""
    levels = cascade(table["a"].to_numpy(), table["b"].to_numpy(), table["listed"].to_numpy().astype(bool))
    shard = table["shard"][:1].to_pylist() * len(levels)
    return pa.table({"shard": pa.array(shard, pa.int64()), "level": pa.array(range(len(levels)), pa.int32()), "words": pa.array([x.tobytes() for x in levels], pa.binary())})


def build(universe: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(filters: shard, level, words, a written table; number of shards) over ``universe`` (a, b, listed; one row a key), a
    written table."""
    shards = max(1, -(-universe.count() // shard))
    split = universe.select(F.pmod("a", F.lit(shards)).alias("shard"), "a", "b", "listed")
    return materialize(split.groupBy("shard").applyInArrow(_shard, "shard long, level int, words binary"), "cascades"), shards


def groups(filters: DataFrame, limit: int) -> Iterator[dict[int, list[np.ndarray]]]:
    """Whole shards of levels, as many as hold ``limit`` bytes (or one larger)."""
    group, held, last = {}, 0, None
    for row in filters.orderBy("shard", "level").toLocalIterator():
        if row["shard"] != last and held >= limit:
            yield group
            group, held = {}, 0
        last = row["shard"]
        group.setdefault(last, []).append(np.frombuffer(bytes(row["words"]), np.uint64))
        held += len(row["words"])
    if group:
        yield group


def _is_listed(sent, shards: int):
    @F.pandas_udf("boolean")
    def is_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64), b.to_numpy(np.int64)
        shard, out = x % shards, np.zeros(len(x), bool)
        for s in np.unique(shard):
            if s in sent.value:
                at = np.flatnonzero(shard == s)
                out[at] = lookup(sent.value[s], x[at], y[at])
        return pd.Series(out)

    return is_listed


def verdicts(pages: DataFrame, rules=RULES, listed: Column | None = None, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule and verdict; ``listed`` tells of a host (column ``host``) whether it is
    on the list, and is asked once for each host of the corpus. Columns of these names are replaced, others are carried."""
    if {c.lower() for c in pages.columns} & {"listed", "_rule"}:
        return carried(pages, ["url"], ["host", "path", "rule", "verdict"], lambda own: verdicts(own, rules, listed, limit, shard))
    parts = pages.drop("host", "path", "rule", "verdict", "listed").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    if listed is None:
        listed = F.exists(F.split("host", "\\."), lambda x: x.isin(*LISTED))
    a, b = F.xxhash64("host"), F.xxhash64("host", F.lit(1))
    known = parts.filter("host <> ''").select("host").distinct().select(a.alias("a"), b.alias("b"), F.coalesce(listed, F.lit(False)).alias("listed"))
    filters, shards = build(materialize(known.groupBy("a", "b").agg(F.max("listed").alias("listed")), "hosts"), shard)
    out = parts.withColumn("listed", F.lit(False))
    for n, group in enumerate(groups(filters, limit)):
        if n:
            out = materialize(out, "pages")  # so that no task ever holds two groups
        sent = parts.sparkSession.sparkContext.broadcast(group)
        out = out.withColumn("listed", F.col("listed") | (F.col("host") != "") & _is_listed(sent, shards)(a, b))
    found = rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("_rule", found)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule", "listed")
