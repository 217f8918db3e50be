"""Shards of near equal size by sampled splitters.

A sample of the keys is drawn with chances in proportion to the records' sizes, and its quantiles cut the keys into ranges
that are many more than the shards. Every record then goes to its range, and the exact size and number of rows of each
range are counted. Ranges that are overfull in either are subdivided by a new sample of theirs alone, until none is left
that can be. A record's place in the order is (key, mix), where mix scatters the records of one key: a key with a third
of all rows is cut by mix, while a key that fits in a range is never cut.

Ranges are dealt to shards, the largest first, each to the shard that is least full. Pieces of one key go as a whole if
they fit in a shard and the shards come out even. The driver sees the sample and the ranges, both bounded by ``MOST``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martline.plans.storage import materialize

#: Ranges for each shard at least; rows for which there is one more range; ranges at most, before overfull ones are cut.
RANGES, ROWS, MOST = 64, 100_000, 16_384
#: Keys drawn for a range; an overfull range has so many times a range's share; rounds of cutting at most.
DRAWN, OVERFULL, ROUNDS = 16, 2.0, 6
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
#: Part of its share that a shard may have too much before keys that fit in one are cut.
EVEN = 0.005

#: (key, mix) of the first record of every range but the first, in order.
Splitters = list[tuple[int, int]]


def cut(sample: np.ndarray, share: float) -> Splitters:
    """Splitters for a sample of (key, mix, weight) rows, ordered, so that ranges weigh about ``share``. A key that weighs
    more than a range is cut by mix; others stay whole."""
    out: Splitters = []
    keys, first = np.unique(sample["key"], return_index=True)
    weight, full = np.add.reduceat(sample["weight"], first) if len(first) else np.zeros(0), 0.0
    last = np.append(first[1:], len(sample))
    for k, (key, own) in enumerate(zip(keys.tolist(), weight.tolist())):
        if full and full + own > share:
            out.append((key, LEAST))
            full = 0.0
        if own > OVERFULL * share:
            rows = sample[first[k] : last[k]]
            steps = np.cumsum(rows["weight"]) // share
            out += [(key, int(m)) for m in rows["mix"][1:][steps[1:] > steps[:-1]]]
            out.append((key, GREATEST))
            full = 0.0
        else:
            full += own
    return sorted(set(out))


def _ranged(splitters: Splitters):
    """Adds the number of the range that holds (_key, _mix)."""
    keys = np.array([k for k, _ in splitters], np.int64)
    mixes = np.array([m for _, m in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, mix = batch.column("_key").to_numpy(), batch.column("_mix").to_numpy()
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            place = low.copy()
            inside = np.flatnonzero(high > low)
            order = inside[np.argsort(low[inside], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                if len(rows):  # records of one key that has splitters
                    place[rows] += np.searchsorted(mixes[low[rows[0]] : high[rows[0]]], mix[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], names=[*batch.schema.names, "_range"])

    return run


def _with_range(rows: DataFrame, splitters: Splitters) -> DataFrame:
    return rows.mapInArrow(_ranged(splitters), T.StructType([*rows.schema, T.StructField("_range", T.LongType())]))


def _drawn(rows: DataFrame, total: float, number: int, seed: int) -> np.ndarray:
    """About ``number`` (key, mix, weight) of ``rows``, each drawn with a chance of number * weight / total (1 at most);
    weight is what a drawn row stands for. The draw hangs on key, mix and seed, so reruns agree."""
    chance = F.least(F.lit(1.0), F.lit(float(number)) * F.col("_weight") / F.lit(total))
    lot = (F.xxhash64("_key", "_mix", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    drawn = rows.filter(lot < chance).select(F.col("_key").alias("key"), F.col("_mix").alias("mix"), (F.col("_weight") / chance).alias("weight")).toArrow()
    out = np.zeros(drawn.num_rows, np.dtype([("key", np.int64), ("mix", np.int64), ("weight", np.float64)]))
    for name in out.dtype.names:
        out[name] = drawn[name].to_numpy()
    return np.sort(out, order=["key", "mix"])


def _splitters(rows: DataFrame, total: float, ranges: int, seed: int) -> tuple[Splitters, dict[int, tuple[int, int]]]:
    """Splitters and (size, rows) of the range of each number; overfull ranges are cut while they can be."""
    share = total / ranges
    out = cut(_drawn(rows, total, DRAWN * ranges, seed), share)
    for more in range(1, ROUNDS + 1):
        told = _with_range(rows, out).groupBy("_range").agg(
            F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum("_weight").alias("weight"),
            (F.min(F.struct("_key", "_mix")) < F.max(F.struct("_key", "_mix"))).alias("several"),
        ).collect()
        overfull = {r["_range"]: r["weight"] for r in told if r["several"] and r["rows"] > 1 and r["weight"] > OVERFULL * share}
        new: Splitters = []
        if overfull and more < ROUNDS:
            within = _with_range(rows, out).filter(F.col("_range").isin(list(overfull))).drop("_range")
            weight = sum(overfull.values())
            sample = _drawn(within, weight, DRAWN * 2 * max(1, round(weight / share)), seed + more)
            new = [x for x in cut(sample, share / 2) if x not in set(out)]
        if not new:
            return out, {r["_range"]: (r["size"], r["rows"]) for r in told}
        out = sorted({*out, *new})
    raise AssertionError("not reached")


def dealt(splitters: Splitters, told: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """range -> shard: largest first to the least full one. Ranges that share a key (of whose splitters mix is neither end)
    form one piece as long as it takes no more than a shard's share; where that leaves a shard over its share by more than
    ``EVEN``, pieces over a half of the share come apart, then over a quarter, and so on."""
    share = sum(size for size, _ in told.values()) / shards
    pieces: list[list[int]] = []
    for number in sorted(told):
        inner = number > 0 and splitters[number - 1][1] not in (LEAST, GREATEST)
        if inner and pieces and pieces[-1][-1] == number - 1:
            pieces[-1].append(number)
        else:
            pieces.append([number])
    weigh = lambda piece: sum(told[n][0] for n in piece)
    best, least = {}, None
    for part in (1.0, 0.5, 0.25, 0.125, 0.0):
        units = [u for p in pieces for u in ([p] if weigh(p) <= part * share else [[n] for n in p])]
        load = [(0, 0, k) for k in range(shards)]
        out = {}
        for unit in sorted(units, key=lambda u: (-weigh(u), u)):
            size, rows, k = heapq.heappop(load)
            out |= dict.fromkeys(unit, k)
            heapq.heappush(load, (size + weigh(unit), rows + sum(told[n][1] for n in unit), k))
        most = max(load)[0]
        if least is None or most < least:
            best, least = out, most
        if most <= (1 + EVEN) * share:
            return out
    return best


def assign(rows: DataFrame, key: Column, size: Column, tie: Column, shards: int = 16, seed: int = 42) -> DataFrame:
    """``rows`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard), so that the shards' sums of
    ``size`` are near equal and records of one ``key`` (a long) stay together where that allows it.

    ``tie`` tells the records of a key apart (an id); full repeats of key and tie are cut too where they overfill a range.
    A null key counts as 0, a null or negative size as 0. An empty table stays empty. Columns are carried unchanged, but for
    columns already named shard or slot, which are replaced. The rows are written once to the shared folder: pass the
    columns that are wanted."""
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    carried = F.struct(*[F.col(f"`{c}`") for c in kept])
    # one task's repeats of a tie differ in the low bits of mix alone
    scatter = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFF))
    mix = F.xxhash64(tie.cast("string")).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(scatter)
    own = materialize(
        rows.select(
            carried.alias("_row"), F.coalesce(key.cast("long"), F.lit(0)).alias("_key"), mix.alias("_mix"),
            F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("_size"),
        ),
        "records",
    )
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    # a row's own share is added to its size, so that many small rows fill a range too
    records = own.withColumn("_weight", F.col("_size") / F.lit(float(max(1, total))) + F.lit(1.0 / max(1, n)))
    ranges = min(MOST, max(RANGES * shards, n // ROWS))
    splitters, told = _splitters(records.drop("_row"), 2.0, ranges, seed)
    shard = dealt(splitters, told, shards)
    base, upto = {}, dict.fromkeys(range(shards), 0)
    for number in sorted(told):
        base[number] = upto[shard[number]]
        upto[shard[number]] += told[number][1]
    spark = rows.sparkSession
    places = spark.createDataFrame([(k, shard[k], base[k]) for k in sorted(told)], "_range long, _shard int, _base long")
    order = Window.partitionBy("_range").orderBy("_key", "_mix")
    numbered = _with_range(own, splitters).withColumn("_nth", F.row_number().over(order) - 1)
    placed = numbered.join(F.broadcast(places), "_range")
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], F.col("_shard").alias("shard"), (F.col("_base") + F.col("_nth")).cast("long").alias("slot"))


def write(assigned: DataFrame, path: str) -> None:
    """Writes what ``assign`` gave as Parquet, a folder for each shard, with the rows of every file in order of their slots."""
    assigned.repartition("shard", F.floor(F.col("slot") / ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
