"""From buckets of candidates to linked components, without listing all pairs of a bucket.

Members of a bucket are compared in rounds. Buckets of at most ``SMALL`` members compare all their pairs. From a larger
bucket those members go first that cannot be linked with anybody: of a set x with u elements that no other candidate has,
at most |x| - u can be common with a y, which bounds the coefficient from above. The others are compared with one pivot,
the member with the fewest elements of its own; found links merge components, and a bucket whose members are all in one
component is settled: no pair in it can change the result. Those not settled go on with more pivots while these settle
at least half of them, and what is left is compared with all members of its bucket. No link between components is lost, while a bucket of m near
copies costs about m comparisons and not m * m, and one of m of which k stay apart m * k.

Components come from a distributed union-find: each task turns slices of its links into stars, and between these passes
the large-star and small-star steps of Kiveris et al. (2014) link every node's neighbours to the least of them, until all
that is left are stars, a number of rounds about the logarithm of the longest chain. New links are added to the stars
found before. All state is in written
tables; the driver sees counts and sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.plans.storage import broadcast_if_small, drop, materialize

SMALL, PIVOTS, BLOCK = 8, (1, 4), 1024
#: Nodes that union-find holds in a task before it passes their stars on.
FOREST = 1 << 19
#: Pairs that are verified together.
PAIRS = 4096
#: Tasks over which the edges of a hub are dealt.
EVEN = 64


def components(edges: DataFrame, held: int = FOREST) -> DataFrame:
    """(id, component): for each id in ``edges`` (a, b) but the least of its component, that least one. A task holds about
    ``held`` nodes at a time."""
    e = materialize(_merged(edges, held), "cc")
    while True:
        # as few tasks as can hold what is left; a single one leaves nothing but stars
        tasks = -(-2 * e.count() // held) or 1
        e, last = materialize(_merged(e.coalesce(tasks), held), "cc"), e
        drop(last)
        if tasks == 1 or _starred(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: greater neighbours go to the least one
        e = materialize(_matched(both, materialize(least, "least")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # small star: a node and its lesser neighbours go to the least of these
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        e = _matched(e, least).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        # no distinct: rows of one node meet in a task, where the forest keeps one of them
        e = materialize(_merged(e, held), "cc")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()


def _matched(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m of their node in ``least`` (a, m, n: its number of edges), a written table. Nodes with more
    than an ``EVEN``-th of all edges, fewer than EVEN by that, are dealt over as many tasks."""
    hot = F.col("n") > F.lit((least.agg(F.sum("n")).first()[0] or 0) / EVEN)
    hubs = least.filter(hot).select("a", F.lit(True).alias("hub"))
    lot = F.pmod(F.xxhash64("b"), F.lit(EVEN)).cast("int")
    dealt = edges.join(F.broadcast(hubs), "a", "left").select("a", "b", F.when(F.col("hub"), lot).otherwise(0).alias("lot"))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(EVEN - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.select("a", "m", F.explode(copies).alias("lot")), ["a", "lot"]).select("a", "b", "m")


def _merged(edges: DataFrame, held: int) -> DataFrame:
    """Edges (a, b) with the same components and shorter chains: each slice of a partition becomes stars by union-find."""
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest(held), "a long, b long")


def _forest(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                if len(up) > held:
                    yield stars()
                    up.clear()
        yield stars()

    return run


def _starred(e: DataFrame) -> bool:
    """Whether every node of ``e`` is either the least of its component or linked with that one alone."""
    up, down = F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("up"))
    ends = e.select(F.explode(F.array(up, down)).alias("x")).select("x.*")
    told = ends.groupBy("id").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max(F.col("up").isNull()).alias("hub"))
    return told.filter("lo < hi or lo is not null and hub").count() == 0


def shared_buckets(members: DataFrame) -> DataFrame:
    """The distinct rows of ``members`` (bucket, id) whose bucket holds two ids or more."""
    crowded = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket")
    crowded = broadcast_if_small(materialize(crowded, "buckets"))
    return materialize(members.join(crowded, "bucket", "left_semi").distinct(), "members")


#: From an Arrow array of contents to (elements, owner): the distinct 64-bit elements of each, sorted within each owner.
Unpack = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _verified(unpack: Unpack, percent: int):
    """Keeps pairs (a, b) whose contents (left, right) are alike enough; each content is unpacked once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PAIRS) for b in batches for i in range(0, len(b), PAIRS)):
            ids = np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
            _, first, place = np.unique(ids, return_index=True, return_inverse=True)
            contents = pa.concat_arrays([batch.column("left"), batch.column("right")])
            elements, owner = unpack(contents.take(pa.array(first)))
            cut = np.searchsorted(owner, np.arange(len(first) + 1))
            keep = []
            for i, j in zip(place[: len(batch)], place[len(batch) :]):
                p, q = elements[cut[i] : cut[i + 1]], elements[cut[j] : cut[j + 1]]
                low, high = sorted((len(p), len(q)))
                common = len(np.intersect1d(p, q, assume_unique=True)) if 100 * low >= percent * high else 0
                keep.append(high > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(unpack: Unpack):
    """(element, id, n): how often a batch has each element, and one who has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, owner = unpack(batch.column("content"))
            found, first, n = np.unique(elements, return_index=True, return_counts=True)
            ids = batch.column("id").to_numpy()[owner[first]] if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["element", "id", "n"])

    return run


def _sizes(unpack: Unpack):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner = unpack(batch.column("content"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(owner, minlength=len(batch)), pa.int64())], names=["id", "size"])

    return run


def _linkable(members: DataFrame, contents: DataFrame, unpack: Unpack, percent: int) -> DataFrame:
    """The rows of ``members`` (bucket, id) that may still have a link in their bucket, with ``own``, the number of
    elements that no other member of these buckets has."""
    ids = broadcast_if_small(materialize(members.select("id").distinct(), "crowd"))
    sets = contents.join(ids, "id", "left_semi")
    alone = sets.mapInArrow(_counted(unpack), "element long, id long, n long").groupBy("element").agg(F.sum("n").alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    told = sets.mapInArrow(_sizes(unpack), "id long, size long").dropDuplicates(["id"]).join(alone, "id", "left").fillna(0, ["own"])
    told = members.join(broadcast_if_small(materialize(told, "shared")), "id")
    least = told.groupBy("bucket").agg(F.min("size").alias("least"))
    # the other set has at least percent % of the size, and at least that of the smallest member
    common, other = F.col("size") - F.col("own"), F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100))
    return told.join(broadcast_if_small(materialize(least, "least")), "bucket").filter(100 * common >= percent * (F.col("size") + other - common)).select("bucket", "id", "own")


def _block(unpack: Unpack, percent: int):
    """Links (a, b) across components between the rows and the columns of a block, one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component = table["id"].to_numpy(), table["component"].to_numpy()
        left, right = (np.flatnonzero(table[k].to_numpy()) for k in ("row", "col"))
        elements, owner = unpack(table["content"].chunk(0) if table.num_rows else pa.array([], table.schema.field("content").type))
        size = np.bincount(owner, minlength=len(ids)).astype(np.float32)
        _, column, n = np.unique(elements, return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        shared = n[column] > 1
        column, owner = place[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int((n > 1).sum()), 4096):
            i, j = np.searchsorted(column, (start, start + 4096))
            part = np.zeros((len(ids), 4096), np.float32)
            part[owner[i:j], column[i:j] - start] = 1
            common += part[left] @ part[right].T
        across = component[left][:, None] != component[right][None, :]
        linked = (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (common > 0) & across
        i, j = np.nonzero(linked)
        a, b = left[i], right[j]
        _, first = np.unique(np.sort(np.stack([component[a], component[b]]), axis=0), axis=1, return_index=True)
        return pa.table({"a": pa.array(ids[a[first]], pa.int64()), "b": pa.array(ids[b[first]], pa.int64())})

    return run


def _rest(members: DataFrame, contents: DataFrame, unpack: Unpack, percent: int, block: int) -> DataFrame:
    """Links across components among those of ``members`` (bucket, id, component) that share a bucket.

    Buckets whose largest component is the same are one group. Of two members in different components one at least is not
    in that one, so its members outside it (rows) are compared with all (columns), by blocks of both. A group holds what
    meets one component and nothing beyond, however buckets are chained by common members."""
    each = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("group"))
    ids = members.join(broadcast_if_small(materialize(most, "most")), "bucket").select("group", "id", "component").distinct()
    ids = materialize(ids, "rest")
    outside = F.col("component") != F.col("group")
    sides = ids.groupBy("group").agg(F.ceil(F.sum(outside.cast("int")) / block).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cols"))
    ids = materialize(ids.join(broadcast_if_small(materialize(sides, "sides")), "group"), "blocks")
    row, col = (F.pmod(F.xxhash64("id"), F.col(k)).cast("int") for k in ("rows", "cols"))
    spot = lambda i, j, r, c: F.struct(i.alias("i"), j.alias("j"), r.alias("row"), c.alias("col"))
    along = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: spot(row, j, F.lit(True), j == col))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: spot(i, col, F.lit(False), F.lit(True)))
    spots = F.when(outside, F.concat(along, F.filter(down, lambda x: x["i"] != row))).otherwise(down)
    met = contents.join(broadcast_if_small(ids), "id").select("group", F.explode(spots).alias("at"), "id", "component", "content").select("group", "at.*", "id", "component", "content")
    # blocks are long work on few bytes: they are dealt over all partitions, not over as few as the bytes would fill
    met = met.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "i", "j")
    return met.groupBy("group", "i", "j").applyInArrow(_block(unpack, percent), "a long, b long")


def _with(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if labels is None else labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new)


def connect(members: DataFrame, contents: DataFrame, unpack: Unpack, percent: int, small: int = SMALL, pivots=PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, component) as of ``components`` over the links among members of a bucket. ``members`` (bucket, id: long) and
    ``contents`` (id, content) are written tables; two are linked if their Jaccard coefficient is at least percent / 100."""
    spark = members.sparkSession
    n = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(members.join(broadcast_if_small(materialize(n.filter(F.col("n") > small), "large")), "bucket", "left").select("bucket", "id", F.col("n").isNotNull().alias("large")), "sized")
    few = sized.filter("not large").select("bucket", "id")
    large = materialize(_linkable(sized.filter("large").select("bucket", "id"), contents, unpack, percent), "linkable")
    labels, done, left = None, None, None
    for k in (0, *pivots, None):
        members = few.withColumn("own", F.lit(0).cast("long")) if k == 0 else large
        now = members.withColumn("component", F.col("id")) if labels is None else members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if k == 0:
            members = now
        else:
            open_ = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
            large = members = materialize(now.join(broadcast_if_small(materialize(open_, "open")), "bucket", "left_semi"), "unsettled")
            large = large.drop("component")
            n = members.count()
            if n == 0:
                break
            if left is not None and 2 * n > left:
                k = None  # the last pivots settled little: blocks end it
            left = n
        if k is None:
            labels = components(_with(labels, materialize(_rest(members, contents, unpack, percent, block), "links")))
            break
        if k == 0:
            other = members.select("bucket", F.col("id").alias("b"), F.col("component").alias("cb"))
            pairs = members.withColumnRenamed("id", "a").join(other, "bucket").filter("a < b and component <> cb").select("a", "b")
        else:
            lot = F.pmod(F.xxhash64("id"), F.lit(k)).alias("lot")
            pivot = materialize(members.groupBy("bucket", lot).agg(F.min_by(F.struct("id", "component"), F.struct("own", F.xxhash64("id"))).alias("p")).select("bucket", "p"), "pivots")
            star = members.join(broadcast_if_small(pivot), "bucket").filter("component <> p.component")
            pairs = star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        both = pairs.join(contents.select(F.col("id").alias("a"), F.col("content").alias("left")), "a").join(contents.select(F.col("id").alias("b"), F.col("content").alias("right")), "b")
        new = materialize(both.select("a", "b", "left", "right").mapInArrow(_verified(unpack, percent), "a long, b long"), "links")
        done = pairs if done is None else done.unionByName(pairs)
        labels = components(_with(labels, new))
    return labels if labels is not None else spark.createDataFrame([], "id long, component long")
