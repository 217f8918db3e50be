"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A document is expected in the mix ``copies`` times, the target of its source over the source's size (times the
document's own weight, if one is given). The whole part is certain; for the rest the documents of a source are ranked by
Q = odds(U) / odds(p), U a uniform number drawn from the document's id and p the fractional part (Rosen's Pareto order
sampling), and the first ones are taken until the words still wanted are reached. The size of the sample is fixed in
words: it ends at the document that brings the source nearest to its target, so that a source misses its target by
half a document at most.

Ranking within a source never gathers it in one task: ranks are cut into bins of Q, the words of each bin are summed
with map-side combine, bins under the crossing bin are taken whole, and only the crossing bin is refined: twice by
another histogram and then by a window over what a millionth of the source's range holds.

Defined cases: a null source is a source of its own and comes last; null and blank texts have size 0 and take 0 words;
the draw depends on the id alone, so reruns agree; rows with the same id and size share their rank and are ordered by
their text's hash, full repeats at random among equals; a source whose sizes are all 0 has target 0; an empty table gives
an empty result. Columns of the input other than those named in the result are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martline.llm.rowkey import KEY, renamed, same
from martline.llm.text import n_words
from martline.plans.storage import broadcast_if_small, materialize

#: The weights that sources take in turn, the share of all sizes that they get, the most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bins of a histogram; each refinement divides a bin by as many.
BINS = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights in the order of sources by code point, null last.

    Filling by weight where no source may exceed its cap, the excess going to the others by weight, has a closed form:
    sources reach their cap in the order of cap / weight, and those under the final level get weight * level. The two
    windows run over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w.cast("long")).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (share * F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # the level is that of the first source which does not fill its cap
    by = by.withColumn("open", F.when(F.col("w") * F.col("level") < F.col("cap"), F.col("cap") / F.col("w")))
    level = F.min(F.when(F.col("open").isNotNull(), F.struct("open", F.col("source").isNull().alias("last"), "source", "level"))).over(all_of)["level"]
    target = F.when(F.col("open").isNotNull(), F.col("w") * level).otherwise(F.col("cap").cast("double"))
    return by.select("source", "source_size", target.alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) drawn from the text of ``key``: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weight: str | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies, and the key of the rows of ``keyed``) for every row of ``docs`` (doc_id, text, source and, if named, a
    non-negative ``weight`` that scales a document's expected copies within its source, up to ``most``)."""
    own = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    key = [k for k in KEY[1:] if k in docs.columns]
    rows = docs.select("doc_id", *key, "source", n_words(F.col("text")).alias("size"), own.cast("double").alias("own"), F.xxhash64("text").alias("tie"))
    rows = materialize(rows, "mix-sizes")
    goal = materialize(targets(rows, weights, share, most), "mix-targets")
    n = goal.count()
    goal = broadcast_if_small(goal)
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    copies = _scaled(rows, most) if weight else F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if weight:
        rows, copies = copies, F.col("expected")
    rows = rows.withColumn("certain", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    u = uniform(F.col("doc_id"))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))))
    rows = materialize(rows.withColumn("at", F.col("q") / (1 + F.col("q"))).select("doc_id", *key, "source", "size", "tie", "source_size", "target", "certain", "q", "at"), "mix-ranks")
    cut = _crossing(rows)
    out = rows.join(cut, rows["source"].eqNullSafe(cut["cut_source"]), "left")
    out = out.withColumn("extra", F.col("q").isNotNull() & (_lot("at") < F.col("bin")))
    edge = out.filter(F.col("q").isNotNull() & (_lot("at") == F.col("bin")))
    by = Window.partitionBy("source", "bin").orderBy("q", "doc_id", "size", "tie", *key)
    edge = edge.withColumn("extra", F.col("before") + F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2 <= F.col("wanted"))
    out = out.filter(F.col("q").isNull() | F.col("bin").isNull() | (_lot("at") != F.col("bin"))).unionByName(edge)
    return out.select("doc_id", *key, "source", "size", "source_size", "target", (F.col("certain") + F.coalesce(F.col("extra"), F.lit(False)).cast("long")).alias("copies"))


def _lot(at: str, bins: int = BINS * BINS) -> Column:
    return F.least(F.floor(F.col(at) * bins), F.lit(bins - 1)).cast("long")


def _crossing(rows: DataFrame) -> DataFrame:
    """(cut_source, wanted, bin, before): the bin of BINS ** 2 in which a source's taken words cross what it wants beside
    the certain copies, and the words before that bin."""
    ranked = rows.filter(F.col("q").isNotNull())
    wanted = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted"))
    wanted = materialize(wanted, "mix-wanted")
    found = broadcast_if_small(wanted.select(F.col("source").alias("s0"), "wanted"))
    coarse = _cross(ranked.join(found, ranked["source"].eqNullSafe(F.col("s0"))).withColumn("lot", _lot("at", BINS)).withColumn("start", F.lit(0).cast("long")))
    coarse = materialize(coarse.withColumnRenamed("lot", "outer"), "mix-coarse")
    c = broadcast_if_small(coarse.select(F.col("source").alias("s1"), "wanted", "outer", F.col("before").alias("start")))
    fine = ranked.join(c, ranked["source"].eqNullSafe(F.col("s1")) & (_lot("at", BINS) == F.col("outer"))).withColumn("lot", _lot("at"))
    fine = materialize(_cross(fine), "mix-fine")
    return broadcast_if_small(fine.select(F.col("source").alias("cut_source"), "wanted", F.col("lot").alias("bin"), "before"))


def _cross(rows: DataFrame) -> DataFrame:
    """The lot of each source in which the sum of sizes passes ``wanted`` (the last one if none does)."""
    sums = rows.groupBy("source", "lot").agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"), F.max("start").alias("start"))
    to = Window.partitionBy("source").orderBy("lot")
    sums = sums.withColumn("upto", F.col("start") + F.sum("words").over(to.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("lot", "upto", "words"))).alias("hit")
    got = sums.groupBy("source").agg(first, F.max(F.struct("lot", "upto", "words")).alias("last"), F.max("wanted").alias("wanted"))
    return got.withColumn("hit", F.coalesce("hit", "last")).select("source", "wanted", "hit.lot", (F.col("hit.upto") - F.col("hit.words")).alias("before"))


def _scaled(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with the expected copies least(most, c * own): c fills the target of the source; each round caps the
    documents that would exceed ``most`` and scales the others again, until none is newly capped."""
    rows = rows.withColumn("expected", F.lit(0.0)).withColumn("scale", F.lit(0.0))
    for _ in range(64):
        capped = F.col("own") * F.col("scale") >= most
        sums = rows.groupBy("source").agg(
            (F.max("target") - most * F.sum(F.when(capped, F.col("size")).otherwise(0))).alias("left"), F.sum(F.when(capped, 0.0).otherwise(F.col("size") * F.col("own"))).alias("mass"), F.max("scale").alias("was")
        )
        sums = materialize(sums.select("source", F.when(F.col("mass") > 0, F.greatest("was", F.col("left") / F.col("mass"))).otherwise(F.col("was")).alias("now"), "was"), "mix-scale")
        rows = rows.drop("scale").join(broadcast_if_small(sums.select(F.col("source").alias("s2"), F.col("now").alias("scale"))), rows["source"].eqNullSafe(F.col("s2"))).drop("s2")
        if sums.filter(F.col("now") > F.col("was") * (1 + 1e-12)).isEmpty():
            break
    return rows.withColumn("expected", F.least(F.lit(float(most)), F.col("own") * F.col("scale")))


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` (of ``keyed``) in the mix, each as often as ``mixed`` (key, copies) says, with their columns alone."""
    taken = renamed(mixed.filter("copies > 0").select(*KEY, F.col("copies").alias("_copies")))
    many = docs.join(taken, same(docs, taken))
    return many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
