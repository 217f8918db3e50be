"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every rule is a share of a text in thousandths, and rejects above a cutoff. The labelled good documents that pass the
base rule are split by a hash of their id: a quarter proposes cutoffs, the others are the holdout that proves them. In
each stratum the proposals form a ladder (``LEVELS``) from lenient to strict: on each rung every rule has the strictest
cutoff that leaves at most a set share of the proposing documents above it, on the first rung doubled. A rung is safe if the
holdout proves it for all rules together: of its n documents k are rejected by any rule, and the exact binomial tail
P(Bin(n, risk) <= k) must not exceed the error level, so that the true rate of false rejections is under ``risk`` with
that confidence. Rungs are tried in order and the trial ends at the first that fails (fixed-sequence testing needs no
further correction); the error level is split evenly over the strata (Bonferroni). The stratum uses the last safe rung;
one with too few labels proves nothing (under 145 good documents in the holdout, if there are four strata), and there the
rules reject nothing.

Defined cases: a null text has no words; a null stratum counts as ''; a document labelled more than once is good if any
of its labels is 1; labels without a document, and null labels, say nothing; repeated rows each get their verdict;
an empty table gives an empty result. Further columns of the input are carried by ``judge`` unchanged, but for those
that bear the name of a measure, which the measure replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martline.llm.rowkey import carried
from martline.llm.text import WS, count_chars, words
from martline.plans.storage import broadcast_if_small, materialize

#: rule -> (numerator, denominator) of the share
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "exclaims": ("n_exclaims", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs in thousandths, lenient to strict.
CUTOFFS = (800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20)
RISK, ERROR = 0.03, 0.05
#: Rungs: thousandths of the proposing documents that may lie above a rule's cutoff, and what the cutoff is multiplied by.
LEVELS = ((0, 2), (0, 1), (1, 1), (2, 1), (4, 1), (8, 1))
#: First hex digits of the hash of the ids that propose.
PROPOSE = ("0", "1", "2", "3")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims", "n_lines")

#: Columns that ``judge`` adds, and those that it uses inside.
MADE = (*MEASURES, "fired", "base_failed", "kept")
INNER = ("_s", "_text", "_w", "_l", "_h", "_g", "_r", "_", "_p", "_q")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of MEASURES (long) instead of its text."""
    keep = [c for c in docs.columns if c not in (*MEASURES, "text")]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    step = docs.select(*keep, F.lit(None).cast("string").alias("_") if "text" not in docs.columns else text.alias("_text"), words(F.col("text")).alias("_w"), lines.alias("_l"))
    step = step.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", WS, "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        count_chars(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count_chars(F.col("_text"), "!?").alias("n_exclaims"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # the hash of each window of eight words; both uses keep the array from being inlined into the lambdas below
    step = step.withColumn(
        "_g", F.expr("if(size(_h) < 8, cast(array() as array<bigint>), transform(sequence(1, size(_h) - 7), i -> xxhash64(slice(_h, i, 8))))")
    )
    step = step.withColumn("_r", F.size(F.array_distinct("_g")) < F.size("_g"))
    # windows found twice: neighbours in sort order; then the words they cover
    repeat = """
        if(_r, aggregate(
            array_sort(flatten(transform(
                array(array_sort(transform(_g, (h, i) -> struct(h, i)))),
                a -> transform(
                    filter(a, (x, j) -> x.h = coalesce(get(a, j - 1).h, x.h - 1) or x.h = coalesce(get(a, j + 1).h, x.h - 1)),
                    x -> x.i)))),
            struct(cast(-8 as int) as last, 0L as n),
            (acc, p) -> struct(p as last, acc.n + least(8, p - acc.last) as n),
            acc -> acc.n), 0L)"""
    return step.select(*keep, *[m for m in MEASURES if m != "n_repeat_words"], F.expr(repeat).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _above(rule: str, cutoff: Column | int) -> Column:
    top, bottom = RULES[rule]
    return 1000 * F.col(top) > cutoff * F.col(bottom)


def tail(n: str, k: str, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed exactly in logarithms; 1 where k is not under n * risk."""
    import math

    first, odds = math.log1p(-risk), math.log(risk) - math.log1p(-risk)
    return F.expr(f"""
        if({k} >= {n} * {risk!r}D, 1D, aggregate(
            if({k} < 1, cast(array() as array<bigint>), sequence(1L, {k})),
            struct({n} * {first!r}D as term, {n} * {first!r}D as total),
            (acc, i) -> struct(
                acc.term + ln(({n} - i + 1D) / i) + {odds!r}D as term,
                greatest(acc.total, acc.term + ln(({n} - i + 1D) / i) + {odds!r}D)
                    + ln(1D + exp(-abs(acc.total - (acc.term + ln(({n} - i + 1D) / i) + {odds!r}D)))) as total),
            acc -> exp(acc.total)))""")


def _fires(suffix: str = "") -> Column:
    """Whether any rule fires at the cutoffs cut_<rule><suffix>; null cutoffs never do."""
    return F.greatest(*[F.coalesce(_above(r, F.col(f"cut_{r}{suffix}")), F.lit(False)) for r in RULES])


def certified(measured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, error: float = ERROR, cutoffs=CUTOFFS, levels=LEVELS) -> DataFrame:
    """One row per stratum with the cutoffs of its last safe rung (columns cut_<rule>, null: none)."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_q")).filter("_q = 1")
    good = measured.join(good.select("doc_id"), "doc_id", "left_semi").filter(~base_failed())
    propose = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*PROPOSE)
    good = materialize(good.select(stratum, propose.alias("_p"), *{c for pair in RULES.values() for c in pair}), "quality-good")
    counts = good.groupBy(stratum).agg(F.count_if("_p").alias("n"), *[F.count_if(F.col("_p") & _above(r, c)).alias(f"{r}_{c}") for r in RULES for c in cutoffs])

    def cut(rule: str, share: int, times: int) -> Column:
        told = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"{rule}_{c}").alias("k")) for c in cutoffs])
        least = F.array_min(F.filter(told, lambda x: 1000 * x["k"] <= share * F.col("n")))["cutoff"]
        return F.array_min(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c >= times * least))

    rungs = materialize(counts.select(stratum, *[cut(r, *level).alias(f"cut_{r}_{j}") for r in RULES for j, level in enumerate(levels)]), "quality-rungs")
    held = good.filter("not _p").join(broadcast_if_small(rungs), stratum)
    tested = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(_fires(f"_{j}")).alias(f"k_{j}") for j in range(len(levels))])
    strata = tested.agg(F.count(F.lit(1)).alias("strata"))
    passed = F.array(*[tail("n", f"k_{j}", risk) <= F.lit(error) / F.col("strata") for j in range(len(levels))])
    safe = F.array_position(F.concat(passed, F.array(F.lit(False))), False) - 1
    chosen = tested.crossJoin(F.broadcast(strata)).select(stratum, safe.alias("safe"))
    pick = lambda r: F.get(F.array(*[F.col(f"cut_{r}_{j}") for j in range(len(levels))]), (F.col("safe") - 1).cast("int"))
    return rungs.join(chosen, stratum).select(stratum, *[pick(r).alias(f"cut_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``docs`` without text, with the measures, base_failed, kept and the rules that fired.

    The measures are written once to the shared folder (a narrow table); thresholds and verdicts both read it."""
    if clash := {c.lower() for c in docs.columns} & {*INNER, *MADE, *(f"cut_{r}" for r in RULES)}:
        used = list(dict.fromkeys(["doc_id", "text", stratum]))
        if clash & {c.lower() for c in used}:
            raise ValueError(f"the stratum has the name of a result: {stratum}")
        return carried(docs, used, list(MADE), lambda own: judge(own, labels, stratum, risk, error))
    measured = measures(docs.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))))
    measured = materialize(measured, "quality-measures")
    cuts = materialize(certified(measured, labels, "_s", risk, error), "quality-cutoffs")
    fired = F.array_compact(F.array(*[F.when(_above(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES]))
    out = measured.join(broadcast_if_small(cuts), "_s", "left").withColumn("fired", fired).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("fired") == 0)).drop("_s", *[f"cut_{r}" for r in RULES])
