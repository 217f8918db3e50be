"""Secret scans: base patterns, and character Markov models of random strings and identifiers (DataFrame functions only).

A span is found natively by cutting the text at a pattern: matches and the pieces between them alternate, so lengths
summed in order give the code points where every match starts and ends.

The models are first-order Markov chains over the classes of ALPHABET (digits, letters, the rest). The labelled samples
come from the corpus: values of base matches are labelled random, and words of letters, digits and underscores that no
base match touches are labelled ordinary; every distinct string of each label counts once. A run of secret characters that
holds a letter and a digit, or a capital after a small letter, is a secret if it has at least ``LEAST`` characters and the sum of
log(P_random / P_ordinary) over its transitions is over ``LIMIT`` millinats a character. Of a run that is none, each
stretch of letters and digits is judged by itself, so that a path or a name before a secret does not hide it.

Defined cases: null texts are empty and have no spans; without samples of either label the models are equal and add
nothing; what overlaps a base span is left out, be it a run or a stretch; repeated rows each get their spans; an empty table
gives an empty result. Other columns are carried unchanged by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martline.llm.rowkey import carried
from martline.plans.storage import materialize

#: The base patterns. Letters of the key words are matched in either ASCII case.
KEYS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN_HEAD = KEYS + "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = ASSIGN_HEAD + ASSIGN_VALUE + "+"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs that the models judge, and the tokens that serve as ordinary identifiers.
RUN = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRETCH = "[A-Za-z0-9]{16,}"
#: Parts of even chances in the model of random strings and in that of ordinary ones.
MIXED = (0.5, 0.1)
#: What a run or stretch must hold to be judged.
TOLD = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]|[a-z][A-Z]"
LEAST, LIMIT = 16, 300
#: Columns that ``scan`` adds, and those that it uses inside.
MADE = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
INNER = ("_text", "_assign", "_access", "_hex", "_runs", "_w")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = F.aggregate(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out")),
        lambda acc, x: F.when(x["match"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(x["gap"])).alias("start"), (acc["at"] + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("end"), x["match"].alias("match")))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_text`` and the arrays _assign, _access, _hex of spans and _runs of runs for the models."""
    df = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    assign = F.filter(spans(F.col("_text"), ASSIGN), lambda s: F.char_length(F.regexp_replace(s["match"], f"^{ASSIGN_HEAD}", "")) >= 6)
    df = df.withColumns({"_assign": assign, "_access": spans(F.col("_text"), ACCESS), "_hex": spans(F.col("_text"), HEX)})
    runs = F.filter(spans(F.col("_text"), RUN), lambda s: s["match"].rlike(TOLD))
    return df.withColumn("_runs", runs)


def fit(scanned: DataFrame) -> DataFrame:
    """(pair, weight): millinats that a transition speaks for a random string; one row for each pair of classes.

    Shares are of the transitions in the distinct strings, mixed with a part ``MIXED`` of even chances, so that what neither
    sample shows weighs little; it is filled in for all pairs (63 * 63 rows). Transitions from or to a character that is no
    letter or digit say nothing."""
    values = F.concat(F.transform("_assign", lambda s: F.regexp_replace(s["match"], f"^{ASSIGN_HEAD}", "")), F.transform("_access", lambda s: s["match"]), F.transform("_hex", lambda s: s["match"]))
    plain = F.filter(F.split(F.regexp_replace("_text", f"{ASSIGN}|{ACCESS}|{HEX}|{RUN}", " "), "[^A-Za-z0-9_]+"), lambda w: F.char_length(w) >= 6)
    tagged = [scanned.filter(F.size(values) > 0).select(F.explode(values).alias("s"), F.lit("r").alias("label")), scanned.select(F.explode(F.array_distinct(plain)).alias("s"), F.lit("o").alias("label"))]
    kept = [t.filter(F.char_length("s") > 1).groupBy("s", "label").agg(F.count(F.lit(1)).alias("_n")).drop("_n") for t in tagged]
    pairs = kept[0].unionByName(kept[1]).select("label", F.explode(F.expr("transform(sequence(1, char_length(s) - 1), i -> substring(s, i, 2))")).alias("two"))
    a, b = F.instr(F.lit(ALPHABET), F.substring("two", 1, 1)), F.instr(F.lit(ALPHABET), F.substring("two", 2, 1))
    seen = pairs.select("label", (a * 63 + b).alias("pair")).groupBy("pair").agg(F.count_if(F.col("label") == "r").alias("r"), F.count_if(F.col("label") == "o").alias("o"))
    full = scanned.sparkSession.range(63 * 63).select(F.col("id").alias("pair")).join(seen, "pair", "left").fillna(0, ["r", "o"]).withColumn("first", F.floor(F.col("pair") / 63))
    from_ = full.groupBy("first").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    chance = lambda n, all_, mixed: (1 - mixed) * F.when(F.col(all_) > 0, F.col(n) / F.col(all_)).otherwise(1 / 63) + mixed / 63
    odds = F.log(chance("r", "rs", MIXED[0])) - F.log(chance("o", "os", MIXED[1]))
    has = full.agg((F.sum("r") > 0) & (F.sum("o") > 0))
    weight = F.when(F.col("both") & (F.col("first") > 0) & (F.col("pair") % 63 > 0), F.round(1000 * odds)).otherwise(F.lit(0)).cast("int")
    return full.join(from_, "first").crossJoin(has.toDF("both")).select("pair", weight.alias("weight"))


def scan(docs: DataFrame, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and spans: arrays of struct<start, kind, end, match> in order
    of start, then kind (0 assign, 1 access, 2 hex, 3 random). Columns of these names are replaced, others are carried
    whatever their names."""
    if {c.lower() for c in docs.columns} & {*INNER, *MADE}:
        return carried(docs, ["text"], list(MADE), lambda own: scan(own, least, limit))
    found = base(docs)
    model = materialize(fit(found), "secret-model")
    table = model.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "weight"))), lambda x: x["weight"]).alias("_w"))
    found = found.crossJoin(F.broadcast(table))
    tag = lambda col, k: F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    found = found.withColumn("base_spans", F.array_sort(F.concat(tag("_assign", 0), tag("_access", 1), tag("_hex", 2))))
    llr = lambda s: F.aggregate(
        F.sequence(F.lit(1), F.char_length(s) - 1),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.get(F.col("_w"), F.instr(F.lit(ALPHABET), F.substring(s, i, F.lit(1))) * 63 + F.instr(F.lit(ALPHABET), F.substring(s, i + 1, F.lit(1)))),
    )
    free = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    secret = lambda s: (s["end"] - s["start"] >= least) & s["match"].rlike(TOLD) & free(s) & (llr(s["match"]) > limit * F.char_length(s["match"]))
    moved = lambda s: F.transform(spans(s["match"], STRETCH), lambda x: F.struct((x["start"] + s["start"]).alias("start"), (x["end"] + s["start"]).alias("end"), x["match"].alias("match")))
    parts = F.flatten(F.transform("_runs", lambda s: F.when(secret(s), F.array(s)).otherwise(F.filter(moved(s), secret))))
    more = F.when(F.size("_runs") > 0, parts).otherwise(F.col("_runs"))
    found = found.withColumn("spans", F.array_sort(F.concat("base_spans", tag(more, 3))))
    n = {f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS[:3]}
    return found.withColumns(n).drop("_text", "_assign", "_access", "_hex", "_runs", "_w")


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
