from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from martline.llm import lines, neardup
from martline.llm.rowkey import KEY, keyed

GOOD = " ".join(f"alpha{i}" for i in range(40))
OTHER = " ".join(f"beta{i}" for i in range(40))
THIRD = " ".join(f"gamma{i}" for i in range(40))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def _kept(out):
    return Counter((r["doc_id"], r["text"]) for r in out.collect())


def test_keys_are_unique(spark):
    docs = keyed(_docs(spark, [(1, "a"), (None, "b"), (None, "b"), (None, None), (None, None), (2, "x"), (2, "y"), (2, "y")]))
    assert docs.count() == 8 == docs.select(*KEY).distinct().count()


def test_each_row_meets_its_own_quality_verdict(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _docs(spark, [(None, GOOD), (None, "too short"), (7, OTHER), (7, "short"), (8, THIRD)])
    assert _kept(corpus_pipeline.quality_rules(spark, docs, str(tmp_path))) == Counter({(None, GOOD): 1, (7, OTHER): 1, (8, THIRD): 1})


def test_one_row_of_a_group_stays_and_no_other_goes(spark):
    rows = [(None, GOOD), (None, OTHER), (None, OTHER), (1, GOOD), (7, THIRD), (7, THIRD), (7, GOOD), (9, None), (9, None)]
    got = _kept(corpus_pipeline.near_dedup(spark, _docs(spark, rows), ""))
    assert got == Counter({(1, GOOD): 1, (None, OTHER): 1, (7, THIRD): 1, (9, None): 2})
    assert neardup.near_duplicates(_docs(spark, rows)).filter("kept").count() == 5


def test_lines_go_from_their_own_row_alone(spark):
    rows = [(1, "a line of the first document"), (None, "a line of the first document\nends with words of its own"), (None, "something not written elsewhere\nand one more sentence here"), (5, "repeated whole document text"), (5, "repeated whole document text"), (5, "unlike all of the other rows")]
    got = Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(_docs(spark, rows)).collect())
    assert got == Counter({
        (1, rows[0][1]): 1, (None, "ends with words of its own"): 1, (None, rows[2][1]): 1, (5, rows[3][1]): 1, (5, ""): 1, (5, rows[5][1]): 1,
    })


def test_the_mix_takes_each_row_by_its_own_copies(spark):
    rows = [(None, "word " * (k % 5 + 1) + str(k)) for k in range(60)] + [(k, "other " * 4) for k in range(30)]
    docs = _docs(spark, rows).withColumn("source", F.when(F.col("doc_id").isNull(), "x").otherwise("y"))
    out = corpus_pipeline.source_mix(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()
    from martline.llm import mixing

    want = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(r["words"] - want[r["source"]]) <= 6 for r in out)
