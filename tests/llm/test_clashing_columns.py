"""Columns that bear the names an operator uses inside or adds come back as they were, or are replaced as documented."""

import pytest
from pyspark.sql import functions as F

from martline.llm import bpe, lines, periodic, quality, queries, secrets, spotpairs, urlfilter
from martline.llm.rowkey import KEY

TEXT = "one two three of the words in a line\nof the words that stand here by themselves\npassword = hunter22x9"
INSIDE = [
    *KEY[1:], "_key_doc_id", "_key_row_hash", "_text", "_w", "_s", "_l", "_h", "_g", "_r", "_p", "_q", "_gone", "_lines", "_left", "_id", "_hash", "_first", "_assign", "_access", "_hex", "_runs",
    "fired", "kept", "place", "node", "bands", "bucket", "id", "content", "places", "at", "n", "own", "class", "set", "least", "component", "fingerprint_set", "_carried", "_range", "_end",
]
MADE = ["n_lines", "n_kept", "fingerprint", "class_id", "spans", "base_spans", "n_assign", "base_failed", "runs", "collapsed", "ids", "decoded"]


def _docs(spark, rows=((1, TEXT), (1, TEXT), (2, TEXT + " more"), (None, None), (None, "x y z"))):
    docs = spark.createDataFrame(list(rows), "doc_id long, text string").withColumn("lang", F.lit("en"))
    return docs.withColumns({c: F.lit(f"was {c}") for c in INSIDE + MADE})


def _check(out, docs, replaced):
    assert len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert all(row[c] == f"was {c}" for c in INSIDE + MADE if c not in replaced), row
    return rows


def test_lines(spark):
    docs = _docs(spark)
    rows = _check(lines.dedup_lines(docs), docs, {"n_lines", "n_kept"})
    plain = lines.dedup_lines(docs.select("doc_id", "text")).collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["n_lines"], r["n_kept"])
    assert sorted(map(key, rows)) == sorted(map(key, plain))


def test_spotsigs(spark):
    docs = _docs(spark)
    rows = _check(spotpairs.near_duplicates(docs), docs, {"fingerprint", "class_id"})
    assert {r["class_id"] for r in rows if r["doc_id"] == 1} == {1}


def test_secrets(spark):
    docs = _docs(spark)
    rows = _check(secrets.scan(docs), docs, set(secrets.MADE))
    assert sorted((r["n_assign"], len(r["spans"])) for r in rows) == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1)]


def test_quality(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels)
    rows = _check(out, docs, set(quality.MADE))
    assert "text" not in out.columns and [r["n_words"] for r in rows if r["doc_id"] == 2] == [21]
    with pytest.raises(ValueError):
        quality.judge(docs, labels, stratum="fired")


def test_runs_and_tokens(spark):
    docs = _docs(spark)
    _check(periodic.find_runs(docs), docs, {"runs", "collapsed"})
    _check(bpe.code(docs, queries.RANKS, queries.PATTERN), docs, {"ids", "decoded"})


def test_urls(spark):
    pages = spark.createDataFrame([(1, "https://example.com/en/a"), (1, None)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "listed", "_rule", "a", "b", "shard")})
    out = urlfilter.verdicts(pages)
    assert len(out.columns) == len(set(out.columns)) and {(r["listed"], r["_rule"]) for r in out.collect()} == {("x", "x")} and sorted(r["verdict"] for r in out.collect()) == ["allow", "block"] and {r["a"] for r in out.collect()} == {"x"}
