"""Runs, shards and spelling variants against brute force."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from martline.llm import periodic, queries, sharding, spelling

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, times=3):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        start = 0
        alike = [words[i] == words[i + q] for i in range(n - q)] + [False]
        for i, x in enumerate(alike):
            if not x:
                length = i - start + q
                if i > start and length >= max(least, times * q):
                    found.setdefault((start, length), q)
                start = i + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_made_sequences():
    rng, seen = random.Random(5), 0
    for _ in range(400):
        words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(24, 120))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words)), rng.randrange(1, 20)
            words[at:at] = [rng.randrange(3) for _ in range(p)] * rng.randrange(2, 6) + words[at : at + rng.randrange(p)]
        want = brute_runs(words)
        seen += len(want)
        assert periodic.runs_of(periodic.np.array(words)) == want
    assert seen > 150 and periodic.runs_of(periodic.np.zeros(3000, int)) == [(0, 3000, 1)]


def test_op11_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got, with_runs = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}, 0
    assert got.keys() == docs.keys()
    for doc_id, text in docs.items():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            runs = periodic.runs_of(periodic.np.array([hash(w) for w in words]))  # brute force takes too long
        else:
            runs = brute_runs(words)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        row, with_runs = got[doc_id], with_runs + bool(runs)
        assert (row["start"], row["length"], row["period"]) == best and row["n_runs"] == len(runs)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert row["collapsed_sha256"] == sha(collapsed(words, runs))
    assert with_runs >= 10


def test_runs_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b " * 20, "z"), (2, " \t a\u0085 " * 30, None), (2, " \t a\u0085 " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    got = sorted(((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect()), key=str)
    odd = (2, [(0, 30, 1)], " a\u0085")
    assert got == sorted([(1, [], ""), (1, [], ""), (0, [(0, 40, 2)], "a b"), odd, odd], key=str)
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, times=2)


def check_shards(rows, shards, groups=True):
    """rows: (doc_id, size, group, shard, slot)."""
    size, slots, where = [0] * shards, {}, {}
    for _, s, group, shard, slot in rows:
        size[shard] += s
        slots.setdefault(shard, []).append(slot)
        where.setdefault(group, set()).add(shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(size) / shards
    return max(size) / share - 1, min(size) / share - 1, max((len(x) for x in where.values()), default=1)


@pytest.mark.parametrize("sf,most", [("sf0.001", 0.03), ("sf0.01", 0.002), ("sf0.1", 0.005)])
def test_op12_shards_are_even_and_whole(spark, sf, most):
    root = f"/root/testdata/{sf}"
    rows = queries.op12_sharding(spark, root).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{root}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((k, len(v) + 1, zlib.crc32(v)) for k, v in docs.items())
    above, below, spread = check_shards([(r["doc_id"], r["size"], docs[r["doc_id"]], r["shard"], r["slot"]) for r in rows], 16)
    assert above <= most and below >= -most and spread == 1
    again = queries.op12_sharding(spark, root).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_hot_groups_and_odd_rows(spark, tmp_path):
    rows = [(1, "same")] * 3000 + [(k, "copy") for k in range(3000)] + [(k, f"text {k} " * (k % 7)) for k in range(2900)] + [(None, None)] * 50 + [(7, "x" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").alias("SLOT"), F.xxhash64("text").alias("g"), F.octet_length("text").alias("size"))
    got = sharding.assign(docs, F.col("g"), F.col("size"), F.col("doc_id"), shards=5)
    told = got.collect()
    assert got.columns == ["doc_id", "g", "size", "shard", "slot"] and len(told) == len(rows)
    check_shards([(r["doc_id"], r["size"] or 0, r["g"], r["shard"], r["slot"]) for r in told], 5)
    assert len({r["shard"] for r in told if r["doc_id"] == 1 and r["size"] == 4}) >= 1
    sharding.write(got, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.assign(docs.limit(0), F.col("g"), F.col("size"), F.col("doc_id")).count() == 0
    one = sharding.assign(docs.filter("doc_id = 7 and size > 30000"), F.col("g"), F.col("size"), F.col("doc_id"), shards=3).collect()
    assert [r["slot"] for r in one] == [0]


def test_hot_keys_are_cut_by_rows_and_bytes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id")).alias("g"), F.lit(10).alias("size"))
    told = sharding.assign(docs, F.col("g"), F.col("size"), F.col("doc_id"), shards=4).collect()
    above, below, spread = check_shards([(r["doc_id"], r["size"], r["g"], r["shard"], r["slot"]) for r in told], 4)
    assert above < 0.01 and below > -0.01 and spread > 1


def test_a_group_that_fits_in_a_shard_stays_whole(spark):
    rows = [(k, "one big group of copies", 10) for k in range(900)] + [(k, f"text {k}", 10) for k in range(3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("g", F.xxhash64("text"))
    told = sharding.assign(docs, F.col("g"), F.col("size"), F.col("doc_id"), shards=4).collect()
    above, below, spread = check_shards([(r["doc_id"], r["size"], r["g"], r["shard"], r["slot"]) for r in told], 4)
    assert above <= 0.0051 and below >= -0.02 and spread == 1


def test_groups_come_apart_where_whole_ones_leave_shards_uneven():
    sizes = {0: (10, 1)} | {k: (6, 1) for k in range(1, 13)}  # three groups of four ranges, then nothing to fill up with
    inner = [(k // 4, sharding.LEAST if k % 4 == 0 else k) for k in range(12)]
    out = sharding.dealt(inner, sizes, 2)
    load = [sum(sizes[k][0] for k, s in out.items() if s == shard) for shard in (0, 1)]
    assert sorted(load) in ([40, 42], [41, 41])


def brute_variants(words, times=5):
    """words: word -> n."""
    near = {w: set() for w in words}
    for w in words:
        shorter = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for x in shorter & words.keys():
            near[w].add(x)
            near[x].add(w)
        for x in words:
            if len(x) == len(w) and sum(a != b for a, b in zip(x, w)) == 1:
                near[w].add(x)
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = [best if best and words[best] >= times * n else None, n, len(near[w])]
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, words[form] if form else None))
    return rows


def test_op13_equals_brute_force(spark):
    import re

    counts = {}
    for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            if len(w) >= 6:
                counts[w] = counts.get(w, 0) + 1
    want = brute_variants({w: n for w, n in counts.items() if n >= 5})
    got = {tuple(r) for r in queries.op13_spelling(spark, SF).collect()}
    assert got == want and sum(r[1] is not None for r in want) > 3


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_near_words_of_made_vocabularies(spark, most):
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))): rng.randrange(5, 2000) for _ in range(400)}
    words |= {"a" * k: 5**k % 1_000_003 + 5 for k in range(6, 12)} | {"ÿ" * 3000: 7, "ÿ" * 3001: 90}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    near = spelling.near_words(table, most=most)
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.forms(table, near).collect()}
    assert got == brute_variants(words) and near.count() == near.distinct().count()


def test_variants_of_odd_rows(spark):
    rows = [(None, "Letter LETTER letter")] * 2 + [(1, None), (2, ""), (3, "lettér " * 5), (3, "lettér " * 25 + "x" * 5000), (4, "short words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "root": F.lit(3)})
    got = {tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == {("letter", "lettér", "lettér", 6, 1, 30), ("lettér", None, "lettér", 30, 1, None)}
    assert spelling.variants(docs.limit(0)).count() == 0


def test_acceptor_is_least_and_right():
    words = sorted({"".join(random.Random(k).choices("ab", k=5)) for k in range(60)})
    arcs, final = spelling.acceptor(words)
    seen, todo = set(), [(0, "")]
    while todo:
        state, word = todo.pop()
        if final[state]:
            seen.add(word)
        todo += [(after, word + c) for c, after in arcs[state].items()]
    assert sorted(seen) == words
    reached, todo = set(), [0]
    while todo:
        if (state := todo.pop()) not in reached:
            reached.add(state)
            todo += arcs[state].values()
    assert len({(final[s], tuple(sorted(arcs[s].items()))) for s in reached}) == len(reached)
