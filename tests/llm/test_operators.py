import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import compare
from martline.llm import bpe, chat, lines, links, mixing, neardup, quality, secrets, sketch, spotsigs, toxicity, urlfilter
from martline.llm.queries import ORACLES, QUERIES
from martline.plans.storage import materialize

SF = "/root/testdata/sf0.001"
LONG = "word " * 4000 + "x" * 3000
TEXTS = [(1, "the cat sat on the mat with a hat\nsame line here again"), (2, "the cat sat on the mat with a hat\nsame line here again"), (3, None), (4, ""), (5, " \n\t"), (None, "a null id"), (6, LONG), (6, LONG), (7, "token = \"abcdef0123456789abcdef0123456789\" </s> é ß 日本"), (8, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i != 8 else None, None if i == 4 else "s", len(t or ""), "x", 0, 1.5) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, score double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    compare.compare(spark, QUERIES[name], ORACLES[name], SF)


def forms(odd, labels):
    return {
        "quality": lambda d: quality.judge(d, labels), "spotsigs": lambda d: spotsigs.with_next(spotsigs.with_fingerprint(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "f"), ["text"]),
        "lines": lines.dedup_lines, "neardup": neardup.near_duplicates, "mixing": mixing.mix, "secrets": secrets.scan,
        "bpe": lambda d: bpe.code(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "toxicity": lambda d: toxicity.score(d, labels),
    }


@pytest.mark.parametrize("name", ["quality", "spotsigs", "lines", "neardup", "mixing", "secrets", "bpe", "toxicity"])
def test_odd_rows_and_empty_tables(odd, labels, name):
    form = forms(odd, labels)[name]
    assert len(form(odd).collect()) == len(TEXTS)
    assert form(odd.limit(0)).collect() == []


def test_near_duplicates_of_odd_rows(odd):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd, width=2).collect())
    assert ("2", 12, 1, False) in got and ("1", 12, 1, True) in got and ("3", 0, 3, True) in got and ("8", 1, 8, True) in got


def _sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def _components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = _sets(rows, 2)
    want = _components(sets)
    for r in QUERIES["op5_near_dedup"](spark, SF).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_a_large_group_of_near_copies_goes_through_pivots_and_blocks(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(100)]
    rows = [(n, " ".join(w for w in base if rng.random() > rate)) for n, rate in enumerate(rng.choice([0.01, 0.05, 0.1], 120))]
    want = _components(_sets(rows, 2))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == want


def _packed():
    def unpack(contents):  # made here, so that tasks get it by value
        sets = [np.unique(np.array([int(x) for x in t.split()], np.uint64)) for t in contents.to_pylist()]
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    return unpack


@pytest.mark.parametrize("block", [5, 64])
def test_what_pivots_leave_equals_all_pairs_of_its_buckets(spark, block):
    rng = np.random.default_rng(block)
    kept = {i: {int(x) for x in range(40 * (i % 3), 40 * (i % 3) + 40) if rng.random() > 0.09} for i in range(90)}
    component = {i: i if i % 4 else i % 3 for i in kept}
    members = sorted({(int(b), i, component[i]) for i in kept for b in rng.integers(0, 12, 4)})
    by = [{i for b, i, _ in members if b == k} for k in range(12)]
    alike = {(component[a], component[b]) for m in by for a in m for b in m if component[a] < component[b] and 100 * len(kept[a] & kept[b]) >= 80 * len(kept[a] | kept[b])}
    members = materialize(spark.createDataFrame(members, "bucket long, id long, component long"), "members")
    contents = materialize(spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in kept.items()], "id long, content string"), "contents")
    found = [(r["a"], r["b"]) for r in links._rest(members, contents, _packed(), 80, block).collect()]
    assert all(100 * len(kept[a] & kept[b]) >= 80 * len(kept[a] | kept[b]) for a, b in found)
    assert alike and alike <= {tuple(sorted((component[a], component[b]))) for a, b in found}


def test_chained_buckets_are_not_one_group(spark, monkeypatch):
    """buckets joined by common members were one group, and all its members were compared with all others."""
    import pyarrow as pa

    # 40 buckets of 30 members, each with one member of the next
    rows = [(k, n, n // 30 * 30 if n % 30 < 20 else n) for k in range(40) for n in range(30 * k, 30 * k + 31)]
    members = materialize(spark.createDataFrame(rows, "bucket long, id long, component long"), "members")
    contents = materialize(spark.createDataFrame([(n, str(n)) for n in range(1201)], "id long, content string"), "contents")
    monkeypatch.setattr(links, "_block", lambda unpack, percent: lambda t: pa.table({"a": pa.array([t.num_rows], pa.int64()), "b": pa.array([0], pa.int64())}))
    sizes = [r["a"] for r in links._rest(members, contents, _packed(), 80, 32).collect()]
    assert max(sizes) <= 64 and sum(sizes) <= 2 * len(rows)


def test_sets_without_repeats_are_sorted_within_their_owners():
    rng = np.random.default_rng(2)
    for count in (1, 300, 70_000):
        owner = np.sort(rng.integers(0, count, 90_000))
        elements = rng.integers(0, 9, 90_000).astype(np.uint64) << np.uint64(61)
        got = list(zip(*(x.tolist() for x in sketch.distinct(elements, owner, count))))
        assert got == sorted(set(zip(elements.tolist(), owner.tolist())), key=lambda x: (x[1], x[0]))


def test_lines_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").collect()]
    seen = {}
    for i, t in sorted(rows):
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                seen.setdefault(line, (i, p))
    sets = {at: {x[k : k + 8] for k in range(max(1, len(x) - 7))} for x, at in seen.items()}
    first = set(_components(sets).values())
    for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == "\n".join(x for p, x in enumerate(text.split("\n")) if not x.strip() or (r["doc_id"], p) in first)


def test_bpe_equals_tiktoken(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for r in bpe.code(docs.select("doc_id", F.col("text").alias("own"), "text"), path, public_tokenizers.PATTERN).collect():
        text = r["own"] or ""
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == other.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


@pytest.mark.parametrize("head", [0, 5, 400])
def test_block_max_search_equals_a_full_scan(head):
    rng = np.random.default_rng(3)
    found = [np.unique(rng.choice(40, rng.integers(0, 9))) for _ in range(700)]
    owner, terms = np.repeat(np.arange(700), [len(x) for x in found]), np.concatenate(found)
    counts, weight = rng.integers(1, 4, len(terms)), rng.random(40) + 0.1
    dense = np.zeros((700, 40))
    dense[owner, terms] = (1 + np.log(counts)) * weight[terms]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    old, new = owner < 500, owner >= 500
    index = toxicity.Index(np.arange(500), rng.integers(0, 2, 500), owner[old], terms[old], counts[old], weight, weight, 0.5, block=16, head=head)
    own = rng.integers(0, 500, 200).tolist()
    rows, cosines = index.nearest(own, owner[new] - 500, terms[new], counts[new], 10)
    every = dense[500:] @ dense[:500].T
    every[np.arange(200), own] = 0
    assert np.allclose(cosines, -np.sort(-every, axis=1)[:, :10], atol=3e-6)
    assert all(x not in index.ids[r[c > 0]] for x, r, c in zip(own, rows, cosines))


def _scores(docs, labels, evidence):
    """The calibrated scores of one row a document by a full scan, as toxicity describes them. The neighbours given as
    ``evidence`` must be the nearest ones, up to cosines that differ in the seventh digit."""
    words = {i: Counter(toxicity.words(t)) for i, t in docs}
    known = {i: t for i, t in labels.items() if i in words}
    examples = [i for i in known if words[i]]
    terms = sorted(set().union(*(words[i] for i in examples)))
    number = {w: k for k, w in enumerate(terms)}
    seen, pos, neg = np.zeros((3, len(terms)))
    for i, c in words.items():
        at = [number[w] for w in c if w in number]
        seen[at] += 1
        if i in known:
            (pos if known[i] else neg)[at] += 1
    p, q = sum(known.values()), len(known) - sum(known.values())
    chi = (pos * (q - neg) - neg * (p - pos)) ** 2 * (p + q) / np.maximum((pos + neg) * (p + q - pos - neg) * p * q, 1)
    tell, rate = np.maximum(chi - 1, 0) / (p + q), p / (p + q)
    weight = np.log((len(docs) + 1) / (seen + 1)) + 1
    vector = np.zeros((len(docs), len(terms)))
    for r, (i, _) in enumerate(docs):
        for w, n in words[i].items():
            if w in number:
                vector[r, number[w]] = (1 + np.log(n)) * weight[number[w]]
    vector /= np.maximum(np.linalg.norm(vector, axis=1), 1e-12)[:, None]
    place = {i: r for r, (i, _) in enumerate(docs)}
    cosines = vector @ vector[[place[i] for i in examples]].T
    column, share = {e: k for k, e in enumerate(examples)}, {}
    for i, _ in docs:
        near, cosine = evidence[i], cosines[place[i]]
        best = sorted((c for c, e in zip(cosine, examples) if e != i and c > 1e-6), reverse=True)[: toxicity.NEIGHBOURS]
        assert i not in near and len(set(near)) == len(near) == len(best)
        assert np.allclose([cosine[column[e]] for e in near], best, atol=3e-6)
        votes = [(vector[place[i]] * vector[place[e]]) @ tell for e in near]
        toxic = sum(v * known[e] for v, e in zip(votes, near)) + toxicity.PRIOR * rate
        share[i] = toxic / (sum(votes) + toxicity.PRIOR) if near else -1
    bins = {b: [] for b in range(-1, toxicity.BINS)}
    for i, t in known.items():
        bins[-1 if share[i] < 0 else min(int(share[i] * toxicity.BINS + 1e-9), toxicity.BINS - 1)].append(t)
    level = lambda b: (sum(bins[b]) + rate) / (len(bins[b]) + 1)
    curve = list(toxicity._pooled(*map(np.array, zip(*[(level(b), len(bins[b]) + 1) for b in range(toxicity.BINS)]))))
    curve.append(curve[-1])
    out = {}
    for i, s in share.items():
        low = int(s * (toxicity.BINS - 1))
        out[i] = level(-1) if s < 0 else min(1, max(0, curve[low] + (curve[low + 1] - curve[low]) * (s * (toxicity.BINS - 1) - low)))
    return out


def test_toxicity_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    want = _scores(docs, labels, {i: r["evidence"] for i, r in got.items()})
    assert set(got) == set(want)
    assert all(abs(got[i]["score"] - want[i]) < 1e-6 for i in want)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())


@pytest.mark.parametrize(("shard", "limit"), [(1 << 20, 1 << 20), (100, 1)])
def test_cascade_is_exact_on_its_universe(spark, shard, limit):
    universe = materialize(spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), (F.col("id") % 5 == 0).alias("listed")), "universe")
    filters, shards = urlfilter.build(universe, shard)
    rows = universe.collect()
    a, b = (np.array([r[c] for r in rows]) for c in "ab")
    got = np.zeros(len(rows), bool)
    groups = list(urlfilter.groups(filters, limit))
    for group in groups:
        for s, levels in group.items():
            at = a % shards == s
            got[at] = urlfilter.lookup(levels, a[at], b[at])
    assert got.tolist() == [r["listed"] for r in rows] and filters.filter("level > 0").count() > 0 and (len(groups) == 1) == (shards == 1)


def test_urls_in_many_shards_long_and_repeated(spark):
    rows = [(k % 400, f"https://h{k % 400}.{'casino' if k % 7 == 0 else 'fine'}.org/{'x' * (20_000 if k == 5 else 3)}") for k in range(800)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    for shard, limit in ((1 << 20, 64 << 20), (50, 1)):
        got = urlfilter.verdicts(pages, shard=shard, limit=limit).collect()
        assert len(got) == 800 and all((r["verdict"] == "block") == (".casino." in r["url"]) for r in got)
    assert urlfilter.verdicts(pages.limit(0)).collect() == []


def test_secrets_are_found_beside_the_base_patterns(spark):
    rng, chars = random.Random(5), "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    draw = lambda n: "".join(rng.choices(chars, k=n))
    forms_ = [lambda: draw(20), lambda: draw(32), lambda: "/static/assets/documents/" + draw(32), lambda: "session_identifier=" + draw(20), lambda: base64.b64encode(rng.randbytes(30)).decode()]
    plain = [lambda: f"/usr/local/lib/python3/site-packages/module{rng.randint(1, 99)}", lambda: "_".join(rng.choices(["load", "file", "by", "name", "v2", "index"], k=6)), lambda: "".join(rng.choices("0123456789", k=16))]
    planted = [(10**6 + k, f"see {(forms_ if k < 500 else plain)[k % (5 if k < 500 else 3)]()} here", None) for k in range(800)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(None).cast("string").alias("spans"))
    found = secrets.scan(docs.unionByName(spark.createDataFrame(planted, docs.schema))).filter("doc_id >= 1000000").select("doc_id", F.exists("spans", lambda s: s["kind"] == 3).alias("hit")).collect()
    recall, wrong = (np.mean([r["hit"] for r in found if (r["doc_id"] < 10**6 + 500) == true]) for true in (True, False))
    assert recall >= 0.95 and wrong <= 0.05


def test_urls_without_host(spark):
    rows = urlfilter.verdicts(spark.createDataFrame([(None, 1), ("x", 2), ("http://A.com", 3), ("http://a.NET/es/?q", 4)], "url string, host int")).collect()
    assert sorted((r["url"] or "", r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == [("", "", "", None, "allow"), ("http://A.com", "a.com", "", None, "allow"), ("http://a.NET/es/?q", "a.net", "/es/", "net/es/", "block"), ("x", "", "", None, "allow")]


def test_chat_tree_shares_turns_and_reads_back(spark):
    shared = [(c, 0, "user", "hi <s> \\") for c in (1, 2, 3)] + [(1, 1, "assistant", "a"), (2, 1, "assistant", "b[/INST]"), (3, 1, "we]ird", None), (None, 0, None, "[ROLE ")]
    nodes, leaves = chat.build(spark.createDataFrame(shared, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 5
    got = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in chat.read_back(nodes, leaves).collect()}
    assert got[2] == ([("user", "hi <s> \\"), ("assistant", "b[/INST]")], "b[/INST]") and got[3][0][1] == ("we]ird", "") and got[None][0] == [("", "[ROLE ")]
    assert all(sum(a["end"] - a["start"] for a in r["attends"]) == r["position"] + r["end"] - r["start"] for r in nodes.collect())
    empty = chat.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(*empty).collect() == []


@pytest.mark.parametrize("parts", [1, 23])
def test_chat_trees_of_deep_repeated_and_tied_rows(spark, parts):
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab"), "x") for c in range(300) for t in range(rng.choice([1, 2, 3, 5, 8]))]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"x{t // 7 if t < 900 or c == 1000 else t}", "x") for c in (1000, 1001) for t in range(1000)]
    rows += [(None, None, None, None, None), (None, 1, "sys]tem\\", "</s>\n", None), (5000, 1, "user", "q" * 100_000, None), (5000, 1, "user", "q" * 100_000, None), (5000, 1, "assistant", "q", None)]
    want: dict = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    want = {c: [x[2:] for x in sorted(v)] for c, v in want.items()}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        nodes, leaves = chat.build(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, node string"))
        assert {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in chat.read_back(nodes, leaves).collect()} == want
        nodes = sorted(nodes.collect(), key=lambda r: (r["tree"], r["start"]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(nodes) == len({tuple(v[: k + 1]) for v in want.values() for k in range(len(v))})
    for before, node in zip([None, *nodes], nodes):
        assert node["start"] == (before["end"] if before and before["tree"] == node["tree"] else 0) and node["end"] - node["start"] == len(node["segment"])


def test_certified_cutoffs_need_evidence(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))
    docs = labels.select("doc_id", F.when(F.col("quality") == 1, F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("doc_id")) for k in range(30)])).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"###{k}$$"), F.col("doc_id")) for k in range(30)])).alias("text"), F.lit("en").alias("lang"))
    out = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    assert sorted((r["quality"], r["kept"], r["count"]) for r in out) == [(0, False, 400), (1, True, 3600)]
    few = quality.judge(docs.limit(50), labels.limit(50))
    assert few.filter("not kept").count() == 0


def test_mix_meets_targets_with_weights(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"), (F.col("id") % 4 + 1).cast("double").alias("w"))
    for weight in (None, "w"):
        sums = mixing.mix(docs, weight).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 7 and r["most"] <= 2 for r in sums)


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(hashlib.sha256(b"").hexdigest()) == len(out.first()["decoded_sha256"])


@pytest.mark.parametrize("held", [2, 1 << 19])
def test_components_of_chains_and_hubs(spark, held):
    rng = np.random.default_rng(3)
    chain = [(int(a), int(a) + 1) for a in rng.permutation(300)]
    hub = [(5000 + k, 5000 + int(k * rng.random())) for k in range(1, 200)]
    loose = [(int(a), int(b)) for a, b in rng.integers(10_000, 10_400, (250, 2))]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in chain + hub + loose:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    want = {(x, root(x)) for x in up if root(x) != x}
    got = [tuple(r) for r in links.components(spark.createDataFrame(chain + hub + loose + chain[:9], "a long, b long").repartition(16), held).collect()]
    assert len(got) == len(want) and set(got) == want
    assert links.components(spark.createDataFrame([], "a long, b long")).collect() == []
