"""All rows of the pipeline against a plain version of its five stages, each of which sees what the one before it kept."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from martline.llm import bpe
from martline.llm.sql import mixing_ctes, quality_ctes

SF = "/root/testdata/sf0.01"
WS = " \t\n\x0b\x0c\r"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def linked(sets):
    """Components (key -> least key) of keys with sets whose coefficient is 0.8 or more, by an index of the rarest elements."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    rare, index = Counter(e for s in sets.values() for e in s), defaultdict(list)
    for k in sorted(sets, key=lambda k: (len(sets[k]), k)):
        own = sets[k]
        head = sorted(own, key=lambda e: (rare[e], e))[: len(own) - -(-4 * len(own) // 5) + 1]
        for other in {o for e in head for o in index[e]}:
            a, b = find(k), find(other)
            if a != b and 5 * len(sets[other]) >= 4 * len(own):
                common = len(own & sets[other])
                if 100 * common >= 80 * (len(own) + len(sets[other]) - common):
                    root[max(a, b)] = min(a, b)
        for e in head:
            index[e].append(k)
    return {k: find(k) for k in sets}


def quality(con, docs):
    con.register("documents", pa.Table.from_pylist(docs, SCHEMA))
    kept = Counter(r[0] for r in con.execute(f"WITH {quality_ctes()} SELECT doc_id FROM judged WHERE kept").fetchall())
    return [d for d in docs if kept[d["doc_id"]]]


def line_dedup(docs):
    first, order = {}, sorted(docs, key=lambda d: (d["doc_id"] is None, d["doc_id"]))
    for d in order:
        for place, line in enumerate((d["text"] or "").split("\n")):
            if line.strip(WS):
                first.setdefault(line, (d["doc_id"], place))
    sets = {at: {line[k : k + 8] for k in range(max(1, len(line) - 7))} for line, at in first.items()}
    stay, out = set(linked(sets).values()), []
    for d in docs:
        every = None if d["text"] is None else d["text"].split("\n")
        left = every and [x for place, x in enumerate(every) if not x.strip(WS) or (d["doc_id"], place) in stay]
        if not any(x.strip(WS) for x in every or []) or any(x.strip(WS) for x in left):
            text = None if every is None else "\n".join(left)
            out.append(d | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def near_dedup(docs):
    sets = {}
    for d in docs:
        w = (d["text"] or "").encode().lower().split()
        if w:
            sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    component = linked(sets)
    return [d for d in docs if component.get(d["doc_id"], d["doc_id"]) == d["doc_id"]]


def mixed(con, docs):
    con.register("staged", pa.Table.from_pylist(docs, SCHEMA))
    copies = dict(con.execute(f"WITH {mixing_ctes('staged')} SELECT doc_id, copies FROM mixed").fetchall())
    return [d for d in docs for _ in range(int(copies[d["doc_id"]]))]


SCHEMA = pq.read_schema(f"{SF}/documents.parquet")


@pytest.mark.parametrize("sf", [SF])
def test_pipeline_equals_its_plain_version(spark, sf):
    docs = [dict(d) for d in pq.read_table(f"{sf}/documents.parquet", columns=COLUMNS).to_pylist()]
    assert len({d["doc_id"] for d in docs}) == len(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    steps = [docs]
    for stage in (lambda d: quality(con, d), line_dedup, near_dedup, lambda d: mixed(con, d)):
        steps.append(stage(steps[-1]))
    assert len(steps[0]) > len(steps[1]) > len(steps[2]) >= len(steps[3]) and any(n > 1 for n in Counter(d["doc_id"] for d in steps[4]).values())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = {t: np.array(other.encode_ordinary(t), "<u4").tobytes() for t in {d["text"] or "" for d in steps[4]}}
    want = Counter((d["doc_id"], d["source"], ids[d["text"] or ""]) for d in steps[4])
    got = Counter((r["doc_id"], r["source"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


ODD = [(1, "a few words that are here\n\n" * 3, "s"), (2, None, None), (3, "", "s"), (3, "", "s"), (None, "words " * 30, "t"), (4, " \n\t", "t"), (5, "z" * 3000 + " w" * 40, None), (5, "other words of one id", "s")]


def _odd(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("n_lines", docs["n_chars"]).withColumn("row_hash", docs["text"])


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "encode"])
def test_stages_of_odd_rows_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _odd(spark, ODD)
    docs = docs.drop("row_hash") if name == "near_dedup" else docs
    out = stage(spark, docs, "")
    rows = out.collect()
    assert stage(spark, docs.limit(0), "").collect() == []
    by = Counter((r["doc_id"], r["text"]) for r in rows) if name != "encode" else None
    if name == "line_dedup":
        assert out.columns == docs.columns
        want = Counter({(i, t): 1 for i, t, _ in ODD} | {(3, ""): 2} | {(1, "a few words that are here\n\n\n\n"): 1})
        del want[1, ODD[0][1]]
        assert by == want and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["row_hash"] == dict((i, t) for i, t, _ in ODD if i == r["doc_id"]).get(r["doc_id"]) for r in rows if r["doc_id"] in (1, 2))
    elif name == "near_dedup":
        assert out.columns == docs.columns and by == Counter((i, t) for i, t, _ in ODD)
    else:
        assert len(rows) == len(ODD) and {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
