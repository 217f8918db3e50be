"""Chat formatting into a prefix tree of turns.

Conversations that share their first turns share them in the output: the tree's node is a run of turns from the start,
formatted once. The trees are laid out depth-first, each from the first turn that its conversations share: a node has the
interval [start, end) of its characters in its tree, the position id of its first character (what stands on the path above
it), and the intervals that it may attend to: its ancestors' and its own, adjacent ones joined.

Sorted by the hashes of their turns, conversations stand in depth-first order: what a conversation has beyond the turns
that it shares with the one before it are the nodes that it adds, and the characters added before it are where these
start. So the distinct paths are sorted by range partitions (a first turn that a third of all conversations share is cut
across many), one pass over each partition keeps the path before as its only state, and what partitions share at their
borders is settled from one summary row of each. The number of Spark jobs does not depend on the depth.

Turns: user "[INST] text [/INST]", assistant " text </s>" after the user's, any other role "[ROLE name] text [/ROLE]";
each begins with "<s>" unless it is an assistant's. Control strings inside texts get a backslash after their first
character, one more if there are some already, which reading back removes; names of roles also escape "]".

Defined cases: null texts and roles are empty; turns go by (turn, role, text), null turns first, so repeated rows stay and
ties have an order; a null conv_id is a conversation of its own; columns other than conv_id, turn, role and text are
ignored; an empty table gives an empty result. One conversation is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martline.plans.storage import materialize

#: What marks turns, without its first character.
TAILS = "/?s>|/?INST\\]|/?ROLE[ \\]]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({TAILS})", "$1$2\\\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)\\\\({TAILS})", "$1$2$3")


def formatted(role: Column, text: Column) -> Column:
    name = F.regexp_replace(escape(role), "([\\\\\\]])", "\\\\$1")
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<s>[ROLE "), name, F.lit("] "), body, F.lit(" [/ROLE]")))
    )


def _read(segment: Column) -> tuple[Column, Column]:
    """(role, text) of a formatted turn."""
    other = "(?s)^<s>\\[ROLE ((?:[^\\\\\\]]|\\\\.)*)\\] (.*) \\[/ROLE\\]$"
    is_user, is_other = segment.startswith("<s>[INST] "), segment.startswith("<s>[ROLE ")
    name = unescape(F.regexp_replace(F.regexp_extract(segment, other, 1), "\\\\([\\\\\\]])", "$1"))
    inner = lambda a, b: F.substring(segment, F.lit(a + 1), F.char_length(segment) - a - b)
    role = F.when(is_user, "user").when(is_other, name).otherwise("assistant")
    return role, unescape(F.when(is_user, inner(10, 8)).when(is_other, F.regexp_extract(segment, other, 2)).otherwise(inner(1, 5)))


def common(a: list, b: list) -> int:
    """How many first elements two lists share."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


#: What a pass over a partition returns. Rows of paths: ``first`` is the first depth that the path adds, ``kept`` how much
#: of the partition's first path it still shares, ``starts`` where its nodes start if nothing stood before the partition,
#: ``positions`` their position ids. The summary row has no leaf, but the partition's first path (keys, lengths), its last
#: one (last, starts, kept) and the total.
WALK = "leaf string, part int, first int, kept int, starts array<bigint>, positions array<bigint>, keys array<string>, lengths array<bigint>, last array<string>, total bigint"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted paths (leaf, keys, lengths) of one partition, as of WALK."""
    part = TaskContext.get().partitionId()
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, WALK.split(", "))])
    before, starts, at, kept, head = [], [], 0, 0, None
    for batch in batches:
        out = {name: [] for name in schema.names}
        for leaf, keys, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
            first = common(before, keys)
            kept = len(keys) if head is None else min(kept, first)
            head = head or (keys, lengths)
            starts = starts[:first]
            for n in lengths[first:]:
                starts.append(at)
                at += n
            before = keys
            for name, value in zip(schema.names, (leaf, part, first, kept, starts, [0, *accumulate(lengths[:-1])], None, None, None, None)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=schema)
    if head is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "kept": kept, "starts": starts, "keys": head[0], "lengths": head[1], "last": before, "total": at}], schema=schema)


def _borders(summaries: Iterator) -> list[tuple[int, int, list[int]]]:
    """(part, shift, carried) of each partition from the summary rows in order: what its starts are raised by, and the
    starts of the nodes that its first path shares with the last path before it."""
    out, before, starts, total = [], [], [], 0
    for row in summaries:
        shared = common(before, row["keys"])
        carried = starts[:shared]
        shift = total - sum(row["lengths"][:shared])
        out.append((row["part"], shift, carried))
        inherited = min(row["kept"], shared)
        before, starts = row["last"], carried[:inherited] + [x + shift for x in row["starts"][inherited:]]
        total = shift + row["total"]
    return out


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves), both over written tables.

    nodes: tree, depth, segment, start, end, position, attends (array of struct<start, end>, in order), loss_start,
    loss_end (interval of an assistant's text in the tree, else null). leaves: conv_id, tree, path (where the nodes of the
    conversation start), attends (what its last node may attend to)."""
    spark = conversations.sparkSession
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = F.struct("turn", text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(rows)).alias("t"))
    # the key of a turn tells role and text apart by the role's length
    key = lambda x: F.md5(F.concat(F.char_length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]).cast("binary"))
    told = turns.select("conv_id", F.transform("t", key).alias("keys"), F.transform("t", lambda x: formatted(x["role"], x["text"])).alias("segments"), F.transform("t", lambda x: x["role"] == "assistant").alias("said"))
    told = materialize(told.withColumn("leaf", F.md5(F.array_join("keys", "").cast("binary"))), "chat-turns")
    paths = told.groupBy("leaf").agg(F.first(F.struct("keys", "segments", "said")).alias("x")).select("leaf", "x.*")
    paths = materialize(paths.withColumn("lengths", F.transform("segments", lambda s: F.char_length(s).cast("long"))), "chat-paths")
    ordered = paths.select("leaf", "keys", "lengths").repartitionByRange("keys").sortWithinPartitions("keys")
    walked = materialize(ordered.mapInArrow(_walk, WALK), "chat-walk")
    borders = _borders(walked.filter("leaf is null").orderBy("part").toLocalIterator())
    borders = spark.createDataFrame(borders, "part int, shift long, carried array<bigint>")
    moved = walked.filter("leaf is not null").select("leaf", "part", "first", "kept", "starts", "positions").join(borders, "part")
    inherited = F.least("kept", F.size("carried"))
    g = F.transform("starts", lambda s, d: F.when(d < inherited, F.get("carried", d)).otherwise(s + F.col("shift")))
    # the first path of a partition adds what the path before the border does not have
    first = F.when(F.col("kept") == F.size("starts"), F.greatest("first", inherited)).otherwise(F.col("first"))
    moved = moved.select("leaf", "positions", first.alias("first"), g.alias("g")).withColumn("g", F.transform("g", lambda s: s - F.col("g")[0]))
    placed = moved.join(paths, "leaf").withColumn("tree", F.col("keys")[0])
    placed = placed.withColumn("e", F.zip_with("g", "lengths", lambda s, n: s + n))
    # depths at which the path jumps: between them the intervals join
    placed = materialize(placed.withColumn("jumps", F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("e", i - 1)))), "chat-placed")
    spans = lambda d: F.transform(
        F.filter("jumps", lambda b: b <= d),
        lambda b, k: F.struct(F.get("g", b).alias("start"), F.get("e", F.least(d, F.coalesce(F.get("jumps", k + 1) - 1, d))).alias("end")),
    )
    node = lambda d: F.struct(
        d.alias("depth"), F.get("segments", d).alias("segment"), F.get("g", d).alias("start"), F.get("e", d).alias("end"), F.get("positions", d).alias("position"),
        spans(d).alias("attends"), F.when(F.get("said", d), F.get("g", d) + 1).alias("loss_start"), F.when(F.get("said", d), F.get("e", d) - 5).alias("loss_end"),
    )
    new = F.when(F.col("first") < F.size("g"), F.transform(F.sequence(F.col("first"), F.size("g") - 1), node))
    nodes = materialize(placed.select("tree", F.inline(new)), "chat-nodes")
    leaves = told.select("conv_id", "leaf").join(placed.select("leaf", "tree", F.col("g").alias("path"), spans(F.size("g") - 1).alias("attends")), "leaf").drop("leaf")
    return nodes, leaves


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>>, loss: what the mask covers, unescaped, formatted) of every conversation,
    from the packed trees alone: the nodes of its path that stand in what its last node may attend to, in order, and the
    loss intervals within them."""
    seen = F.filter("path", lambda s: F.exists("attends", lambda a: (a["start"] <= s) & (s < a["end"])))
    last = leaves.select("conv_id", "tree", F.explode(seen).alias("start"))
    part = last.join(nodes.select("tree", "start", "segment", "loss_start", "loss_end"), ["tree", "start"])
    covered = F.expr("substring(segment, cast(loss_start - start + 1 as int), cast(loss_end - loss_start as int))")
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "segment", covered.alias("loss")))).alias("p"))
    turns = F.transform("p", lambda x: F.struct(_read(x["segment"])[0].alias("role"), _read(x["segment"])[1].alias("text")))
    loss = F.array_join(F.transform("p", lambda x: unescape(F.coalesce(x["loss"], F.lit("")))), "")
    return whole.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("formatted"))
