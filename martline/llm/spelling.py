"""Spelling variants: words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary is cut into classes of words of L and of L + 1 letters, and every class into groups that share a beginning
or an end: an edit at or after the middle leaves the first half as it is, one before it the second half. So a group stands
for one state that the two acceptors enter together after the shared letters, and only what lies between these is searched
from there. Each word enters four groups. Groups of more than ``MOST`` words are halved once more in the same way, again
and again if need be; the last step leaves words that are equal but for one place.

In a group, the words' middles make a minimised acceptor A. Its composition A o T o A with the transducer T of exactly one
edit has states (a, edited or not, b). Before the edit both sides read the same letters and stand in one state; after it
they go on together as long as both have the arc. A pair is accepted where both end after an edit. An inserted letter is
taken at its last possible place, so that each pair has one path, and a group lists only pairs that differ first before
its bound, so that it belongs to one group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martline.plans.storage import drop, materialize

#: Letters and occurrences that a word has at least; how many times more often its usual form occurs.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: Words that a group has at most, unless they differ in one place alone.
MOST = 4096
#: Words that a task counts before it passes the counts on.
HELD = 1 << 17


def _counted(letters: int, edit: Callable[[str, str], str] | None):
    """(word, n) of the texts of a task, in parts."""
    find = re.compile(f"[a-zÀ-ÿ]{{{letters},}}").findall

    def batch_of(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # lower() of bytes changes A-Z alone
                for word, n in Counter(find((text or "").encode().lower().decode())).items():
                    if edit:
                        word = edit(doc, word)
                        if len(word) < letters:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield batch_of(held)
                    held = {}
        yield batch_of(held)

    return run


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, edit: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n) of the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of ``text`` that have ``letters`` code
    points or more and occur ``occurrences`` times or more.

    ``edit`` (doc_id as text, word) -> word may change the words of a document first; a null id is the empty text there. A
    null text has no words; repeated rows count each time; other columns are not read."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    counts = rows.mapInArrow(_counted(letters, edit), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """(arcs, final) of the least deterministic acceptor of ``words``, which are distinct and in order; 0 is its start."""
    arcs: list[dict[str, int]] = [{}]
    final, known, path, before = [False], {}, [], ""

    def shared(length: int) -> None:
        while len(path) > length:
            parent, letter, state = path.pop()
            arcs[parent][letter] = known.setdefault((final[state], tuple(arcs[state].items())), state)

    for word in words:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        shared(common)
        state = path[-1][2] if path else 0
        for letter in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[state][letter] = len(arcs) - 1
            path.append((state, letter, len(arcs) - 1))
            state = len(arcs) - 1
        final[state] = True
        before = word
    shared(0)
    return arcs, final


def accepted_pairs(words: list[str], bound: int) -> Iterator[tuple[str, str]]:
    """Every pair (x, y) of ``words`` (distinct, in order) with y one letter replaced or one letter inserted in x, that
    differs first before the letter ``bound``; once each."""
    arcs, final = acceptor(words)

    def together(a: int, b: int, but: str = "") -> Iterator[str]:
        """What both states accept, not beginning with ``but``."""
        todo = [(a, b, "")]
        while todo:
            a, b, z = todo.pop()
            if final[a] and final[b]:
                yield z
            few, many = sorted((arcs[a], arcs[b]), key=len)
            todo += [(arcs[a][c], arcs[b][c], z + c) for c in few if c in many and (z or c != but)]

    todo = [(0, "")]
    while todo:
        state, before = todo.pop()
        if len(before) >= bound:
            continue
        for c, d in combinations(arcs[state], 2):
            for z in together(arcs[state][c], arcs[state][d]):
                yield before + c + z, before + d + z
        for d, after in arcs[state].items():
            for z in together(state, after, d):
                yield before + z, before + d + z
        todo += [(after, before + c) for c, after in arcs[state].items()]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, near_n), both ways round, of the pairs of each group; rows come by group and word."""
    out: list[tuple[str, int, str, int]] = []

    def rows() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["word", "n", "near", "near_n"])

    def search(group: tuple, held: dict[str, int]) -> None:
        if len(held) < 2:
            return
        length, begin, end, bound = group[:4]
        some = next(iter(held))
        head, tail = some[:begin], some[len(some) - end :]
        middles = sorted(w[begin : len(w) - end] for w in held)
        for x, y in accepted_pairs(middles, bound - begin):
            x, y = head + x + tail, head + y + tail
            if len(x) == length:  # pairs of the longer words are of the next class
                out.extend(((x, held[x], y, held[y]), (y, held[y], x, held[x])))

    group, held = None, {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("length", "begin", "end", "bound", "head", "tail", "word", "n")]
        for *key, word, n in zip(*columns):
            if (key := tuple(key)) != group:
                search(group, held)
                group, held = key, {}
                if len(out) > HELD:
                    yield rows()
                    out.clear()
            held[word] = n
    search(group, held)
    yield rows()


def _halved(rows: DataFrame) -> DataFrame:
    """Every row in two groups: what it shares grows by the first half of its middle, or by the other half."""
    half = F.floor((F.col("length") - F.col("begin") - F.col("end")) / 2).cast("int")
    rest = F.col("length") - F.col("begin") - half
    first = F.struct((F.col("begin") + half).alias("begin"), F.col("end"), F.col("bound"))
    second = F.struct(F.col("begin"), rest.cast("int").alias("end"), (F.col("begin") + half).alias("bound"))
    both = rows.select("word", "n", "length", F.explode(F.array(first, second)).alias("x")).select("word", "n", "length", "x.*")
    return both.withColumns({"head": F.expr("left(word, begin)"), "tail": F.expr("right(word, end)")})


GROUP = ["length", "begin", "end", "bound", "head", "tail"]


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): for every word of ``words`` (word, n; distinct, ``LETTERS`` letters or more) those with
    exactly one letter inserted, deleted or replaced. Each pair comes once from either side."""
    size = F.char_length("word")
    classed = words.filter(size >= 2).select("word", "n", F.explode(F.array(size, size - 1)).alias("length"))
    whole = classed.withColumns({"begin": F.lit(0), "end": F.lit(0), "bound": F.col("length") + 1})
    todo, groups = materialize(_halved(whole), "halves"), []
    while True:
        # a group without two letters between its ends cannot be halved
        hot = todo.filter("length - begin - end > 1").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > most).select(*GROUP)
        hot = materialize(hot, "hot-groups")
        if hot.isEmpty():
            groups.append(todo)
            break
        groups.append(materialize(todo.join(hot, GROUP, "left_anti").select(*todo.columns), "groups"))
        todo = materialize(_halved(todo.join(hot, GROUP, "left_semi").select(*todo.columns)), "halves")
    rows = groups[0]
    for more in groups[1:]:
        rows = rows.unionByName(more)
    dealt = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "word")
    return dealt.mapInArrow(_composed, "word string, n long, near string, near_n long")


def forms(words: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word. form: the near word that occurs most often (of equal ones the
    first by code points), if that is ``times`` times as often as the word or more; root: where forms lead in the end.

    Each form occurs more often than its word, so forms never lead round; their ends are found by doubling."""
    told = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    usual = words.join(told, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))
    enough = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    usual = materialize(usual.select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms")
    leads = materialize(usual.filter("form is not null").select("word", F.col("form").alias("root")), "leads")
    while True:
        ahead = leads.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialize(leads.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "leads")
        drop(leads)
        ended, leads = further.filter("moved").isEmpty(), further
        if ended:
            break
    return usual.join(leads.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, edit: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``docs`` (doc_id, text); empty for an empty table."""
    words = materialize(vocabulary(docs, edit=edit), "words")
    return forms(words, near_words(words))
