"""Operator 12: periodic runs of words, by a suffix automaton with link-cut access.

Each text is a sequence of words, worked on for itself. The suffix links of its automaton are a tree whose nodes
are classes of factors; each appended word accesses the path from its prefix to the root. A path segment carries
the place where its factors ended last. Where the segment up to a node of length l ended last at e and now ends at
i, the l words up to i stood d = i - e words before as well, so with l >= d they end a square of period d, and the
latest end makes d the smallest period. Squares with as many periods as are asked for are extended to both sides
to a run; a run of a known period that reaches i is not extended again.

Before that, words that no such run can hold are cut out: every five words in a row of a run recur in it, and
every three of them three times. What is left, usually little, falls into stretches that do not share a run, and
only these reach the automaton, with their words compared as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: A run has at least so many words, and so many periods. The cut relies on these being the least it is used with.
WORDS, TIMES = 6, 4
#: Bytes of text whose results leave a task at a time.
BATCH = 8 << 20


class Automaton:
    """The suffix automaton of a sequence of numbers. length and link by state, prefix: the state of each prefix.
    State 0 means none, state 1 is the empty factor."""

    def __init__(self, word: list[int]) -> None:
        length, link, follow, prefix, last = [0, 0], [0, 0], [{}, {}], [], 1
        for c in word:
            new = len(length)
            length.append(length[last] + 1)
            follow.append({})
            p = last
            while p and c not in (f := follow[p]):
                f[c] = new
                p = link[p]
            if not p:
                link.append(1)
            else:
                q = f[c]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    clone = new + 1
                    link.append(clone)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = clone
                    follow.append(dict(follow[q]))
                    while p and (f := follow[p]).get(c) == q:
                        f[c] = clone
                        p = link[p]
            prefix.append(new)
            last = new
        self.length, self.link, self.prefix = length, link, prefix


def last_ends(auto: Automaton) -> Iterator[tuple[int, int, int]]:
    """(i, l, e): the factor of length l that ends at i ended last at e, l being the longest of its path segment.

    A preferred path is a splay tree by depth, whose root has the path's last end; `up` leads to the tree's parent
    node or, from a root, to the node that the path hangs on. An access joins the segments from a prefix's state to
    the root of all to one path; what hung below them keeps its end.
    """
    up, left, right, end = auto.link[:], [0] * len(auto.link), [0] * len(auto.link), [-1] * len(auto.link)
    length = auto.length
    for i, v in enumerate(auto.prefix):
        below, x = 0, v
        while x:
            # splay x: two steps at a time to the root of its tree
            p = up[x]
            if p and (left[p] == x or right[p] == x):
                while True:
                    g = up[p]
                    inner = g and (left[g] == p or right[g] == p)
                    if inner:
                        gg = up[g]
                        if (left[g] == p) == (left[p] == x):
                            # p over g first
                            if left[g] == p:
                                b = right[p]
                                left[g], right[p] = b, g
                            else:
                                b = left[p]
                                right[g], left[p] = b, g
                            if b:
                                up[b] = g
                            up[g] = p
                            if left[p] == x:
                                b = right[x]
                                left[p], right[x] = b, p
                            else:
                                b = left[x]
                                right[p], left[x] = b, p
                            if b:
                                up[b] = p
                            up[p] = x
                        else:
                            # x over p, then over g
                            if left[p] == x:
                                b, c = right[x], left[x]
                                left[p], right[g], right[x], left[x] = b, c, p, g
                            else:
                                b, c = left[x], right[x]
                                right[p], left[g], left[x], right[x] = b, c, p, g
                            if b:
                                up[b] = p
                            if c:
                                up[c] = g
                            up[p] = up[g] = x
                        up[x] = gg
                        top = g
                    else:
                        if left[p] == x:
                            b = right[x]
                            left[p], right[x] = b, p
                        else:
                            b = left[x]
                            right[p], left[x] = b, p
                        if b:
                            up[b] = p
                        up[p] = x
                        up[x] = gg = g
                        top = p
                    if gg and left[gg] == top:
                        left[gg] = x
                    elif gg and right[gg] == top:
                        right[gg] = x
                    else:
                        end[x] = end[top]
                        break
                    p = gg
            if end[x] >= 0 and length[x]:
                yield i, length[x], end[x]
            # what was below x on its path hangs on x now, the accessed path takes its place
            if r := right[x]:
                end[r] = end[x]
            right[x] = below
            below, x = x, up[x]
        end[below] = i


def runs(word: list[int], words: int = WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with at least `times` (two or more) of their smallest periods and
    `words` words, by start and period."""
    out, known, n = [], {}, len(word)
    for i, l, e in last_ends(Automaton(word)):
        d = i - e
        if l >= (times - 1) * d and known.get(d, -1) < i:
            first, last = i - l - d + 1, i
            while first and word[first - 1] == word[first - 1 + d]:
                first -= 1
            while last + 1 < n and word[last + 1] == word[last + 1 - d]:
                last += 1
            known[d] = last
            if last - first + 1 >= words:
                out.append((first, last - first + 1, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _recurs(ids: np.ndarray, width: int, times: int) -> np.ndarray:
    """Which words lie in `width` words that occur `times` times or more; equal hashes can only add some."""
    key = ids[: len(ids) - width + 1].astype(np.uint64)
    for j in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - width + 1 + j].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    edge = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
    often = np.empty(len(key), bool)
    often[order] = np.repeat(np.diff(edge) >= times, np.diff(edge))
    step = np.zeros(len(ids) + 1, np.int64)
    step[:-width][often] += 1
    step[width:][often] -= 1
    return np.cumsum(step[:-1]) > 0


def stretches(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words outside which no run of WORDS words and TIMES periods has a word; no run is in two."""
    if len(ids) < WORDS:
        return
    held = _recurs(ids, 5, 2)
    if not held.any():
        return
    held &= _recurs(ids, 3, 3)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], held, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= WORDS:
            yield a, b


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a list of words."""
    if len(words) < WORDS:
        return []
    ids = pd.factorize(np.array(words, dtype=object))[0]
    found = [(a + s, n, d) for a, b in stretches(ids) for s, n, d in runs(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if found:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            step[start + period] += 1
            step[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list) -> pa.RecordBatch:
        ids, sizes, found, texts = zip(*rows, strict=True)
        flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
        text = pa.array(texts, pa.large_binary()).view(pa.large_string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values), text.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        rows, size = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").cast(pa.large_binary()), strict=True):
            words = text.as_py().split()  # of bytes: at \x20 and \x09-\x0D
            found = text_runs(words)
            rows.append((doc, len(words), found, collapse(words, found)))
            size += len(rows[-1][3])
            if size > BATCH:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs, whose columns doc_id (long) and text alone are read.

    runs: array<struct<start, length, period>> by start, then period: the maximal stretches of consecutive words
    whose smallest period is `period`, with at least WORDS words and TIMES periods. collapsed: the text's words
    without those that a run holds after its first period, joined by one blank. A null, empty or blank text has
    no words, no runs and the collapsed text ''. Repeated rows and doc_ids are returned each for itself. An empty
    table gives an empty result. Nothing is shuffled. A task holds one text at a time: about 60 bytes for each of its words,
    and about 500 more for each word of its longest stretch that repeats itself.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated(doc_id: Column, text: Column) -> Column:
    """The contract's edit of a text: by its doc_id a tenth of all repeat a part of it to their end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def edit(x: Column) -> Column:
        n = F.size(x)
        a = F.pmod(g, n).cast("int")
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))), " ")

    # a one-element array binds the words to one evaluation
    edited = F.element_at(F.transform(F.array(words), lambda x: F.when(F.size(x) > 0, edit(x)).otherwise("")), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), edited).otherwise(text)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of all documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text"))
    # runs are in order, so of equal ones the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = find(docs).withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        _sha(F.array_join(lines, "")).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
