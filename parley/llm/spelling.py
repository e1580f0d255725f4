"""Operator 11: spelling variants, by a bit-sliced position index of the vocabulary.

Two words at one error share their first or their last floor(a / 2) letters, a being the shorter's length; so the
vocabulary is dealt to parts by length class and half. Each part has for every position and letter a bit set over
its words. A query's letters drive all words of a part at once, 64 a machine word: the set without an error, and
the sets with one replaced, inserted or deleted letter, the latter two looking up positions shifted by one. What is
left after the last letter are all near words. A part of many words is cut to slices, and its queries go to each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, load, save
from .pieces import PIECE, pieces

#: What words are made of (fixed value), and the letters in the order of their codes here.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that lower() turns into a letter of a word, or that are one: capital letters outside ASCII (fixed value).
CAPITALS = r"[À-ÞİŸẞKÅ]"
#: Least letters of a word, and least occurrences.
LETTERS, OFTEN = 5, 3
#: Words that a part has on average; words of a slice, and queries that are run at a time.
PART, SLICE, QUERIES = 1024, 4096, 1024
#: Length classes with a number of parts of their own.
LONG = 256


def edited(doc_id: Column, word: Column) -> Column:
    """The contract's edit: one word in 97 loses a letter, by its document."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(97)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, edit: bool = False, size: int = PIECE) -> DataFrame:
    """(word, n): words of LETTERS letters or more with at least OFTEN occurrences."""
    p = F.col("p.piece")
    rows = docs.select("doc_id", F.explode(pieces(F.col("text"), LETTER, size=size)).alias("p"))
    # lower() is many times faster than translate(), and the same where no capital outside ASCII is
    rows = rows.select("doc_id", F.when(p.rlike(CAPITALS), F.translate(p, UPPER, LOWER)).otherwise(F.lower(p)).alias("t"))
    words = rows.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(f"{LETTER}{{{LETTERS},}}"), F.lit(0))).alias("w"))
    word = F.coalesce(edited(F.col("doc_id"), F.col("w")), F.col("w")) if edit else F.col("w")
    return words.select(word.alias("word")).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _members(words: DataFrame, part: int, slice_: int) -> DataFrame:
    """(a, side, part, slice, query, word, n): each word in the parts of its halves, as a member of the index in one
    slice and as a query in all."""
    m = F.length("word")
    classes = F.filter(F.array(m - 1, m), lambda a: a >= LETTERS)
    rows = words.select("word", "n", F.explode(classes).alias("a")).select("word", "n", "a", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.floor(F.col("a") / 2).cast("int")
    key = F.when(F.col("side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", m - half + 1, half))
    rows = rows.withColumn("h", F.xxhash64(key))
    # classes from LONG on share their number of parts, so no more than LONG numbers reach the driver
    short = F.least("a", F.lit(LONG))
    held = {r.a: r["count"] for r in rows.groupBy(short.alias("a")).count().collect()}
    parts = F.array(*[F.lit(-(-held.get(a, 1) // (2 * part))) for a in range(LONG + 1)])
    rows = rows.withColumn("part", F.pmod("h", F.get(parts, short).cast("long"))).drop("h")
    sizes = rows.groupBy("a", "side", "part").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
    rows = rows.join(sizes, ["a", "side", "part"])
    index = rows.select("a", "side", "part", F.pmod(F.xxhash64("word", F.lit(1)), "slices").cast("int").alias("slice"), F.lit(False).alias("query"), "word", "n")
    return index.unionByName(rows.select("a", "side", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("query"), "word", "n"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words as numbers, and each word's first."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(letters < 0xC0, letters - 97, letters - 0xC0 + 26), np.concatenate(([0], np.cumsum([len(w) for w in words])))


class PositionIndex:
    """Bit sets of words of length a and a + 1 by position and letter."""

    def __init__(self, words: list[str], counts: list[int], a: int) -> None:
        self.a, self.words, self.n = a, words, np.array(counts, np.int64)
        size = len(words)
        letters, first = _codes(words)
        length = np.diff(first)
        owner = np.repeat(np.arange(size), length)
        key = (np.arange(len(letters)) - first[owner]) * 90 + letters
        self.keys, row = np.unique(key, return_inverse=True)
        wide = -(-size // 64) * 64
        flags = np.zeros((len(self.keys) + 1, wide), bool)  # the last row is the empty set
        flags[row, owner] = True
        self.bits = self._pack(flags)
        lengths = np.zeros((3, wide), bool)
        lengths[0, :size], lengths[1, :size], lengths[2, :size] = True, length == a, length == a + 1
        self.all, self.short, self.long = self._pack(lengths)
        order = sorted(range(size), key=words.__getitem__)
        self.rank = np.empty(size, np.int64)
        self.rank[order] = np.arange(size)

    @staticmethod
    def _pack(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)

    def _sets(self, position: int, letters: np.ndarray) -> np.ndarray:
        key = position * 90 + letters
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.bits[np.where(self.keys[at] == key, at, len(self.keys))]

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all pairs at exactly one error; the queries have one length, a or a + 1."""
        m, letters = len(queries[0]), _codes(queries)[0].reshape(len(queries), -1)
        exact = np.broadcast_to(self.all, (len(queries), len(self.all)))
        if m == self.a:
            replaced, inserted = np.zeros_like(exact), exact
            for j in range(m):
                here = self._sets(j, letters[:, j])
                replaced = (replaced & here) | (exact & ~here)
                exact = exact & here
                # one letter of the word is passed over, so it stands one place further on
                inserted = (inserted & self._sets(j + 1, letters[:, j])) | exact
            found = (replaced & self.short) | (inserted & self.long)
        else:
            deleted = np.zeros_like(exact)
            for j in range(m):
                deleted = (deleted & self._sets(j - 1, letters[:, j])) | exact if j else exact
                exact = exact & self._sets(j, letters[:, j])
            found = deleted & self.short
        q, w = np.nonzero(found)
        bit = np.unpackbits(found[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, b = np.nonzero(bit)
        return q[hit], w[hit] * 64 + b


def _search(index: PositionIndex, side: int, queries: list[str]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) of queries with near words that are counted in this part: those with equal first
    halves among the parts of these, else with equal last halves among the others."""
    a, half = index.a, index.a // 2
    names: dict[str, int] = {}
    heads = lambda words: np.array([names.setdefault(w[:half], len(names)) for w in words])
    tails = lambda words: np.array([names.setdefault(w[len(w) - half :], len(names)) for w in words])
    own_head, own_tail = heads(index.words), tails(index.words) if side else None
    for length in (a, a + 1):
        some = [w for w in queries if len(w) == length]
        for lo in range(0, len(some), QUERIES):
            asked = some[lo : lo + QUERIES]
            q, w = index.near(asked)
            same = heads(asked)[q] == own_head[w]
            if side:
                same = ~same & (tails(asked)[q] == own_tail[w])
            q, w = q[same], w[same]
            if not len(q):
                continue
            order = np.lexsort((index.rank[w], -index.n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            total = np.diff(np.concatenate((first, [len(q)])))
            yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in q[first]], pa.string()), pa.array(total), pa.array(index.n[w[first]]), pa.array([index.words[i] for i in w[first]], pa.string())], ["word", "n_near", "form_n", "form"])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their part and slice, the index first: one index is held at a time, queries pass by."""
    now, words, counts, index = None, [], [], None
    for b in batches:
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(keys[0])], strict=True):
            if lo == hi:
                continue
            key = tuple(int(k[lo]) for k in keys[:4])
            if key != now:
                now, words, counts, index = key, [], [], None
            rows = b.slice(lo, hi - lo)
            if not keys[4][lo]:
                words += rows.column(5).to_pylist()
                counts += rows.column(6).to_pylist()
            elif words:
                index = index or PositionIndex(words, counts, now[0])
                yield from _search(index, now[1], rows.column(5).to_pylist())


def variants(words: DataFrame, part: int = PART, slice_: int = SLICE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word string, n long), words being distinct, of
    LETTERS letters or more, of a-z and the letters from U+00C0 to U+00FF.

    Two words are near at exactly one inserted, deleted or replaced letter; n_near counts them. form: the near word of
    greatest n, of equal ones the first by code points, if its n is at least twice the word's, with its n in form_n.
    root: where the forms lead in the end, the word itself if it has none. An empty table gives an empty result.
    """
    rows = save(_members(words, part, slice_))
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // 200_000 + 1)
    dealt = rows.select("a", "side", "part", "slice", "query", "word", "n").repartition(tasks, "a", "side", "part", "slice").sortWithinPartitions("a", "side", "part", "slice", "query")
    found = dealt.mapInArrow(_groups, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    takes = -F.col("best.n") >= 2 * F.col("n")
    out = save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n")))
    drop(rows)
    # each step doubles the way; n doubles from form to form, so there are few
    way, made = out.where("form is not null").select("word", F.col("form").alias("to")), []
    while True:
        on = way.select(F.col("word").alias("to"), F.col("to").alias("onward"))
        step = save(way.join(on, "to", "left").select("word", F.coalesce("onward", "to").alias("to"), F.col("onward").isNotNull().alias("moved")))
        made.append(step)
        way = step.select("word", "to")
        if step.where("moved").isEmpty():
            break
    drop(*made[:-1])
    return out.join(way, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, edit: bool = False) -> DataFrame:
    """variants() of the words of docs, of which doc_id and text alone are read: maximal runs of letters, A-Z lower-cased.

    A null or empty text has no words. Repeated rows and doc_ids count each for itself. With `edit`, one word in 97 of
    a document loses a letter first; where doc_id is null, none does."""
    return variants(save(vocabulary(docs, edit)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all documents."""
    return group(load(spark, sf_dir, "documents"), edit=True)
