"""Operator 8: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets (exact copies share one), columns
the shingles. Columns are dealt out in blocks; a block multiplies only entries that a pair
above the threshold must share: the first n - ceil(t*n) + 1 columns of each row in one global
order (size-derived prefix), and only pairs whose overlap can still reach t/(1+t)*(n1+n2).
For the pairs that are left, the product of whole rows is accumulated over blocks of columns, and
a pair goes as soon as its count and the columns still to come cannot reach that bound.

The global order puts frequent columns last, so that common passages are seldom in a prefix.
Which columns are frequent is counted over all documents; the list of at most HOT of them is
broadcast (8 bytes each). It steers cost only: every order gives the same links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_part, deal, drop, load, save, set_hash, shingle_sets
from .components import link_buckets

#: Columns named frequent at most (2 MB of broadcast), and the least count of one.
HOT, FREQUENT = 1 << 18, 32
#: Entries packed before a task hands them on.
FLUSH = 1 << 20
#: Blocks of columns over which the overlap of a pair is accumulated, and rows multiplied with one.
BLOCKS, MANY = 8, 64


def _pack(part: np.ndarray, n_parts: int, columns: list[np.ndarray]):
    """Entries dealt to parts: (part, bytes), the columns one after the other."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n_parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, b"".join(c[cut[p] : cut[p + 1]].tobytes() for c in columns)


def _batch(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.values(), strict=True)], list(schema))


def shingle_nodes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, node): documents with equal shingle sets share a node (a 64-bit hash
    of the set); node is null where the set is empty."""

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), width))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            node = pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), node], ["doc_id", "n_shingles", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def frequent_columns(docs: DataFrame, width: int, tasks: int, n_parts: int) -> np.ndarray:
    """The upper 40 bits of the shingles in most documents, sorted."""
    out = {"part": pa.int32(), "payload": pa.binary()}

    def count(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate(held)
            part = ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
            five = h.byteswap().view(np.uint8).reshape(-1, 8)[:, :5]  # the upper 40 bits
            return _batch(out, list(_pack(part, n_parts, [five])))

        for b in batches:
            for s in shingle_sets(b.column(0), width):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def reduce(batches):
        for rows in by_part(batches):
            five = np.concatenate([np.frombuffer(p, np.uint8).reshape(-1, 5) for (p,) in rows])
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, 3:] = five
            h = np.sort(eight.view(np.uint64).ravel().byteswap())
            cut = np.flatnonzero(np.diff(h)) + 1
            start = np.concatenate(([0], cut))
            n = np.diff(np.concatenate((start, [len(h)])))
            often = n >= FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(h[start][often].view(np.int64)), pa.array(n[often])], ["h", "n"])

    dealt = docs.select("text").mapInArrow(count, "part int, payload binary").repartition(tasks, "part").sortWithinPartitions("part")
    counted = dealt.mapInArrow(reduce, "h long, n long")
    top = counted.orderBy(F.desc("n"), "h").limit(HOT).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def prefix_lists(docs: DataFrame, width: int, num: int, den: int, hot: np.ndarray, tasks: int, n_parts: int) -> DataFrame:
    """(key, node, n, pos): the entries of those prefix columns that two sets or more share."""
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    out = {"part": pa.int32(), "hot": pa.bool_(), "payload": pa.binary()}
    entry = np.dtype([("key", "u8"), ("node", "i8"), ("n", "u4"), ("pos", "u4")])

    def emit(batches):
        frequent, held, size, seen = hot.value, [], 0, set()

        def flush():
            rows = np.concatenate(held)
            at = np.searchsorted(frequent, rows["key"] >> np.uint64(24))
            is_hot = frequent[np.minimum(at, len(frequent) - 1)] == rows["key"] >> np.uint64(24) if len(frequent) else np.zeros(len(rows), bool)
            # a frequent column's entries are dealt by row, so that no task has all of them
            deal = np.where(is_hot, rows["node"].view(np.uint64), rows["key"])
            part = ((deal >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
            got = [(p, h, x) for h in (False, True) for p, x in _pack(part[is_hot == h], n_parts, [rows[is_hot == h]])]
            return _batch(out, got)

        for b in batches:
            for s in shingle_sets(b.column(0), width):
                n = len(s)
                if not n or (node := set_hash(s)) in seen:
                    continue
                seen.add(node)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s >> np.uint64(24)), len(frequent) - 1)
                    late = frequent[at] == s >> np.uint64(24)
                    s = np.concatenate((s[~late], s[late]))
                p = _prefix(n, num, den)
                rows = np.empty(p, entry)
                rows["key"], rows["node"], rows["n"], rows["pos"] = s[:p], node, n, np.arange(p)
                held.append(rows)
                size += p
                if size >= FLUSH // 2:
                    yield flush()
                    held, size, seen = [], 0, set()
        if held:
            yield flush()

    def gather(batches):
        for held in by_part(batches):
            cold = []
            for is_hot, payload in held:
                rows = np.frombuffer(payload, entry)
                if is_hot:
                    yield _entries(rows)
                else:
                    cold.append(rows)
            if cold:
                yield _entries(_shared(np.concatenate(cold), num, den))

    dealt = docs.select("text").mapInArrow(emit, "part int, hot boolean, payload binary")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(gather, "key long, node long, n int, pos int").dropDuplicates(["key", "node"])


def _entries(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64)), pa.array(rows["node"].copy()), pa.array(rows["n"].astype(np.int32)), pa.array(rows["pos"].astype(np.int32))], ["key", "node", "n", "pos"])


def _shared(rows: np.ndarray, num: int, den: int) -> np.ndarray:
    """Entries of columns with two rows or more; a column with just two must pass the bound."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[~again]
    start = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    n = np.diff(np.concatenate((start, [len(rows)])))
    two = start[n == 2]
    rest = rows["n"].astype(np.int64) - rows["pos"]
    both = rows["n"][two].astype(np.int64) + rows["n"][two + 1]
    two = two[(den + num) * np.minimum(rest[two], rest[two + 1]) >= num * both]
    keep = np.repeat(n > 2, n)
    keep[two] = keep[two + 1] = True
    return rows[keep]


def _could(num: int, den: int):
    """The overlap from the shared column on can reach the threshold."""

    def could(x: str, y: str) -> Column:
        rest = F.least(F.col(f"{x}n") - F.col(f"{x}pos"), F.col(f"{y}n") - F.col(f"{y}pos"))
        return (den + num) * rest >= num * (F.col(f"{x}n") + F.col(f"{y}n"))

    return could


def overlapping(x: np.ndarray, ys: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the rows ys (sorted columns) have den * intersection >= num * union with row x: a product
    of one row with many, accumulated block by block of the columns."""
    edges = np.arange(1, BLOCKS, dtype=np.uint64) * np.uint64(2**64 // BLOCKS)
    n, m = len(x), np.array([len(y) for y in ys], np.int64)
    need = np.maximum(1, -(-num * (n + m) // (num + den)))
    cx = [0, *np.searchsorted(x, edges).tolist(), n]
    cy = np.array([[0, *np.searchsorted(y, edges).tolist(), len(y)] for y in ys], np.int64).reshape(-1, BLOCKS + 1)
    count, alive = np.zeros(len(ys), np.int64), np.flatnonzero(np.minimum(n, m) >= need)
    for k in range(BLOCKS):
        if not len(alive):
            break
        own = x[cx[k] : cx[k + 1]]
        both = np.concatenate([ys[i][cy[i, k] : cy[i, k + 1]] for i in alive.tolist()])
        if len(own) and len(both):
            hit = own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both
            total, ends = np.concatenate(([0], np.cumsum(hit))), np.cumsum(cy[alive, k + 1] - cy[alive, k])
            count[alive] += total[ends] - total[np.concatenate(([0], ends[:-1]))]
        rest = np.minimum(n - cx[k + 1], m[alive] - cy[alive, k + 1])
        alive = alive[count[alive] + rest >= need[alive]]
    out = np.zeros(len(ys), bool)
    out[alive] = True
    return out


def verify_pairs(texts: DataFrame, width: int, num: int, den: int):
    """Pairs of nodes whose whole sets have den * intersection >= num * union."""

    def product(batches):
        for b in batches:
            a, t, u = b.column(0).to_numpy(), b.column(2), b.column(3)
            new = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.empty(0, bool)
            left, right = shingle_sets(t.filter(pa.array(new)), width), shingle_sets(u, width)
            keep, cut = np.zeros(len(a), bool), [*np.flatnonzero(new).tolist(), len(a)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                x = next(left)
                for at in range(lo, hi, MANY):
                    end = min(hi, at + MANY)
                    keep[at:end] = overlapping(x, [next(right) for _ in range(at, end)], num, den)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (b.column(0), b.column(1))], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("u")), "b")
        both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t")), "a")
        return both.select("a", "b", "t", "u").mapInArrow(product, "a long, b long")

    return verify


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id long, text string).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a document's set holds its distinct
    shingles of `width` words, all words as one if there are fewer. Documents link where
    den * intersection >= num * union; component_id is the smallest doc_id reachable.

    A null, empty or blank text has no shingles and its own doc_id; a null doc_id is ignored by
    the minimum unless all are null. Repeated rows come out as often as they came in. Columns
    besides the two are not read. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    named = save(shingle_nodes(docs, width))
    tasks, n_parts = deal(docs)
    hot = frequent_columns(docs, width, tasks, n_parts)
    lists = save(prefix_lists(docs, width, num, den, hot, tasks, n_parts))
    # one document for each set that shares a column
    nodes = named.join(lists.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id")).alias("d")).select("node", F.col("d.doc_id").alias("_id"))
    found = docs.join(nodes, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    texts = save(_of_node(found, width))
    labels = link_buckets(lists, verify_pairs(texts, width, num, den), _could(num, den), rounds=3, prefer=("pos",))
    sets = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sets = save(sets)
    lowest = sets.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = sets.join(lowest, "label").select("node", "component_id")
    out = named.join(classes, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    drop(lists, texts)
    return out


def _of_node(found: DataFrame, width: int) -> DataFrame:
    """Where a doc_id has several texts, the one whose set is the node's."""

    def same(batches):
        for b in batches:
            got = [set_hash(s) if len(s) else None for s in shingle_sets(b.column(1), width)]
            yield b.filter(pa.array(np.array(got, object) == np.array(b.column(0).to_pylist(), object)))

    return found.mapInArrow(same, "node long, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, of the smallest doc_id, null last; all columns kept.

    Where a doc_id has several rows, each row is a document of its own: of rows repeated in full
    one stays, and rows of one doc_id are told apart by their texts. A text without shingles is
    alone, so its rows all stay.
    """
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        order = docs.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
        rows = save(order.withColumn("_row", F.monotonically_increasing_id()))
        found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width, num, den)
        kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
        return rows.join(kept, "_row", "left_semi").select(*docs.columns)
    found = near_duplicates(docs, width, num, den)
    kept = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
