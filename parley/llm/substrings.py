"""Operator 7: exact removal of repeated 100-byte strings, blockwise over suffix buckets.

A cover sample stands in for comparing suffixes at full length. Its positions are chosen by
content: the least hash among the SPAN = 100 - WIDE + 1 strings of WIDE bytes in a 100-byte
window. So equal windows have their cover position at the same offset, and each window belongs
to one. All windows of one cover position make its context; a suffix bucket holds the contexts
whose cover strings are equal.

1. Contexts are ranked by hash within their bucket. Equal contexts are the long ties: all but
   the first go at once, whatever their length or number.
2. Only buckets with different contexts are sorted window by window, one bucket at a time.
   Buckets with many contexts are dealt by window instead, so that no task holds one whole.
3. Marked bytes are cut out, document by document.

A position's place in the order is (doc_id, start). Equality of windows is that of two 64-bit hashes,
of the window and of its cover string.

Buckets are dealt to parts whose number follows the bytes of the input. Spark sorts each task's rows by
part, and a task works on one part at a time, so that its memory depends on the size of a part and not on the input.
Texts are read in pieces that overlap by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, _PLAIN, by_part, chunks, deal, load, mix, powers, save, utf8

LENGTH, WIDE = 100, 32
SPAN = LENGTH - WIDE + 1
#: Different contexts of one bucket in a task from which on it is dealt by window.
LARGE = 64
#: Entries that a task deals out, windows that it sorts, and bytes of text that it reads at a time.
FLUSH, PIECE = 1 << 18, 1 << 18

#: What an entry says: it is marked; its windows are to be sorted in their bucket, or by themselves.
MARK, SORT, SPREAD = 0, 1, 2
ENTRY = np.dtype([("bucket", "u8"), ("rank", "u8"), ("doc", "i8"), ("th", "i8"), ("p", "u4"), ("n", "u4")])
PLACE = np.dtype([("doc", "i8"), ("th", "i8"), ("p", "u4"), ("n", "u4"), ("kind", "u1")])
WINDOW = np.dtype([("bucket", "u8"), ("rank", "u8"), ("doc", "i8"), ("th", "i8"), ("p", "u4")])
NULL_ID = np.iinfo(np.int64).min


class Hashes:
    """Hashes of any range of a chunk of bytes in constant time."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_PLAIN[data] * self.up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def contexts(data: np.ndarray, offsets: np.ndarray):
    """Row, cover position, first window and number of windows of each context of a chunk."""
    hashes, n = Hashes(data), len(data)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes >= LENGTH)
    if not len(rows):
        return None
    k = n - WIDE + 1
    at = np.arange(k)
    value = (hashes.of(at, at + WIDE) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = np.full(-(-k // SPAN) * SPAN + SPAN, np.iinfo(np.uint64).max, np.uint64)
    pad[:k] = value
    block = pad.reshape(-1, SPAN)
    up = np.minimum.accumulate(block, axis=1).ravel()
    down = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - LENGTH + 1
    least = np.minimum(down[:m], up[SPAN - 1 : SPAN - 1 + m])
    cover = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(m), "right") - 1
    inside = np.arange(m) + LENGTH <= offsets[row + 1]
    new = np.ones(m, bool)
    new[1:] = (cover[1:] != cover[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
    return hashes, row[first], cover[first], first, stop - first + 1


def _later(rows: np.ndarray, *names: str):
    """Sorts by the names and place; (rows, mask of those with an earlier equal)."""
    rows = rows[np.lexsort((rows["p"], rows["doc"], *[rows[x] for x in reversed(names)]))]
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.any([rows[x][1:] != rows[x][:-1] for x in names], axis=0)
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = (rows["doc"] != rows["doc"][start][group]) | (rows["p"] != rows["p"][start][group]) if len(rows) else new
    return rows, later


def _places(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(rows), PLACE)
    for c in ("doc", "th", "p"):
        out[c] = rows[c]
    out["n"] = rows["n"] if "n" in rows.dtype.names else 1
    out["kind"] = kind
    return out


def _joined(rows: np.ndarray) -> np.ndarray:
    """Places of marks with those that follow one another made one."""
    rows = rows[np.lexsort((rows["p"], rows["th"], rows["doc"]))]
    if not len(rows):
        return rows
    end = rows["p"].astype(np.int64) + rows["n"]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["th"][1:] != rows["th"][:-1]) | (rows["p"][1:] > end[:-1])
    start = np.flatnonzero(new)
    out = rows[start].copy()
    out["n"] = np.maximum.reduceat(end, start) - out["p"]
    return out


def _dealt(part: np.ndarray, kind: str, rows: np.ndarray):
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cut):
        if len(own):
            yield int(part[own[0]]), kind, b"".join(rows[c][own].tobytes() for c in rows.dtype.names)


def _read(payload: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(payload) // kind.itemsize, 0
    out = np.empty(n, kind)
    for c in kind.names:
        out[c] = np.frombuffer(payload, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _rows(places: np.ndarray) -> pa.RecordBatch | None:
    """Places packed by document."""
    if not len(places):
        return None
    places = places[np.lexsort((places["p"], places["th"], places["doc"]))]
    new = np.ones(len(places), bool)
    new[1:] = (places["doc"][1:] != places["doc"][:-1]) | (places["th"][1:] != places["th"][:-1])
    start = np.flatnonzero(new)
    cut = [*start.tolist(), len(places)]
    packed = [places[["p", "n", "kind"]][a:b].astype([("p", "u4"), ("n", "u4"), ("kind", "u1")]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(places["doc"][start].copy()), pa.array(places["th"][start].copy()), pa.array(packed, pa.binary())], ["doc", "th", "places"])


_PLACES = "doc long, th long, places binary"
_PACKED = np.dtype([("p", "u4"), ("n", "u4"), ("kind", "u1")])
_DEALT = "part int, kind string, payload binary"


def _dealt_batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "payload"])


def _part(x: np.ndarray, n_parts: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)


def pieces(offsets: np.ndarray):
    """Ranges of rows with about PIECE bytes, and for a longer text its pieces: (first row, end, byte
    where the piece starts, byte where it ends). A piece ends with the last window that starts in its
    PIECE bytes."""
    for lo, hi in chunks(offsets, PIECE):
        n = int(offsets[hi] - offsets[lo])
        if hi - lo > 1 or n <= PIECE:
            yield lo, hi, 0, n
        else:
            for start in range(0, n - LENGTH + 1, PIECE):
                yield lo, hi, start, min(n, start + PIECE + LENGTH - 1)


def _gathered(df: DataFrame, tasks: int, work) -> DataFrame:
    def run(batches):
        for rows in by_part(batches):
            out = work(rows)
            if out and (batch := _rows(np.concatenate(out))) is not None:
                yield batch

    return df.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, _PLACES)


def rank_contexts(docs: DataFrame, tasks: int, n_parts: int) -> DataFrame:
    """Step 1: places (doc, th, packed) that are marked, or whose windows are to be sorted."""

    def flush(held):
        rows, later = _later(np.concatenate(held), "bucket", "rank")
        yield from _dealt(_part(mix(rows["doc"][later].view(np.uint64)), n_parts), "place", _places(rows[later], MARK))
        rows = rows[~later]
        start = np.flatnonzero(np.concatenate(([True], rows["bucket"][1:] != rows["bucket"][:-1])))
        n = np.diff(np.concatenate((start, [len(rows)])))
        large = np.repeat(n > LARGE, n)
        # a large bucket is dealt by context; in its own part one entry tells of it
        yield from _dealt(_part(rows["rank"][large], n_parts), "spread", rows[large])
        sign = rows[start[n > LARGE]].copy()
        sign["n"] = 0
        rows = np.concatenate((rows[~large], sign))
        yield from _dealt(_part(rows["bucket"], n_parts), "rank", rows)

    def emit(batches):
        held, size = [], 0
        for b in batches:
            data, offsets = utf8(b.column(2))
            doc = b.column(0).fill_null(NULL_ID).to_numpy()
            th = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, start, end in pieces(offsets):
                off = np.clip(offsets[lo : hi + 1] - offsets[lo] - start, 0, end - start)
                if (found := contexts(data[offsets[lo] + start : offsets[lo] + end], off)) is None:
                    continue
                hashes, row, cover, first, n = found
                rows = np.empty(len(row), ENTRY)
                rows["bucket"] = hashes.of(cover, cover + WIDE)
                rows["rank"] = mix(hashes.of(first, first + n - 1 + LENGTH) + (cover - first).astype(np.uint64))
                rows["doc"], rows["th"], rows["p"], rows["n"] = doc[lo:hi][row], th[lo:hi][row], first - off[row] + start, n
                held.append(rows)
                size += len(rows)
                if size >= FLUSH:
                    yield _dealt_batch(flush(held))
                    held, size = [], 0
        if held:
            yield _dealt_batch(flush(held))

    def gather(held):
        ranked, spread, out = [], [], []
        for kind, payload in held:
            if kind == "place":
                out.append(_read(payload, PLACE))
            else:
                (ranked if kind == "rank" else spread).append(_read(payload, ENTRY))
        if ranked:
            rows = np.concatenate(ranked)
            sign, rows = np.unique(rows["bucket"][rows["n"] == 0]), rows[rows["n"] > 0]
            rows, later = _later(rows, "bucket", "rank")
            out.append(_places(rows[later], MARK))
            rows = rows[~later]
            if len(rows):
                # equal places (a row that is repeated) count as one context
                start = np.flatnonzero(np.concatenate(([True], rows["bucket"][1:] != rows["bucket"][:-1])))
                n = np.diff(np.concatenate((start, [len(rows)])))
                told = np.repeat(np.isin(rows["bucket"][start], sign), n)
                many = np.repeat(n > 1, n)
                out += [_places(rows[many & ~told], SORT), _places(rows[told], SPREAD)]
        if spread:
            rows, later = _later(np.concatenate(spread), "bucket", "rank")
            out += [_places(rows[later], MARK), _places(rows[~later], SPREAD)]
        return out

    return _gathered(docs.mapInArrow(emit, _DEALT), tasks, gather)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] of them, one after the other."""
    at = np.arange(int(n.sum()))
    before = np.concatenate(([0], np.cumsum(n)[:-1]))
    return at + np.repeat(start - before, n)


def sort_buckets(docs: DataFrame, tasks: int, n_parts: int) -> DataFrame:
    """Step 2: places of windows with an earlier equal. docs: doc_id, th, text, all_places."""
    head = np.dtype([("bucket", "u8"), ("doc", "i8"), ("th", "i8"), ("p", "u4"), ("n", "u4")])

    def emit(batches):
        windows, size = [], 0
        for b in batches:
            data, offsets = utf8(b.column(2))
            doc = b.column(0).fill_null(NULL_ID).to_numpy()
            th = b.column(1).to_numpy(zero_copy_only=False)
            packed, made = b.column(3), []
            for lo, hi, start, end in pieces(offsets):
                text = data[offsets[lo] + start : offsets[lo] + end]
                if len(text) < LENGTH:
                    continue
                own = [np.frombuffer(b"".join(x), _PACKED) for x in packed.slice(lo, hi - lo).to_pylist()]
                row = np.repeat(np.arange(hi - lo), [len(x) for x in own])
                places = np.concatenate(own)
                keep = places["kind"] != MARK
                if len(own) == 1:
                    keep &= (places["p"] >= start) & (places["p"] <= end - LENGTH)
                places, row = places[keep], row[keep]
                if not len(places):
                    continue
                hashes, raw = Hashes(text), text.tobytes()
                first = offsets[lo + row] - offsets[lo] + places["p"] - start
                n = places["n"].astype(np.int64)
                # the cover position again: the least hash of the first window
                value = np.array([_cover(hashes, a) for a in first.tolist()])
                bucket = hashes.of(value, value + WIDE)
                sort = places["kind"] == SORT
                heads = np.empty(int(sort.sum()), head)
                heads["bucket"], heads["doc"], heads["th"] = bucket[sort], doc[lo + row[sort]], th[lo + row[sort]]
                heads["p"], heads["n"] = places["p"][sort], n[sort]
                texts = [raw[a : a + m - 1 + LENGTH] for a, m in zip(first[sort].tolist(), n[sort].tolist(), strict=True)]
                part = _part(heads["bucket"], n_parts)
                order = np.argsort(part, kind="stable")
                for own_rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(own_rows):
                        made.append((int(part[own_rows[0]]), "context", heads[own_rows].tobytes() + b"".join(texts[i] for i in own_rows.tolist()) + len(own_rows).to_bytes(8, "little")))
                spread = ~sort
                if spread.any():
                    at = _ranges(first[spread], n[spread])
                    rows = np.empty(len(at), WINDOW)
                    rows["bucket"], rows["rank"] = np.repeat(bucket[spread], n[spread]), hashes.of(at, at + LENGTH)
                    rows["doc"], rows["th"] = np.repeat(doc[lo + row[spread]], n[spread]), np.repeat(th[lo + row[spread]], n[spread])
                    rows["p"] = _ranges(places["p"][spread].astype(np.int64), n[spread])
                    windows.append(rows)
                    size += len(rows)
                if size >= FLUSH:
                    made += _spread(windows, n_parts)
                    windows, size = [], 0
                if made:
                    yield _dealt_batch(made)
                    made = []
        if windows:
            yield _dealt_batch(_spread(windows, n_parts))

    def gather(held):
        windows, contexts_, out = [], [], []
        for kind, payload in held:
            if kind == "place":
                out.append(_read(payload, PLACE))
            elif kind == "window":
                windows.append(_read(payload, WINDOW))
            else:
                n = int.from_bytes(payload[-8:], "little")
                contexts_.append((np.frombuffer(payload, head, n), payload[n * head.itemsize : -8]))
        if contexts_:
            heads, data = np.concatenate([h for h, _ in contexts_]), np.frombuffer(b"".join(t for _, t in contexts_), np.uint8)
            n = heads["n"].astype(np.int64)
            first = np.concatenate(([0], np.cumsum(n - 1 + LENGTH)))[:-1]
            order, at = np.argsort(heads["bucket"], kind="stable"), 0
            sizes = np.cumsum(n[order])
            while at < len(order):  # whole buckets, about a million windows at a time
                end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + FLUSH, "right"))
                end = max(end, at + 1)
                while end < len(order) and heads["bucket"][order[end]] == heads["bucket"][order[end - 1]]:
                    end += 1
                own = order[at:end]
                rows = np.empty(int(n[own].sum()), WINDOW)
                starts = _ranges(first[own], n[own])
                rows["rank"] = _window_hashes(data, starts)
                for c in ("bucket", "doc", "th"):
                    rows[c] = np.repeat(heads[c][own], n[own])
                rows["p"] = _ranges(heads["p"][own].astype(np.int64), n[own])
                rows, later = _later(rows, "bucket", "rank")
                out.append(_joined(_places(rows[later], MARK)))
                at = end
        if windows:
            rows, later = _later(np.concatenate(windows), "bucket", "rank")
            out.append(_joined(_places(rows[later], MARK)))
        return out

    return _gathered(docs.mapInArrow(emit, _DEALT), tasks, gather)


def _cover(hashes: Hashes, start: int) -> int:
    at = np.arange(start, start + SPAN)
    return start + int(np.argmin((hashes.of(at, at + WIDE) & np.uint64(0xFFFFFFFF00000000)) | np.arange(SPAN, dtype=np.uint64)))


def _window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # starts of one bucket block may lie far apart in data
        end = min(at + CHUNK // 4, len(starts))
        lo, hi = int(starts[at:end].min()), int(starts[at:end].max()) + LENGTH
        if hi - lo <= 8 * CHUNK:
            out[at:end] = Hashes(data[lo:hi]).of(starts[at:end] - lo, starts[at:end] - lo + LENGTH)
        else:
            up, _ = powers(LENGTH)
            for i in range(at, end, 4096):
                s = starts[i : min(i + 4096, end)]
                value = (_PLAIN[data[s[:, None] + np.arange(LENGTH)]] * up[:LENGTH]).sum(axis=1, dtype=np.uint64)
                out[i : i + len(s)] = mix(value + np.uint64(LENGTH))
        at = end
    return out


def _spread(windows: list[np.ndarray], n_parts: int):
    rows, later = _later(np.concatenate(windows), "bucket", "rank")
    out = list(_dealt(_part(mix(rows["doc"][later].view(np.uint64)), n_parts), "place", _places(rows[later], MARK)))
    rows = rows[~later]
    return out + list(_dealt(_part(rows["rank"], n_parts), "window", rows))


def _once(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text) with rows that are repeated in full once: only these are shuffled with their texts."""
    named = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    twice = save(named.groupBy("doc", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc", "th"))
    if twice.isEmpty():
        return docs
    again = named.join(twice, ["doc", "th"], "left_semi").groupBy("doc", "th").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    return named.join(twice, ["doc", "th"], "left_anti").select("doc_id", "th", "text").unionByName(again.select("doc_id", "th", "text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, kept binary, spans array<struct<start,end>>) for each row of docs.

    A byte goes when a 100-byte string of the same text covers it that also starts earlier: in a
    document of smaller doc_id, or earlier in the same one. Strings are judged on the input.
    `kept` holds the other bytes in order, `spans` the maximal removed runs of byte offsets.

    A null text counts as empty; texts under 100 bytes stay whole. A null doc_id comes before
    all others. Rows repeated in full are one place in the order and come out alike; rows that
    share only a doc_id are ordered by their starts. Other columns are not read.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    tasks, n_parts = deal(docs)
    once = _once(docs)
    first = save(rank_contexts(once, tasks, n_parts))
    todo = first.groupBy("doc", "th").agg(F.collect_list("places").alias("all_places"))
    text = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    own = once.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    second = save(sort_buckets(own.join(todo, ["doc", "th"]).select("doc_id", "th", "text", "all_places"), tasks, n_parts))
    marks = first.unionByName(second).groupBy("doc", "th").agg(F.collect_list("places").alias("all_places"))
    both = text.join(marks, ["doc", "th"], "left").select("doc_id", "text", "all_places")

    def cut(batches):
        for b in batches:
            kept, spans = [], []
            for t, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (t or "").encode()
                places = np.frombuffer(b"".join(packed or ()), _PACKED)
                places = places[places["kind"] == MARK]
                if not len(places):
                    kept.append(raw)
                    spans.append([])
                    continue
                p = places["p"].astype(np.int64)
                order = np.argsort(p, kind="stable")
                p, stop = p[order], np.maximum.accumulate((p + places["n"] - 1 + LENGTH)[order])
                new = np.concatenate(([True], p[1:] > stop[:-1]))
                gone = list(zip(p[new].tolist(), stop[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(p) - 1]))].tolist(), strict=True))
                ends = [0, *(y for _, y in gone)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(x for x, _ in gone), len(raw)], strict=True)))
                spans.append([{"start": x, "end": y} for x, y in gone])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "kept", "spans"])

    return both.mapInArrow(cut, "doc_id long, text string, kept binary, spans array<struct<start:long,end:long>>")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
