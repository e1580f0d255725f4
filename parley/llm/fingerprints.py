"""Operator 4: document fingerprints by consistent weighted sampling.

A term is a pair of neighbouring words, hashed to one of TERMS numbers and weighted by its
count. For each sample and term, r and c are Gamma(2, 1) and beta is uniform, all from a hash of
both; with t = floor(ln w / r + beta) and y = exp(r (t - beta)) the sample is the
(term, t) of least c / (y e^r). Two texts have the same sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, chunks, load, mix, utf8, words

#: Samples of a fingerprint, and numbers of terms: so many that different terms of even the longest
#: texts do not meet.
SAMPLES, TERMS = 64, 1 << 62
#: Terms whose draws are made at a time; bytes of text whose terms share a table of draws, and the
#: most terms of such a table (1 KB each).
STEP, SHARE, TABLE = 512, 1 << 18, 1 << 16
#: Bytes of text of a task that compares neighbours, ranges of ids in it, and ranges at most.
TASK, RANGES, MOST = 16 << 20, 4, 65_536
#: For each of four draws and each sample, the factors of a term's halves and an addend.
_LOW, _HIGH, _PLUS = mix(np.arange(1, 12 * SAMPLES + 1, dtype=np.uint64)).astype(np.uint32).reshape(3, 4, 1, SAMPLES) | np.uint32(1)


def draws(terms: np.ndarray):
    """r, ln c and beta (float32) of each term and sample. Uniform numbers are the upper 24 bits
    of hashes of 32; beta has the lower bytes of two."""
    low, high = terms.astype(np.uint32)[:, None], (terms >> 32).astype(np.uint32)[:, None]
    uniform, bits = [], []
    for j in range(4):
        x = low * _LOW[j]
        x += high * _HIGH[j]
        x += _PLUS[j]
        for factor, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):  # the finaliser of MurmurHash3
            x ^= x >> np.uint32(shift)
            x *= np.uint32(factor)
        x ^= x >> np.uint32(16)
        bits.append(x)
        u = (x >> np.uint32(8)).astype(np.float32)
        u += np.float32(1)
        u *= np.float32(2**-24)
        uniform.append(u)
    r, c = (-np.log(uniform[j] * uniform[j + 1]) for j in (0, 2))
    beta = ((bits[0] & np.uint32(255)) << np.uint32(8) | bits[1] & np.uint32(255)).astype(np.float32) * np.float32(2**-16)
    r, c = np.maximum(r, np.float32(1e-30)), np.log(np.maximum(c, np.float32(1e-30)))
    return r, c, beta


def scores(terms: np.ndarray):
    """r, ln c, beta and the score of weight 1 of each term and sample."""
    out = [np.empty((len(terms), SAMPLES), np.float32) for _ in range(4)]
    for at in range(0, len(terms), STEP):
        r, c, beta = draws(terms[at : at + STEP])
        for whole, part in zip(out, (r, c, beta, c - r * (1 - beta)), strict=True):
            whole[at : at + STEP] = part
    return out


def signature(terms: np.ndarray, counts: np.ndarray, table=None, rows: np.ndarray | None = None) -> np.ndarray:
    """16 bits of each sample of one text; zeros for a text without terms. The terms' scores are
    those rows of the table, or are made here piece by piece."""
    if not len(terms):
        return np.zeros(SAMPLES, "<u2")
    best, level = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64)
    term = np.zeros(SAMPLES, np.int64)
    every = np.arange(SAMPLES)
    often = counts > 1
    ln = np.log(counts[often]).astype(np.float32)[:, None]
    step = STEP if table is None else 4 * STEP
    for mine, weighted in ((np.flatnonzero(~often), False), (np.flatnonzero(often), True)):
        for at in range(0, len(mine), step):
            own = mine[at : at + step]
            if table is None:
                r, c, beta, score = scores(terms[own])
            elif weighted:
                r, c, beta = (x[rows[own]] for x in table[:3])
            else:
                score = table[3][rows[own]]
            if weighted:
                k = np.floor(ln[at : at + step] / r + beta)
                score = c - r * (k - beta + 1)
            i = score.argmin(axis=0)
            least = score[i, every]
            new = least < best
            best, term = np.where(new, least, best), np.where(new, terms[own][i], term)
            level = np.where(new, k[i, every].astype(np.int64) if weighted else 0, level)
    return (mix(mix(term.astype(np.uint64)) + level.astype(np.uint64)) >> np.uint64(48)).astype("<u2")


def signatures(texts: list[str]) -> list[np.ndarray]:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in chunks(offsets, SHARE):
        off = offsets[lo : hi + 1] - offsets[lo]
        _, _, rows, hashes = words(data[offsets[lo] : offsets[hi]], off)
        cut = np.searchsorted(rows, np.arange(hi - lo + 1)).tolist()
        pair = (mix(hashes[:-1] * _ODD[0] + hashes[1:] * _ODD[1]) >> np.uint64(64 - 62)).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
        alone = (mix(hashes) >> np.uint64(64 - 62)).astype(np.int64)
        own = [np.unique(pair[a : b - 1] if b - a > 1 else alone[a:b], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        known = np.unique(np.concatenate([t for t, _ in own])) if hi - lo > 1 else ()
        if hi - lo > 1 and len(known) <= TABLE:
            table = scores(known)
            out += [signature(t, n, table, np.searchsorted(known, t)) for t, n in own]
        else:
            out += [signature(t, n) for t, n in own]
    return out


def alike(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint: 64 samples of 16 bits as hex. A null or blank text has
    zeros only; a text of one word has that word as its term. Row-local; equal texts have equal
    fingerprints; a column of that name that docs already has is replaced."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    schema = docs.select(*kept).withColumn("fingerprint", F.lit(None).cast("string")).schema

    def run(batches):
        for b in batches:
            made = [s.tobytes().hex() for s in signatures([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(made, pa.string())], [*kept, "fingerprint"])

    return docs.mapInArrow(run, schema)


def with_next(docs: DataFrame):
    """docs in ranges of doc_id, sorted, each range with a copy of the next range's first rows.

    Rows are (bucket, copied, doc_id, text). Ranges are cut at quantiles of doc_id, RANGES to a task of
    about TASK bytes of text; only those bounds and each range's least id reach the driver, and there are
    at most MOST of them. Beyond, ranges grow, which costs sorting but no memory, as rows are streamed.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MOST // RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK + 1))
    n = RANGES * tasks
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    ids = docs.select("doc_id", "text")
    if bounds:
        table = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

        def number(batches):
            for b in batches:
                x = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(table.value, x, "right").astype(np.int32)), b.column(0), b.column(1)], ["bucket", "doc_id", "text"])

        ids = ids.mapInArrow(number, "bucket int, doc_id long, text string")
        seen = docs.select("doc_id", F.lit("").alias("text")).mapInArrow(number, "bucket int, doc_id long, text string")
    else:
        ids = ids.withColumn("bucket", F.lit(0))
        seen = ids
    firsts = {r.bucket: r.low for r in seen.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).select("bucket", F.col("m.doc_id").alias("low")).collect()}
    order = sorted(firsts)
    copies = [(order[i - 1], b, firsts[b]) for i, b in enumerate(order)]  # the first range's go to the last
    own = docs.sparkSession.createDataFrame(copies or [(0, -1, None)], "to int, _b int, low long")
    copied = ids.join(F.broadcast(own), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("low"))).select(F.col("to").alias("bucket"), F.lit(True).alias("copied"), "doc_id", "text")
    rows = ids.select("bucket", F.lit(False).alias("copied"), "doc_id", "text").unionByName(copied)
    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "copied", "doc_id", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): n_chars, edited (text), fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is that of the next larger
    doc_id, of the first after the last; rows of one doc_id are ordered by text, null ids and
    null (empty) texts first. A lone document is its own next. Two texts without words are alike.
    """

    def run(batches):
        # the row before is done when its next is known; a range ends with its copied rows
        held, bucket = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), [t or "" for t in b.column(3).to_pylist()], strict=True))
                # each text is followed by the edited one, whose terms it shares
                texts, before = [], held and (bucket, held[1])
                for r in rows:
                    if before is not None and r[0] == before[0]:
                        half = len(before[1]) // 2
                        texts.append(before[1][: len(before[1]) - half] + r[3][:half])
                    texts.append(r[3])
                    before = None if r[1] else (r[0], r[3])
                each = iter(zip(texts, signatures(texts), strict=True))
                pairs, edited, made = [], [], []
                for r in rows:
                    if held is not None and r[0] == bucket:
                        text, s = next(each)
                        edited.append(text)
                        made.append(s)
                    _, s = next(each)
                    if held is not None and r[0] == bucket:
                        pairs.append((held, (r[2], r[3], s)))
                    bucket, held = r[0], None if r[1] else (r[2], r[3], s)
                if not pairs:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                        pa.array(edited, pa.string()),
                        pa.array([x[2].tobytes().hex() for x, _ in pairs], pa.string()),
                        pa.array([m.tobytes().hex() for m in made], pa.string()),
                        pa.array([alike(x[2], m) for (x, _), m in zip(pairs, made, strict=True)], pa.float64()),
                        pa.array([alike(x[2], y[2]) for x, y in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare_edited(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
