"""Operator 3: language identification with averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (runs of 1 to 4 bytes, hashed), followed
by a linear softmax; both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents. Prediction is linear, so a task needs one weight for each bucket
and language and never builds the bag of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, load, utf8

BUCKETS, DIMENSIONS, RUNS = 1 << 15, 16, (1, 2, 3, 4)
#: Bytes of text read at a time.
PIECE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each run length: bucket of each position, and whether the run is inside its text."""
    x = _FOLD[data] + np.uint32(1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    h = np.zeros(len(data), np.uint32)
    for n in RUNS:
        m = len(data) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(0x01000193) + x[n - 1 : n - 1 + m]
        yield (h * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)).astype(np.int64), left[:m] >= n


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for lo, hi in chunks(offsets, PIECE):
            off = offsets[lo : hi + 1] - offsets[lo]
            total, number = np.zeros((hi - lo, len(self.languages))), np.zeros(hi - lo)
            # a longer text is read in pieces, each with the start of the next one
            for start in range(0, max(1, int(off[-1])), PIECE):
                more = np.clip(off - start, 0, PIECE + RUNS[-1] - 1)
                for bucket, inside in subwords(data[offsets[lo] + start : offsets[lo] + start + int(more[-1])], more):
                    bucket = np.where(inside, bucket, BUCKETS)[:PIECE]
                    cut = np.minimum(more, len(bucket))
                    number += np.diff(np.concatenate(([0], np.cumsum(inside[:PIECE])))[cut])
                    for c in range(len(self.languages)):
                        run = np.concatenate(([0.0], np.cumsum(self.weights[:, c][bucket], dtype=np.float64)))
                        total[:, c] += np.diff(run[cut])
            out[lo:hi] = total / np.maximum(number, 1)[:, None] + self.bias
        z = out / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int, most: int) -> DataFrame:
    """(lang, text, h): at most so many labelled documents of each of the `most` commonest languages,
    those of least hash. Languages are counted first, so that only hashes under a bound, a few more than
    are taken, are ranked, however many documents there are."""
    some = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = some.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    share = F.least(F.lit(1.0), (per_language + 8 * F.sqrt(F.lit(float(per_language))) + 8) / F.col("n"))
    # `most` rows are broadcast
    low = some.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    own = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    return low.withColumn("r", F.row_number().over(own)).where(F.col("r") <= per_language).select("lang", "text", "h")


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    got = [b[i] for b, i in subwords(data, np.array([0, len(data)]))]
    ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def fit(docs: DataFrame, per_language: int = 400, languages: int = 64, epochs: int = 6, seed: int = 11, false_rejects: float = 0.002) -> Model:
    """A model from labelled documents (doc_id, text, lang): at most `per_language` of each of the
    commonest `languages` are read on the driver as bags of subwords. They bound the model that each task
    gets: 256 kB for each language.

    A fifth of the sample calibrates: the temperature that gives it the best likelihood, and the
    confidence under which at most `false_rejects` of its right predictions fall (0.5 at most).
    """

    def bags(batches):
        for b in batches:
            made = [_bag(t.encode()) for t in b.column(1).to_pylist()]
            # a short piece of each text, so that short texts are learnt as well
            made += [_bag(t.encode()[len(t) // 3 : len(t) // 3 + 60]) for t in b.column(1).to_pylist()]
            columns = [pa.array([int(x) for x in b.column(2).to_pylist()] * 2), pa.array(b.column(0).to_pylist() * 2, pa.string()), pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()), pa.array([f.tobytes() for _, f in made], pa.binary()), pa.array([True] * b.num_rows + [False] * b.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "lang", "ids", "shares", "whole"])

    chosen = sample(docs, per_language, languages)
    rows = chosen.mapInArrow(bags, "h long, lang string, ids binary, shares binary, whole boolean").collect()
    rows = sorted(((r.h, r.lang, bytes(r.ids), bytes(r.shares), r.whole) for r in rows), key=lambda r: (r[0], r[1], not r[4], r[2], r[3]))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 0.0)
    ids, shares = [np.frombuffer(r[2], "<u2").astype(np.int64) for r in rows], [np.frombuffer(r[3], np.float32) for r in rows]
    y = np.array([languages.index(r[1]) for r in rows])
    held = np.array([r[0] % 5 == 0 for r in rows])
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    learn = np.flatnonzero(~held)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            if not len(ids[i]):
                continue
            h = shares[i] @ e[ids[i]]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            e[ids[i]] -= rate * 20 * shares[i][:, None] * (w @ p)
            w -= rate * 0.1 * np.outer(h, p)
            bias -= rate * 0.02 * p
    weights = np.vstack([e @ w, np.zeros((1, len(languages)), np.float32)]).astype(np.float64)
    z = np.array([s @ weights[i] if len(i) else np.zeros(len(languages)) for i, s in zip(ids, shares, strict=True)]) + bias
    check = np.flatnonzero(held) if held.any() else learn
    def p_of(t):
        q = np.exp((z[check] - z[check].max(axis=1, keepdims=True)) / t)
        return q / q.sum(axis=1, keepdims=True)
    loss = {t: -np.log(np.maximum(p_of(t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.05, 8, 40)}
    t = min(loss, key=loss.get)
    p = p_of(t)
    right = (p.argmax(axis=1) == y[check]) & np.array([rows[i][4] for i in check])
    low = float(np.quantile(p.max(axis=1)[right], false_rejects)) if right.any() else 0.0
    return Model(languages, weights, bias.astype(np.float64), float(t), min(0.5, low))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string, score double (0 to 1) and rejected boolean, from text alone.

    A null text, or one without a letter, is `und` with score 0 and rejected; else the language
    is one of the model's, and it is rejected where the calibrated probability is under the
    model's bound. Row-local; repeated rows are predicted alike. Columns of these names that
    docs already has are replaced. With no language learnt every text is `und`.
    """
    made = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in made]
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    model = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for 8 languages

    def run(batches):
        m = model.value
        for b in batches:
            letter = np.array([t is not None and _LETTER.search(t) is not None for t in b.column("text").to_pylist()], bool)
            if m.languages and b.num_rows:
                p = m.probabilities(b.column("text"))
                best = p.argmax(axis=1)
                name, score = np.array(m.languages, object)[best], p[np.arange(len(p)), best]
            else:
                name, score, letter = np.array(["und"] * b.num_rows, object), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            name, score = np.where(letter, name, "und"), np.where(letter, score, 0.0)
            out = [b.column(c) for c in kept] + [pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(~letter | (score < m.reject_below))]
            yield pa.RecordBatch.from_arrays(out, [*kept, *made])

    for f in schema.fields:
        f.nullable = True
    return docs.select(*kept).mapInArrow(run, schema)


def learnable() -> F.Column:
    """Documents to learn from: the remainder of crc32(doc_id as text) by 5 is not 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.where(learnable()))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
