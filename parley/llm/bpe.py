"""Operator 6: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of an Arrow batch that the task has not met yet are laid out in one
symbol array. An index maps each pair to all its positions; active ranks are applied in
ascending order from a heap, and each merge updates only the lists of the pairs it makes.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: Symbols merged together at most, and pre-tokens a task remembers before it starts anew.
SYMBOLS, REMEMBERED = 1 << 20, 400_000
#: How the vocabulary's pre-tokenizer splits (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """The vocabulary's printable letter for each byte: its own where it is printable, else the
    next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], _letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 20 | b: r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.split = regex.compile(PATTERN)
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        ends = np.cumsum([len(w) for w in words])
        symbol = array("i", self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32).tobytes())
        n = len(symbol)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        rank, merges, index = self.rank, self.merges, defaultdict(list)
        for p in range(n):
            if (q := after[p]) >= 0 and (r := rank.get(symbol[p] << 20 | symbol[q])) is not None:
                index[r].append(p)
        active = sorted(index)
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            for p in sorted(index.pop(r)):
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    if (s := rank.get(new << 20 | symbol[nxt])) is not None:
                        if s not in index:
                            heapq.heappush(active, s)
                        index[s].append(p)
                if (prv := before[p]) >= 0 and (s := rank.get(symbol[prv] << 20 | new)) is not None:
                    if s not in index:
                        heapq.heappush(active, s)
                    index[s].append(prv)
        ids = np.frombuffer(symbol, np.int32)
        live = np.concatenate(([0], np.cumsum(ids >= 0)))[np.concatenate(([0], ends))] * 4
        out = ids[ids >= 0].astype("<u4").tobytes()
        return [out[i:j] for i, j in zip(live[:-1].tolist(), live[1:].tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        some, size = [], 0
        for k, w in enumerate(words):
            some.append(w)
            size += len(w)
            if size >= SYMBOLS or k == len(words) - 1:
                self.known.update(zip(some, self.merge([x.encode() for x in some]), strict=True))
                some, size = [], 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; special tokens in a text are told apart, as the library does."""
        pieces = []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut and any(t in (text or "") for t in self.special) else [text or ""]
            pieces.append([p if p in self.special else self.split.findall(p) for p in parts])
        known = self.known
        new = {w for text in pieces for p in text if not isinstance(p, str) for w in p if w not in known}
        if new:
            if len(known) > REMEMBERED:
                new = {w for text in pieces for p in text if not isinstance(p, str) for w in p}
            self.learn(list(new))
        return [b"".join([self.special[p] if isinstance(p, str) else b"".join([known[w] for w in p]) for p in text]) for text in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def _model(path: str) -> Bpe:
    """One vocabulary for all tasks of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of token ids, little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Other columns stay as they are; a column already named
    `ids` is replaced. Row-local: no shuffle, and repeated rows are encoded alike.
    path: a tokenizers file of a byte-level BPE that every executor can open.
    """
    return _mapped(docs, text, ids, "binary", path, lambda bpe, column: bpe.encode(column))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a binary column of token ids; null ids give an empty text."""
    return _mapped(docs, ids, text, "string", path, lambda bpe, column: [bpe.decode(x or b"") for x in column])


def _mapped(docs: DataFrame, source: str, target: str, kind: str, path: str | None, f) -> DataFrame:
    path = path or vocabulary()
    kept = [c for c in docs.columns if c != target]
    schema = docs.select(*kept).withColumn(target, F.lit(None).cast(kind)).schema

    def run(batches):
        bpe = _model(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):  # so that a batch's pieces stay small
                part = b.slice(at, 512)
                made = f(bpe, part.column(source).to_pylist())
                columns = [part.column(c) for c in kept] + [pa.array(made, pa.binary() if kind == "binary" else pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, target])

    return docs.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
