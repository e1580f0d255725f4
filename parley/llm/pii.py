"""Operator 2: personal data by fixed patterns and a character-level BiLSTM with a CRF.

The patterns give the base spans. The network finds what they miss: addresses with brackets or blanks
for the at-sign and dots, numbers with other separators, 00 for +. It is trained in numpy on windows of
a bounded sample of documents, into which seeded renderings of all forms are put, with their spans as
labels, beside numbers that are no personal data. It reads overlapping windows around every digit and
at-sign (none of the four kinds can do without one); each window is decoded by Viterbi, and the spans of
all windows of a text are reconciled together. The network only adds spans.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one to the next: a span of up to 48 is whole in one of them.
WINDOW, STRIDE = 96, 48
HIDDEN, EMBEDDING, TAGS = 16, 12, 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot begin within a run of digits that another begins, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run of its characters up to the sign
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def characters(text: str) -> np.ndarray:
    """ASCII as itself; other letters, digits and blanks, and the rest, as one number each."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.minimum(points, 127).astype(np.int64)
    for i in np.flatnonzero(points > 127).tolist():
        c = text[i]
        out[i] = 128 if c.isalpha() else 129 if c.isspace() else 130
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows on the stride's grid that hold a digit or at-sign."""
    starts: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(x * STRIDE for x in (k - 1, k) if x >= 0)
    return sorted(starts)


def cut(ids: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate((ids, np.full(WINDOW, 131)))
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)] if starts else np.zeros((0, WINDOW), np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, an LSTM in each direction, and a linear-chain CRF over the tags."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDING
        self.p = {"emb": rng.normal(0, 0.3, (132, e)), "out": rng.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {d + "x": rng.normal(0, 0.25, (e, 4 * h)), d + "h": rng.normal(0, 0.2, (h, 4 * h)), d + "b": np.concatenate([np.ones(h), np.zeros(3 * h)])}

    def _lstm(self, x, d, keep):
        """Hidden states (batch, time, hidden); gates in the order forget, input, output, cell."""
        n, t, h = len(x), x.shape[1], HIDDEN
        pre = x @ self.p[d + "x"] + self.p[d + "b"]
        out, hidden, cell, past = np.zeros((n, t, h)), np.zeros((n, h)), np.zeros((n, h)), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = pre[:, i] + hidden @ self.p[d + "h"]
            s, c = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            before, cell = cell, s[:, :h] * cell + s[:, h : 2 * h] * c
            tanh = np.tanh(cell)
            if keep:
                past.append((i, s, c, before, tanh, hidden))
            hidden = s[:, 2 * h :] * tanh
            out[:, i] = hidden
        return out, past

    def _back(self, x, d, past, grad, grads):
        h, dx = HIDDEN, np.zeros_like(x)
        dh, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
        for i, s, c, before, tanh, hidden in reversed(past):
            dh = dh + grad[:, i]
            f, k, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dc = dc + dh * o * (1 - tanh * tanh)
            g = np.concatenate([dc * before * f * (1 - f), dc * c * k * (1 - k), dh * tanh * o * (1 - o), dc * k * (1 - c * c)], axis=1)
            grads[d + "x"] += x[:, i].T @ g
            grads[d + "h"] += hidden.T @ g
            grads[d + "b"] += g.sum(axis=0)
            dx[:, i] = g @ self.p[d + "x"].T
            dh, dc = g @ self.p[d + "h"].T, dc * f
        return dx

    def emissions(self, ids, keep=False):
        x = self.p["emb"][ids]
        (hf, pf), (hb, pb) = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        both = np.concatenate([hf, hb], axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, both, pf, pb)

    def loss(self, ids, tags):
        """Mean negative log-likelihood of the tag sequences, and its gradients."""
        e, (x, both, pf, pb) = self.emissions(ids, True)
        n, t, k = e.shape
        trans = self.p["trans"]

        def lse(a, axis):
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = e[:, i] + lse(alpha[:, i - 1][:, :, None] + trans, 1)
        for i in range(t - 2, -1, -1):
            beta[:, i] = lse(trans + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        grad = np.exp(alpha + beta - z[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(t)
        gold = e[rows, cols, tags].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        grad[rows, cols, tags] -= 1
        grads = {name: np.zeros_like(v) for name, v in self.p.items()}
        for i in range(1, t):
            grads["trans"] += np.exp(alpha[:, i - 1][:, :, None] + trans + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(grads["trans"], (tags[:, :-1], tags[:, 1:]), -1)
        grads["out"] = both.reshape(-1, 2 * HIDDEN).T @ grad.reshape(-1, k)
        grads["bias"] = grad.sum(axis=(0, 1))
        dh = grad @ self.p["out"].T
        dx = self._back(x, "f", pf, dh[:, :, :HIDDEN], grads) + self._back(x, "b", pb, dh[:, :, HIDDEN:], grads)
        np.add.at(grads["emb"], ids, dx)
        return (z.sum() - gold) / n, {name: g / n for name, g in grads.items()}

    def train(self, ids, tags, steps: int, batch: int, seed: int):
        rng, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            at = rng.integers(0, len(ids), min(batch, len(ids)))
            _, grads = self.loss(ids[at], tags[at])
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                self.p[name] -= 0.02 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)

    def decode(self, ids) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _ = self.emissions(ids)
        n, t, k = e.shape
        score, back = e[:, 0], np.zeros((n, t, k), np.int64)
        for i in range(1, t):
            both = score[:, :, None] + self.p["trans"]
            back[:, i] = both.argmax(axis=1)
            score = both.max(axis=1) + e[:, i]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = score.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        return out


def tags_of(spans, start: int) -> np.ndarray:
    """Tags of a window: 0 outside, 1 + 2k at the start of kind k's span, 2 + 2k within."""
    out = np.zeros(WINDOW, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, WINDOW)
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = 2 + 2 * k
            if a >= start:
                out[lo] = 1 + 2 * k
    return out


def _word(rng: random.Random, low: int = 3, high: int = 8) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _grouped(rng: random.Random, digits: str, mark: str, low: int = 2, high: int = 4) -> str:
    out = []
    while digits:
        k = rng.randint(low, high)
        out.append(digits[:k])
        digits = digits[k:]
    return mark.join(out)


def rendered(rng: random.Random, kind: str, odd: bool) -> str:
    """A made-up datum of the kind: in the base patterns' form, or, if odd, in one that they miss."""
    if kind == "email":
        local = _word(rng) + rng.choice(["", "." + _word(rng), "_" + _word(rng), _number(rng, rng.randint(1, 3))])
        host, top = _word(rng), rng.choice(["com", "net", "org", "de", "fr", "es", "io"])
        if not odd:
            return f"{local}@{host}.{top}"
        at = rng.choice([" @ ", "(at)", " (at) ", "[at]", " [at] ", "@"])
        dot = rng.choice(["[dot]", " [dot] ", "(dot)", "[.]"] if at == "@" else [".", ".", "[dot]", " [dot] ", "(dot)"])
        return f"{local}{at}{host}{dot}{top}"
    if kind == "ip":
        mark = rng.choice(["[.]", "(.)", " . ", "[dot]"]) if odd else "."
        return mark.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = _number(rng, rng.choice([15, 15, 14, 13]))
        digits += next(str(c) for c in range(10) if luhn(digits + str(c)))
        mark = rng.choice([".", "/", "_", "  ", " - ", "\u2013"]) if odd else rng.choice(["", " ", "-"])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    code, rest = _number(rng, rng.randint(1, 3)), _number(rng, rng.randint(8, 10))
    if not odd:
        return f"+{code} {_grouped(rng, rest, rng.choice([' ', '-', '.']))}"
    if rng.random() < 0.3:
        return f"+{code}/{_grouped(rng, rest, '/')}"
    return rng.choice([f"00{code} ", f"00{code}-", f"(00{code}) ", f"(0{code}) "]) + _grouped(rng, rest, rng.choice([" ", "-", ".", "/"]), 3, 4)


def decoy(rng: random.Random) -> str:
    """A number or sign that is no personal data."""
    return rng.choice([
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: _number(rng, rng.randint(1, 8)), lambda: f"{_number(rng, 3)},{_number(rng, 3)},{_number(rng, 3)}", lambda: f"({rng.randint(1, 99)})", lambda: f"#{_number(rng, 5)}",
        lambda: f"{_number(rng, 2)} / {_number(rng, 2)}", lambda: f"@{_word(rng)}", lambda: f"{_word(rng)} (at) {_word(rng)}", lambda: f"{_word(rng)} [{rng.randint(1, 9)}]", lambda: f"{rng.randint(1, 99)}.{rng.randint(1, 99)} %",
    ])()


def put_in(rng: random.Random, text: str, odd: bool = True) -> tuple[str, list[tuple[str, int, int]]]:
    """A window's text with one to three renderings and decoys between its words, and their spans."""
    words, spans, out = text.split(" "), [], ""
    places = {rng.randint(0, len(words)): rng.choice([*KINDS, *KINDS, "", ""]) for _ in range(rng.randint(1, 3))}
    for i in range(len(words) + 1):
        if i in places:
            kind = places[i]
            piece = rendered(rng, kind, odd and rng.random() < 0.75) if kind else decoy(rng)
            out += rng.choice(["", "", "(", ": "]) if out else ""
            if kind:
                spans.append((kind, len(out), len(out) + len(piece)))
            out += piece + rng.choice([" ", " ", ", ", ". "])
        if i < len(words):
            out += words[i] + " "
    return out, spans


def fit(docs: DataFrame, sample: int = 400, per_document: int = 16, steps: int = 400, seed: int = 5) -> Tagger | None:
    """A tagger trained on at most `sample` documents (those of least hash with a digit or at-sign), at
    most `per_document` windows of each: as they are, labelled with the base spans, and twice more with
    renderings put in; None where there are none."""

    def label(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                ids, spans = characters(text), base_spans(text)
                starts = windows(text)
                starts = starts[:: -(-len(starts) // per_document)] if starts else starts
                rng = random.Random(f"{seed} {text}")
                for s, x in zip(starts, cut(ids, starts), strict=True):
                    rows.append((x.astype(np.uint8).tobytes(), tags_of(spans, s).astype(np.uint8).tobytes()))
                    for _ in range(2):
                        made, own = put_in(rng, text[s : s + WINDOW // 2])
                        own = sorted(own + [b for b in base_spans(made) if all(b[2] <= y or z <= b[1] for _, y, z in own)], key=lambda o: o[1])
                        at = rng.randint(0, max(0, len(made) - WINDOW)) if rng.random() < 0.5 else 0
                        rows.append((cut(characters(made), [at])[0].astype(np.uint8).tobytes(), tags_of(own, at).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["ids", "tags"])

    some = docs.where(F.col("text").rlike("[0-9@]"))
    chosen = some.select("doc_id", F.xxhash64("doc_id", F.lit(2)).alias("h")).orderBy("h", "doc_id").limit(sample)
    picked = some.join(F.broadcast(chosen.distinct()), "doc_id").select("text")
    rows = sorted((bytes(r.ids), bytes(r.tags)) for r in picked.limit(4 * sample).mapInArrow(label, "ids binary, tags binary").collect())
    if not rows:
        return None
    ids = np.array([np.frombuffer(r[0], np.uint8) for r in rows]).astype(np.int64)
    tags = np.array([np.frombuffer(r[1], np.uint8) for r in rows]).astype(np.int64)
    tagger = Tagger(seed)
    tagger.train(ids, tags, steps, 48, seed)
    return tagger


#: What a span that the network adds must look like at least.
_LOOKS = {
    "email": re.compile(r"[\w.%+-]+\s?(@|[(\[]at[)\]])\s?[\w-]+(\s?(\.|[(\[](dot|\.)[)\]])\s?[\w-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(\s?[(\[]?(\.|dot)[)\]]?\s?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9][0-9\s./_\u2013-]+[0-9]"),
    "phone": re.compile(r"(\+|00|\(0)[0-9\s()./\u2013-]+[0-9]"),
}


def _plausible(kind: str, text: str) -> bool:
    """A span that the network adds must still be able to be of its kind: letters and marks, the number
    of digits, octets of an address, check digit of a card."""
    digits = _digits(text)
    if not _LOOKS[kind].fullmatch(text):
        return False
    if kind == "ip":
        return all(int(n) <= 255 for n in re.findall("[0-9]+", text))
    return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def added_spans(texts: list[str], base: list[list], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans of the decoded windows of each text that no base span overlaps, reconciled: one that
    a window's edge cuts gives way to the window that has it whole, the longer one to its part."""
    starts = [windows(t) for t in texts]
    ids = np.concatenate([cut(characters(t), s) for t, s in zip(texts, starts, strict=True)])
    tags = np.concatenate([tagger.decode(ids[i : i + 256]) for i in range(0, len(ids), 256)]) if len(ids) else ids
    out, at = [], 0
    for text, own, known in zip(texts, starts, base, strict=True):
        found = set()
        for s, row in zip(own, tags[at : at + len(own)].tolist(), strict=True):
            i = 0
            while i < WINDOW:
                if row[i] == 0:
                    i += 1
                    continue
                k, j = (row[i] - 1) // 2, i + 1
                while j < WINDOW and row[j] == 2 + 2 * k:
                    j += 1
                whole = (i > 0 or s == 0) and (j < WINDOW or s + WINDOW >= len(text))
                if whole and s + j <= len(text):
                    found.add((KINDS[k], s + i, s + j))
                i = j
        at += len(own)
        kept: list[tuple[str, int, int]] = []
        taken = [(a, b) for _, a, b in known]
        for kind, a, b in sorted(found, key=lambda x: (x[1] - x[2], x)):
            if _plausible(kind, text[a:b]) and all(b <= x or y <= a for x, y in taken):
                kept.append((kind, a, b))
                taken.append((a, b))
        out.append(kept)
    return out


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with columns base_spans and spans: array<struct<kind, start, end>>, base spans and
    these with the network's, both by kind (email, ip, card, phone), then start.

    Starts and ends count code points, the end is exclusive. A null text counts as empty; a
    text without digit or at-sign has no spans. Row-local; repeated rows are treated alike, and
    columns of these names that docs already has are replaced. Without tagger no spans are added.
    """
    made = ["base_spans", "spans"]
    kept = [c for c in docs.columns if c not in made]
    kind = "array<struct<kind:string,start:long,end:long>>"
    schema = docs.select(*kept).withColumns({c: F.lit(None).cast(kind) for c in made}).schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            some = [i for i, t in enumerate(texts) if _TRIGGER.search(t)]
            base: list[list] = [[] for _ in texts]
            for i in some:
                base[i] = base_spans(texts[i])
            all_ = list(base)
            for at in range(0, len(some) if model.value else 0, 64):
                part = some[at : at + 64]
                for i, more in zip(part, added_spans([texts[i] for i in part], [base[i] for i in part], model.value), strict=True):
                    all_[i] = sorted([*base[i], *more], key=lambda s: (order[s[0]], s[1], s[2]))
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in y], arrow) for y in (base, all_)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], [*kept, *made])

    return docs.mapInArrow(run, schema)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, fit(docs))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.encode(joined("base_spans"), "utf-8"), 256).alias("base_sha256"), joined("spans").alias("spans"))
