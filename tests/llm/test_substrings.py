import hashlib
import random

from parley.llm import substrings


def brute(docs):
    """doc_id -> (removed, spans, kept) by a table of all 100-byte strings."""
    seen, out = {}, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if seen.setdefault(w, (d, p)) != (d, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    df = substrings.remove_repeats(spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, th string"))
    out = []
    for r in df.collect():
        raw = (r.text or "").encode()
        assert sum(s.end - s.start for s in r.spans) == len(raw) - len(r.kept)
        out.append((r.doc_id, len(raw), len(raw) - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, docs = text(60), []
    for i in range(160):
        t = text(rng.randint(0, 120))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 7 == 0 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "").split(" ")
            for _ in range(len(w) // 15):
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        docs.append((i * 3, t))
    docs += [(1, None), (2, ""), (4, "z" * 99), (5, "z" * 100), (7, "z" * 500), (8, "ab" * 300), (10, "ab" * 300), (11, passage), (None, passage), (10**12, docs[9][1])]
    assert run(spark, docs) == brute(docs)


def test_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LARGE", 1)
    test_against_brute_force(spark)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in substrings.op7_substrings(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    """A document repeated a thousand times in full costs about what one of them does."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = [(2, text)] * 1000 + [(1, text[500:900] + "x"), (3, text[1000:])]
    rows = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 1002
    assert {(r.doc_id, bytes(r.kept)) for r in rows} == {(1, (text[500:900] + "x").encode()), (2, (text[:500] + text[900:]).encode()), (3, b"")}
