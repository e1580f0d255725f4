"""Periodic runs against a loop over all periods."""

import hashlib
import random
import re
import zlib

import pytest

from parley.llm import periods

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, n_words int"


def brute(w, words=6, times=4):
    n, out = len(w), []
    for d in range(1, n // times + 1):
        i = 0
        while i + d < n:
            if w[i] != w[i + d]:
                i += 1
                continue
            s = i
            while i + d < n and w[i] == w[i + d]:
                i += 1
            length = i - s + d
            part = w[s : s + length]
            if length >= max(words, times * d) and not any(part[e:] == part[: length - e] for e in range(1, d)):
                out.append((s, length, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, d in runs for i in range(s + d, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs():
    rng = random.Random(3)
    for _ in range(1500):
        w = []
        while len(w) < rng.randint(5, 80):
            unit = [rng.randint(0, rng.choice((1, 2, 5))) for _ in range(rng.randint(1, 6))]
            w += (unit * rng.randint(1, 8))[: rng.randint(1, 40)]
        assert periods.runs(w) == brute(w)
        assert periods.runs(w, 2, 2) == brute(w, 2, 2)
        assert periods.text_runs([b"%d" % x for x in w]) == brute(w)


@pytest.mark.parametrize("w", [[1] * 60000, [*range(2000)] * 20, [*range(7)] * 3 + [7] * 5 + [*range(7)] * 4])
def test_known(w):
    p = len(set(w)) if len(w) > 100 else None
    assert periods.runs(w) == ([(0, len(w), p)] if p else [(26, 28, 7)])


def test_find(spark):
    rng = random.Random(1)
    docs = [(1, None, "a", 1), (2, "", "a", 1), (3, " \n\t", "a", 1), (None, "x " * 6, None, None), (4, "x y x y\x0bx y x y x y x y é", "", 0), (4, "a b " * 4, "", 0), (4, "a b " * 4, "", 0), (5, "a b " * 3 + "a", "", 0), (6, "x x x x x", "", 0)]
    docs += [(i, "".join(rng.choice("ab") + rng.choice((" ", " ", "\n")) for _ in range(40)), "", 0) for i in range(7, 60)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.find(spark.createDataFrame(docs, SCHEMA)).collect())
    want = sorted(((-1 if i is None else i), len(w := split(t)), brute(w), collapsed(w, brute(w))) for i, t, *_ in docs)
    assert got == want and sum(len(r[2]) for r in got) > 20
    assert periods.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    """3 MB without a run but for its end, and 400,000 words that are all in one."""
    plain = " ".join(f"w{i % 7919 * (i % 104729)}" for i in range(300000)) + " end" * 9
    rows = periods.find(spark.createDataFrame([(1, plain, "", 0), (2, "to be or not to be " * 66667, "", 0)], SCHEMA)).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows[0].runs][-1] == (300000, 9, 1) and rows[0].collapsed.endswith(" end") and not rows[0].collapsed.endswith(" end end")
    assert [tuple(x) for x in rows[1].runs] == [(0, 400002, 6)] and rows[1].collapsed == "to be or not to be"


def test_query(spark):
    rows = {r.doc_id: r for r in periods.op12_periods(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc, text in docs:
        w, h = split(text), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = (None,) * 4
        if runs:
            s, n, d = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            best = (s, n, d, 1000 * n // d)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{d}\n" for s, n, d in runs), collapsed(w, runs))]
        assert tuple(rows[doc]) == (doc, len(runs), *best, *sha)
    assert sum(r.n_runs > 0 for r in rows.values()) > 5
