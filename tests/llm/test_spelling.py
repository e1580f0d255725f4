"""Spelling variants against a comparison of every two words."""

import random
import re
import zlib
from collections import Counter

from parley.llm import spelling

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n int, part int"


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if x == y or len(y) - len(x) > 1:
        return False
    i = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def brute(counts):
    out = {}
    for w, n in counts.items():
        by = sorted((-c, v) for v, c in counts.items() if near(w, v))
        form = by[0][1] if by and -by[0][0] >= 2 * n else None
        out[w] = (form, n, len(by), counts[form] if form else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def counted(docs, edit):
    counts = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc}:{w}".encode()) if edit and doc is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_variants(spark):
    """Words of few letters, so that many are near; parts and slices of a few words."""
    rng, counts = random.Random(4), {}
    for _ in range(400):
        w = "".join(rng.choice("abÿ") for _ in range(rng.randint(5, 8)))
        counts[w] = rng.choice((3, 3, 4, 6, 8, 12, 24, 50, 100))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert sum(r[4] for r in want) > 800 and sum(r[1] != r[2] and r[1] is not None for r in want) > 10
    for part, slice_ in ((1024, 4096), (40, 16), (10000, 50)):
        assert got(spelling.variants(df, part, slice_)) == want


def test_long_words(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (64, 65, 300, 5000)]
    counts = {}
    for w in base:
        for i in (0, len(w) // 2, len(w) - 1):
            counts |= {w: 100, w[:i] + w[i + 1 :]: 10, w[:i] + "z" + w[i + 1 :]: 10, w[:i] + "z" + w[i:]: 10, w[:i] + "zz" + w[i:]: 5}
    assert got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_group(spark):
    texts = [None, "", " 1,2 ", "Straße STRASSE straße", "Åelan İstanbul École école ÉCOLE", "hello helo hallo hellos Hello HELLO héllo x-hello_hello1hello" * 3, "aaaaa aaaaaa aaaaaaa " * 5, "×÷×÷× " * 4]
    docs = [(i, t, "w", 1, 1) for i, t in enumerate(texts)] + [(5, texts[5], "w", 1, 1), (None, texts[6], None, None, None)]
    df = spark.createDataFrame(docs, SCHEMA)
    for edit in (False, True):
        want = brute(counted([(d[0], d[1]) for d in docs], edit))
        assert got(spelling.group(df, edit)) == want and len(want) > 5
    empty = spelling.group(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_pieces(spark):
    """Texts cut at words; one of 2 MB in a row."""
    text = "abcde abcdf " * 30 + "x" * 300 + " abcde"
    df = spark.createDataFrame([(1, text, "", 0, 0)], SCHEMA)
    want = Counter({w: n for w, n in Counter(text.split()).items() if n >= 3})
    assert {r.word: r.n for r in spelling.vocabulary(df, size=7).collect()} == want
    big = spark.createDataFrame([(1, text * 3000, "", 0, 0)], SCHEMA)
    assert {r.word: r.n for r in spelling.vocabulary(big).collect()} == {w: n for w, n in Counter(re.findall("[a-z]+", text * 3000)).items() if n >= 3}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(docs, True))
    assert got(spelling.op11_spelling(spark, DIR)) == want and sum(r[1] is not None for r in want) > 20
