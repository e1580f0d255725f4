"""License scans against a loop over all blocks."""

import random
import re
from math import ceil

import duckdb
import pytest

from parley.llm import licenses
from parley.llm.licenses import TEMPLATES, template

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, n_words int, p int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, templates=TEMPLATES):
    w, out = words(text), []
    for t, x in enumerate(templates):
        m, want = len(x.words), set(x.words)
        if x.phrase:
            out += [(i, t, 1.0) for i in range(len(w) - m + 1) if tuple(w[i : i + m]) == x.words]
            continue
        for at in range(0, len(w), m):
            both = len(want & set(w[at : at + 2 * m]))
            if both >= ceil(len(want) * x.least - 1e-9):
                out.append((at, t, both / len(want)))
    return len(w), sorted(out)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [(f.start, f.template, f.containment) for f in r.found]) for r in df.collect())


def test_passages(spark):
    """Whole, edited, shuffled, cut and repeated templates among other words, which share many of theirs."""
    rng, docs = random.Random(5), []
    pool = sorted({w for x in TEMPLATES for w in x.words}) + [f"w{i}" for i in range(40)]
    for i in range(150):
        text = rng.choices(pool, k=rng.randint(0, 60))
        for x in rng.sample(TEMPLATES, 2):
            part = list(x.words)
            for _ in range(rng.randint(0, max(1, len(part) // 3))):
                part[rng.randrange(len(part))] = rng.choice(pool)
            if rng.random() < 0.2:
                rng.shuffle(part)
            text += part * rng.choice((1, 1, 2)) + rng.choices(pool, k=rng.randint(0, 30))
        docs.append((i, "".join(w.upper() + rng.choice(" \n.,- ") if rng.random() < 0.3 else w + rng.choice((" ", " ", "\x00", "'s ")) for w in text), "a", 1, 1))
    want = [(i, *brute(text)) for i, text, *_ in docs]
    assert got(licenses.scan(spark.createDataFrame(docs, SCHEMA))) == want and sum(len(f) for *_, f in want) > 200


def test_edges(spark):
    same = (4, "All rights reserved.", "x", 1, 1)
    docs = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (3, " .,\n", "a", 1, 1), same, same, (None, "cc-BY cc by", None, None, None), (5, "CCKBY cc É by GPL", "", 0, 0), (6, "cc", "", 0, 0)]
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, *_ in docs)
    assert got(licenses.scan(spark.createDataFrame(docs, SCHEMA))) == want
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.found for r in licenses.scan(spark.createDataFrame(docs[3:4], SCHEMA), ()).collect()] == [[]]


def test_equal_words_and_ties(spark):
    """A template with repeated words, two of one passage, tokens of one frequency."""
    own = (template("a", "x y x y z", 1, True), template("b", "x y x y z", 0.6), template("c", "q r s", 0.5))
    docs = [(1, "x y x y x y z q s", "", 0, 0), (2, "z y", "", 0, 0), (3, "r r r r", "", 0, 0), (4, "q", "", 0, 0)]
    assert got(licenses.scan(spark.createDataFrame(docs, SCHEMA), own)) == [(i, *brute(t, own)) for i, t, *_ in docs]


def test_long_text(spark):
    """Phrases across the ends of pieces, words longer than a piece, and a text of 5 MB in one row."""
    phrases = tuple(x for x in TEMPLATES if x.phrase)
    rng = random.Random(2)
    text = " ".join(rng.choice(("cc by", "General Public License", "all", "rights", "reserved", "x" * 70, "é")) for _ in range(300))
    docs = [(1, text, "", 0, 0), (2, "all rights\n" * 40, "", 0, 0)]
    for size in (20, 50):
        assert got(licenses.scan(spark.createDataFrame(docs, SCHEMA), phrases, size)) == [(i, *brute(t, phrases)) for i, t, *_ in docs]
    big = "lorem ipsum dolor " * 280000 + "all rights reserved " + "x" * 200000 + " cc by"
    assert got(licenses.scan(spark.createDataFrame([(1, big, "", 0, 0)], SCHEMA), phrases)) == [(1, *brute(big, phrases))]


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    df, want = licenses.op13_licenses(spark, DIR), con.sql(licenses.SQL)
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
    assert not any("Python" in line or "Arrow" in line for line in df._jdf.queryExecution().executedPlan().toString().split("\n"))


@pytest.mark.parametrize("text", ["All rights, reserved? all-rights-RESERVED", "gnu general public license version 3"])
def test_places(spark, text):
    rows = licenses.scan(spark.createDataFrame([(1, text, "", 0, 0)], SCHEMA)).collect()
    assert [f.start for f in rows[0].found if f.template < 3] == [s for s, t, _ in brute(text)[1] if t < 3]
