import random

import duckdb

from parley.llm import ngram_join


def brute(docs):
    sets = []
    for d, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(60)]
    docs, bases = [], [[rng.choice(vocab) for _ in range(n)] for n in (3, 8, 12, 40, 90, 300)]
    for i in range(150):
        w = list(rng.choice(bases)) if i % 3 else [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 5 == 0:
            w += common
        docs.append((1000 - i, " ".join(x.upper() if i % 2 else x for x in w)))
    return docs + [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "One"), (9, "One"), (None, docs[0][1]), (None, None)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    docs = make(2)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, node int, n int")
    got = ngram_join.near_duplicates(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs)


def test_one_large_group(spark):
    """Near copies of one text, of which many do not link with one another directly."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    docs = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs)


def test_documents_and_sql(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in ngram_join.op8_ngram_join(spark, d).collect()), key=str)
    assert got == brute(docs)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    assert sorted(con.sql(ngram_join.SQL).fetchall(), key=str) == got


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
