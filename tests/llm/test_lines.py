"""Line dedup against brute force with its own shingle width."""

import random

from pyspark.sql import functions as F

from parley.llm import components, lines

from .test_operators import brute_lines

DIR = "/root/testdata/sf0.001"
WIDTH = 4


def edited(seed=5):
    """Documents of one line: lines of 30 to 100 characters, each with one-character and one-word edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8)))
    docs = []
    for n in range(30, 101, 2):
        w = [word()]
        while len(" ".join(w)) < n:
            w.append(word())
        line = " ".join(w)[:n]
        char, at = list(line), rng.randrange(5, n - 5)
        char[at] = "z"
        w = line.split(" ")
        w[rng.randrange(1, len(w) - 1)] = "zu"
        docs += [line, "".join(char), " ".join(w)]
    return list(enumerate(docs))


def test_edited_lines(spark):
    docs = edited()
    want = brute_lines(docs, WIDTH)
    assert len(want) >= 50 > 30 >= len(brute_lines(docs, 8))
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == want


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want = brute_lines(docs, WIDTH)
    assert {r.doc_id: r.n_removed for r in lines.op9_line_dedup(spark, DIR).collect() if r.n_removed} == want


def missed(spark, pairs):
    """The share of pairs of lines without a common key, or with too few equal minima."""
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    got = lines.signed(spark.createDataFrame(rows, "h long, line string").repartition("h"))
    a, b = (got.where(F.expr(f"node % 2 = {k}")).select(F.expr("node div 2").alias("pair"), *[F.col(c).alias(f"{x}{c}") for c in got.columns]) for k, x in ((0, "x_"), (1, "y_")))
    band = F.lit(False)
    for i in range(lines.BANDS):
        band = band | F.coalesce(F.col(f"x_k{i}") == F.col(f"y_k{i}"), F.lit(False))
    return 1 - a.join(b, "pair").where(band & lines._agree()("x_", "y_")).select("pair").distinct().count() / len(pairs)


def test_minima_independent(spark):
    """Two sets with 4 of 5 shingles in common share a band as under independent orders."""
    rng = random.Random(7)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(7)) for _ in range(3000)]
    assert missed(spark, [(x, x + ".") for x in words]) < 0.006


def test_recall_by_length(spark):
    """Lines with as many changed characters as 0.8 allows, over all classes and where they overlap."""
    rng = random.Random(3)
    for n in (45, 56, 64, 90, 180, 199, 400, 700, 1500):
        pairs = []
        for _ in range(400):
            x = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)]
            y, wrong = list(x), (n - 3) // 9 // 4
            for k in range(wrong):
                y[5 + k * (n - 10) // wrong] = "z"
            pairs.append(("".join(x), "".join(y)))
        assert missed(spark, pairs) < 0.04, n


def test_similarity_of_exactly_the_threshold(spark):
    """4k of 5k shingles in common: 0.8, and with one more in the union under it."""
    rows = [(True, 4 * k, 5 * k) for k in (1, 7, 14, 23, 28, 100)] + [(False, 4 * k, 5 * k + 1) for k in (1, 7, 14, 23, 28, 100)]
    df = spark.createDataFrame(rows, "want boolean, i long, u long")
    assert all(r.want == r.got for r in df.select("want", lines._alike(0.8).alias("got")).collect())


def test_repeated_shingles(spark):
    """Equal and nearly equal sets of shingles in lines of very different lengths."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    made = ["-" * 40, "-" * 300, "=" * 60, "=" * 80, "ab" * 20, "ab" * 500, "see page " * 3, "see page " * 8]
    for n in (4, 8, 20, 60):
        unit = " ".join(word() for _ in range(n)) + " "
        made += [unit * 3, unit * 8, unit * 40]
    made += [f"Chapter one {'.' * n} 12" for n in (20, 60, 200, 900)]
    docs = list(enumerate(made))
    want = brute_lines(docs, WIDTH)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == want and len(want) >= 15


def test_pairs_compared_within_their_row(spark, monkeypatch):
    """No row for each shingle of a pair is made or shuffled, whatever the number of pairs."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(5)]
    rows = [(i, x if i < 5 else x[:100] + "z" * (i - 4) + x[100:]) for i, x in enumerate(base * 5)]
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "a long, b long")
    plans, save = [], lines.save
    monkeypatch.setattr(lines, "save", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df))
    got = lines.verify_pairs(spark.createDataFrame(rows, "node long, line string"), WIDTH, 0.8)(pairs)
    sets = [{x[i : i + WIDTH] for i in range(len(x) - WIDTH + 1)} for _, x in rows]
    want = {(a, b) for a, b in pairs.collect() if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in got.collect()} == want and 20 < len(want) < len(rows) * (len(rows) - 1) // 2
    assert plans and not any("explode(sequence(" in plan for plan in plans)


def test_digests_tell_pairs_below_the_threshold_apart(spark):
    """Lines at about 0.65 are seldom compared in full."""
    rng = random.Random(9)
    pairs = []
    for _ in range(200):
        x = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(390)]
        y = list(x)
        for k in range(20):
            y[8 + 19 * k] = "z"
        pairs.append(("".join(x), "".join(y)))
    assert missed(spark, pairs) > 0.9


def test_slices(spark):
    """A bucket that is 64 times as large is shipped in 8 times as many slices, not in 64 times."""
    got = [lines._slices(F.lit(c)) for c in (2, 256, 1024, 65536)]
    assert spark.range(1).select(*got).first()[:] == (1, 1, 2, 16)


def test_last_step_in_parts(spark):
    """Parts of the buckets find the pairs that all at once do."""
    rows = [(k, n, n) for k in range(9) for n in range(k, 30, k + 1)]
    labelled = spark.createDataFrame(rows, "key long, node long, label long")
    could = lambda x, y: F.col(f"{x}node") % 3 == F.col(f"{y}node") % 3
    got = [components._whole_buckets(labelled, could, None, lines._slices, parts) for parts in (1, 4)]
    one, four = (sorted(tuple(r) for r in df.collect()) for df in got)
    assert one == four == sorted({(a, b) for k, a, _ in rows for j, b, _ in rows if k == j and a < b and a % 3 == b % 3})


def near(spark, pairs):
    """The share of pairs of lines that the last step's digests let pass."""
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    got = lines.exact_sketches(spark.createDataFrame(rows, "h long, line string").repartition("h"))
    a, b = (got.where(F.expr(f"node % 2 = {k}")).select(F.expr("node div 2").alias("pair"), *[F.col(c).alias(f"{x}{c}") for c in got.columns]) for k, x in ((0, "x_"), (1, "y_")))
    return a.join(b, "pair").where(lines._close(0.8)("x_", "y_")).select("pair").distinct().count() / len(pairs)


def test_last_digests(spark):
    """At the threshold no more than one pair of 100 is lost at any length; at 0.7, which the signing digests let pass, next to none is compared in full."""
    rng = random.Random(12)

    def pairs(n, wrong):
        made = []
        for _ in range(150):
            x = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)]
            y = list(x)
            for k in range(wrong):
                y[5 + k * (n - 10) // wrong] = "z"
            made.append(("".join(x), "".join(y)))
        return made

    for n in (20, 45, 64, 180, 400, 900, 1500, 6000):
        assert near(spark, pairs(n, (n - 3) // 9 // 4)) >= 0.99, n
    for n in (180, 400, 900):
        assert near(spark, pairs(n, (n - 3) * 3 // 17 // 4 + 1)) <= 0.05, n


def test_near_copies_that_do_not_link(spark, monkeypatch):
    """A group of near copies under the threshold: few pairs are compared in full."""
    rng = random.Random(6)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(280)]
    docs = []
    for i in range(60):
        x = list(base)
        for k in range(6):
            x[rng.randrange(46) + 46 * k] = chr(0x4E00 + 6 * i + k)
        docs.append((i, "".join(x)))
    compared, verify = [], lines.verify_pairs

    def counted(*args):
        own = verify(*args)
        return lambda pairs: (compared.append(pairs.count()), own(pairs))[1]

    monkeypatch.setattr(lines, "verify_pairs", counted)
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == brute_lines(docs, WIDTH)
    # the rounds before are linear; the last has all that is left of 1,770 pairs
    assert compared[-1] < 60 and sum(compared) < 60 * 10, compared
