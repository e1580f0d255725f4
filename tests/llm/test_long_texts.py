"""Texts longer than the pieces in which they are read, and inputs larger than their bounds."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import common, embeddings, language, ngram_join, substrings

from .test_substrings import brute, run


def test_language_pieces(monkeypatch):
    """Reading a text in pieces changes nothing."""
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], np.vstack([rng.normal(0, 1, (language.BUCKETS, 2)), np.zeros((1, 2))]), np.zeros(2), 1.0, 0.0)
    texts = pa.array(["x" * 5, "ab" * 500 + "é" * 77, "", "the end " * 90, "q"])
    whole = model.probabilities(texts)
    for size in (50, 64, 701):
        monkeypatch.setattr(language, "PIECE", size)
        assert np.allclose(model.probabilities(texts), whole, atol=1e-9)


def test_language_sample(spark):
    """No more of a language than asked, and no more languages; repeated rows count each."""
    rows = [(i, f"text {i}", "en" if i % 10 else "de") for i in range(3000)] + [(1, "same", "fr")] * 300 + [(2, None, "it"), (3, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in language.sample(docs, 50, 8).groupBy("lang").count().collect()}
    assert got["en"] == 50 and got["de"] == 50 and got.get("fr", 0) in (0, 50) and set(got) <= {"en", "de", "fr"}
    assert {r.lang for r in language.sample(docs, 50, 1).collect()} == {"en"}
    # only hashes under a bound are ranked
    assert "<= share" in language.sample(docs, 50, 8)._jdf.queryExecution().optimizedPlan().toString()


def test_pieces(monkeypatch):
    """Every window starts in one piece and lies in it whole."""
    monkeypatch.setattr(substrings, "PIECE", 300)
    offsets = np.array([0, 90, 90, 1500, 1620, 1719, 4000])
    seen = []
    for lo, hi, start, end in substrings.pieces(offsets):
        for row in range(lo, hi):
            a, b = offsets[row] - offsets[lo], offsets[row + 1] - offsets[lo]
            seen += [(row, p - int(a)) for p in range(max(int(a), start), min(int(b), end) - substrings.LENGTH + 1)]
    want = [(row, p) for row in range(6) for p in range(offsets[row + 1] - offsets[row] - substrings.LENGTH + 1)]
    assert sorted(seen) == want


def test_long_repeats(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, far = text(400), text(90_000)
    docs = [(1, far[:200_000] + passage + far[200_000:]), (2, text(30) + far[261_000:263_500] + passage), (3, passage[50:1500] + text(70_000) + far[:150]), (4, "xy" * 150_000)]
    assert max(len(t) for _, t in docs) > substrings.PIECE
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping(seed):
    """The product by blocks against plain sets, at and around the threshold."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    x = np.sort(rng.choice(pool, 100, replace=False))
    ys = [np.sort(np.unique(np.concatenate([rng.choice(x, k, replace=False), rng.choice(pool, rng.integers(0, 30), replace=False)]))) for k in rng.integers(60, 100, 80)]
    ys += [x, x[:1], x[:80], pool, np.empty(0, np.uint64)]
    want = [len(y) > 0 and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)) for y in ys]
    assert ngram_join.overlapping(x, ys, 80, 100).tolist() == want and any(want) and not all(want)


def test_by_part():
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["part", "x"])
    assert list(common.by_part([batch((1, "a"), (1, "b"), (3, "c")), batch((3, "d"), (4, "e"))])) == [[["a"], ["b"]], [["c"], ["d"]], [["e"]]]
    assert list(common.by_part([])) == []


def test_block_pairs(spark, monkeypatch):
    """Clusters far apart make few tiles, and tiles without a doubtful product need no vectors in full."""
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    monkeypatch.setattr(embeddings, "GROUP", 3)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        signs = np.where(rng.random(24) < 0.5, -1.0, 1.0)
        rows += [(k * 50 + i, [float(v) for v in signs + rng.normal(0, 0.02, 24)]) for i in range(50)]
    made = []
    tiles = embeddings._tiles
    monkeypatch.setattr(embeddings, "_tiles", lambda blocks, pairs, t, full: made.append((full, blocks.count(), pairs.count())) or tiles(blocks, pairs, t, full))
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 49 and r.component_id == r.vec_id // 50 * 50 for r in got)
    (_, blocks, first), (full, _, again) = made
    assert full and again == 0 and first < blocks * (blocks + 1) // 4


def test_long_turn():
    """Reading back one turn of 20 MB takes a few times its size."""
    code = "import resource; from parley.llm import chat; t = b'### user: ' + rb'a\\<b ' * 5_000_000 + b'</turn>\\n'; x = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m = chat._PARTS.match(t); assert m.end() == len(t); del m; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - x)"
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert grown < 200_000
