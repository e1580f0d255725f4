"""Each stage of the corpus pipeline against a brute-force version on what the stage before it kept."""

import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from parley.llm import bpe, language, mixing

from .test_ngram_join import brute as brute_components
from .test_operators import brute_line_classes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage and the pipeline's result, as lists of rows."""
    docs = corpus_pipeline.load(spark, DIR, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, DIR))
        out.append(docs.collect())
    return out


def test_columns(spark, steps):
    want = corpus_pipeline.load(spark, DIR, "documents").columns
    assert all(rows and rows[0].__fields__ == want for rows in steps[:-1])


def test_language_stage(spark, steps):
    docs = corpus_pipeline.load(spark, DIR, "documents")
    model = language.fit(docs.where(language.learnable()))
    kept = []
    for r in steps[0]:
        if any(c.isalpha() for c in r.text or "") and model.probabilities(pa.array([r.text])).max() >= model.reject_below:
            kept.append(r.doc_id)
    assert sorted(kept) == sorted(r.doc_id for r in steps[1])
    assert len(kept) >= 0.97 * sum(any(c.isalpha() for c in r.text or "") for r in steps[0])


def test_line_stage(steps):
    classes = brute_line_classes([(r.doc_id, r.text) for r in steps[1]])
    seen, want = set(), {}
    for r in sorted(steps[1], key=lambda r: r.doc_id):
        rest, n, gone = [], 0, 0
        for x in r.text.split("\n"):
            solid = re.search(r"[^\x20\x09-\x0D]", x) is not None
            n += solid
            if solid and classes[x] in seen:
                gone += 1
            else:
                rest.append(x)
            if solid:
                seen.add(classes[x])
        if not n or gone < n:
            want[r.doc_id] = "\n".join(rest)
    assert {r.doc_id: r.text for r in steps[2]} == want
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_join_stage(steps):
    kept = {d for d, _, low in brute_components([(r.doc_id, r.text) for r in steps[2]]) if d == low}
    assert sorted(steps[3]) == sorted(r for r in steps[2] if r.doc_id in kept)


def test_mixing_stage(steps):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert set(steps[4]) <= set(steps[3]) and max(Counter(steps[4]).values()) <= 2
    names = sorted({r.source for r in steps[3]}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size(r) for r in steps[3] if r.source == s) for s in names}
    for s, target in zip(names, mixing.targets([own[s] for s in names]), strict=True):
        # whole passes, then the nearest sum from below that whole documents make
        budget = round(target)
        passes, reach = min(2, budget // own[s]), 1
        for r in steps[3]:
            if r.source == s:
                reach |= reach << size(r)
        best = (reach & ((1 << (budget - passes * own[s] + 1)) - 1)).bit_length() - 1
        assert sum(size(r) for r in steps[4] if r.source == s) == passes * own[s] + best


def test_encoding_stage(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    coded = {x: b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids) for x in {r.text for r in steps[4]}}
    want = Counter((r.doc_id, r.source, len(coded[r.text]) // 4, coded[r.text]) for r in steps[4])
    assert Counter((r.doc_id, r.source, r.n_tokens, bytes(r.ids)) for r in steps[5]) == want


EDGES = [(1, None, None, None), (2, "", "s", "en"), (3, " \t\n", "s", None), (4, "one line of words here", "s", "en"), (4, "one line of words here", "s", "en"), (None, "two words", None, "en"), (5, "wide words " * 20000, "t", "de")]


@pytest.mark.parametrize("rows", [EDGES, []])
def test_edges(spark, rows):
    """Nulls, repeated rows, a long text and clashing columns pass every stage; no rows stay no rows."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, node int, h int, size int, label int"
    docs = spark.createDataFrame([(*r, None, 1, 2, 3, 4) for r in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert out.count() <= 2 * docs.count()
        if rows:
            out.collect()
    assert corpus_pipeline.encode(spark, docs, DIR).count() == len(rows)
