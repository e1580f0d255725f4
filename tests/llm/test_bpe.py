import hashlib

from parley.llm import bpe

TEXTS = [None, "", " ", "Hello there, it's 12 o'clock!", "aaaaaaaaaaaaaaaaaaa", "  two  spaces \n\n\ttab\r\n", "größe ñandú 漢字 🙂🙂 é", "a<|endoftext|> b <|endoftext|>", "<|endoftext|>",
         "x" * 5000, "the " * 700, "\x00\x1c\x1f\x85  z", "I'll we've 'S 'tis ''s", "٣٤५ ½ Ⅷ ²", "<|endoftex|>", "abababababab" * 40]


def test_against_library(spark):
    from tokenizers import Tokenizer

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs)).collect()
    t = Tokenizer.from_file(bpe.vocabulary())
    assert len(got) == len(rows)
    for r in got:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want), r.text
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = bpe.op6_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        want = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
