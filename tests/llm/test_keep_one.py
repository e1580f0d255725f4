from parley.llm import ngram_join


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (7, a + " more"), (7, c), (9, b), (9, b), (9, b + " more"), (None, c + " more"), (None, d), (None, d), (4, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()), key=str)
    near_b = [x for x in got if x[0] == 9]
    assert len(near_b) == 1 and near_b[0][1] in (b, b + " more")
    assert [x for x in got if x[0] != 9] == sorted([(3, a), (7, c), (None, d), (4, "")], key=str)
