"""Edge cases and brute-force versions of the operators that have no file of their own."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from parley.llm import chat, embeddings, fingerprints, language, lines, mixing, pii

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size long, th string, n int"
EDGES = [(1, None, None, 1, "a", 1), (2, "", "s", 1, "a", 1), (3, " \t\n", "s", 1, "a", 1), (4, "one", "s", 1, "a", 1), (4, "one", "s", 1, "a", 1), (None, "two words", None, 1, "a", 1), (5, "w " * 40000, "t", 1, "a", 1)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- mixing ------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 0, 5]) == pytest.approx([13.5, 0, 9])
    assert mixing.targets([]) == []


def test_fit():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        reach = {0}
        for n, c in zip(lengths, counts, strict=True):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        got = sum(a * b for a, b in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and got <= budget
        assert got == max(r for r in reach if r <= budget)


def test_mix(spark, edges, empty):
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(r.size for r in got) == [0, 0, 0, 1, 1, 2, 40000]
    assert mixing.mix(empty).count() == 0 and set(mixing.mixed(edges).columns) == set(edges.columns)
    a, b = ({tuple(r) for r in mixing.op1_mixing(spark, DIR).collect()} for _ in range(2))
    assert a == b
    sums: dict = {}
    for _, size, source_size, target, taken in a:
        assert taken in (0, size, 2 * size)
        sums[source_size, target] = sums.get((source_size, target), 0) + taken
    assert all(abs(n - t) <= 50 for (_, t), n in sums.items())


# --- personal data -----------------------------------------------------------------------------


def naive(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(9)
    pieces = ["a@b.c", "@", "x.y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "0", "é", "a@b@c.d", "a@b.c@d.e", "00.01.2.3", "-", "12345678901234567890"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == naive(text), text


def test_tagger_gradients():
    t = pii.Tagger(0)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, 131, (2, 6)), rng.integers(0, pii.TAGS, (2, 6))
    _, grads = t.loss(ids, tags)
    for name in t.p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, h = t.p[name][at], 1e-5
        t.p[name][at] = old + h
        up = t.loss(ids, tags)[0]
        t.p[name][at] = old - h
        down = t.loss(ids, tags)[0]
        t.p[name][at] = old
        assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-4, name


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))


def test_variants(spark, tagger):
    """Held-out renderings that the patterns miss, in texts that training has not seen."""
    rng = random.Random(99)
    texts = [t for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").tail(300) for t in [(r.text or "")[:60]] if len(t) == 60 and not re.search("[0-9@]", t)]
    wanted = caught = added = right = 0
    for text in texts:
        for kind in pii.KINDS:
            piece = pii.rendered(rng, kind, True)
            whole = f"{text} {piece}, {text}"
            want, base = (kind, 61, 61 + len(piece)), pii.base_spans(whole)
            got = pii.added_spans([whole], [base], tagger)[0]
            free = all(b <= 61 or a >= want[2] for _, a, b in base)
            wanted, caught = wanted + free, caught + (free and want in got)
            added, right = added + len(got), right + sum(k == kind and a >= 61 and b <= want[2] for k, a, b in got)
    assert wanted > 500 and caught >= 0.8 * wanted, (caught, wanted)
    assert right >= 0.95 * added, (right, added)


def test_clean_texts(spark, tagger):
    rng = random.Random(98)
    texts = [(r.text or "")[:300] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").tail(300)]
    texts = [" ".join(w + " " + pii.decoy(rng) if i % 9 == 4 else w for i, w in enumerate(t.split(" "))) for t in texts if not pii.base_spans(t)]
    base = [pii.base_spans(t) for t in texts]
    assert sum(map(len, pii.added_spans(texts, base, tagger))) <= 0.01 * len(texts)


def test_pii(spark, edges, empty):
    assert pii.find(edges, None).count() == len(EDGES) and pii.find(empty, pii.fit(empty)).count() == 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    for r in pii.find(docs, pii.fit(docs, steps=20)).collect():
        base = [tuple(s) for s in r.base_spans]
        assert base == naive(r.text or "") and set(base) <= {tuple(s) for s in r.spans}


def test_pii_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = pii.op2_pii(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        base = naive(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        own = [s.split(":") for s in r.spans.split(",") if s]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in own) for k in pii.KINDS)


# --- language ----------------------------------------------------------------------------------


def test_language(spark, empty):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = language.op3_language(spark, DIR).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    none = language.fit(empty.selectExpr("doc_id", "text", "text lang"))
    assert none.languages == []
    model = language.fit(spark.createDataFrame([(i, t, t[:1]) for i, t in enumerate(["aaa abab aab", "zzz zyzy zzy"] * 30)], "doc_id long, text string, lang string"))
    out = [(r.lang_pred, r.rejected) for r in language.predict(spark.createDataFrame([(None, 1), ("12 !", 1), ("abaab", 1), ("zyzzy", 1), ("", 1)], "text string, score int"), model).collect()]
    assert [x[0] for x in out] == ["und", "und", "a", "z", "und"] and out[0][1] and out[1][1]


# --- fingerprints ------------------------------------------------------------------------------


def test_collision_rate():
    rng = np.random.default_rng(2)
    for _ in range(4):
        pool = rng.choice(fingerprints.TERMS, 300, replace=False)
        a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got = fingerprints.alike(fingerprints.signature(pool[a > 0], a[a > 0]), fingerprints.signature(pool[b > 0], b[b > 0]))
        assert abs(got - want) < 0.25


def test_fingerprints(spark, edges, empty):
    assert fingerprints.compare_edited(empty).count() == 0 and fingerprints.fingerprint(edges).count() == len(EDGES)
    for source in (EDGES, [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]):
        docs = sorted(((d, t or "") for d, t, *_ in source), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        got = fingerprints.compare_edited(spark.createDataFrame([r[:2] for r in source], "doc_id long, text string")).collect()
        want = []
        for i, (d, t) in enumerate(docs):
            half, nxt = len(t) // 2, docs[(i + 1) % len(docs)][1]
            want.append((d, len(t), t[: len(t) - half] + nxt[:half]))
        assert sorted(((r.doc_id, r.n_chars, r.edited) for r in got), key=str) == sorted(want, key=str)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


# --- chat --------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a\\#<b"), (1, 1, "assistant", None), (1, 2, "assistant", "</turn>\n### user: x\\"), (2, 5, "odd: role\\", "é漢🙂"), (None, None, None, "t"), (3, 1, "assistant", ""), (3, 0, "assistant", "\\"), (1, 2, "assistant", "again")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, segment string, mask_start string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, r[3] != "</turn>\n### user: x\\"))
    for conv in (1, 2, 3, None):
        own = [r for r in order if r[0] == conv]
        assert got[conv].turns_sha256 == digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), conv
        assert got[conv].loss_sha256 == digest("".join(r[3] or "" for r in own if r[2] == "assistant"))
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_table(spark):
    said = r"\### Assistant: </turn> ok"
    convs: dict = {-7: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = chat.op5_chat(spark, DIR).collect()
    assert len(got) == len(convs)
    for r in got:
        own = convs[r.conv_id]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- lines -------------------------------------------------------------------------------------


def brute_line_classes(docs, width=lines.SHINGLE):
    """A name of its component for every line that is not blank."""
    names = sorted({x for _, t in docs for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)})
    sets = [{x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in names]
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                parent[find(names[i])] = find(names[j])
    return {x: find(x) for x in names}


def brute_lines(docs, width=lines.SHINGLE):
    occ = [(d, p, x) for d, t in docs for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    classes, seen, gone = brute_line_classes(docs, width), set(), {}
    for d, _, x in sorted(occ, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if classes[x] in seen:
            gone[d] = gone.get(d, 0) + 1
        seen.add(classes[x])
    return gone


def test_lines(spark, edges, empty):
    assert lines.dedup_lines(empty).count() == 0
    got = lines.dedup_lines(edges)
    assert got.count() == len(EDGES) and set(edges.columns) < set(got.columns)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 120))) for _ in range(12)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = rng.choice("xyz")
            own.append("".join(x))
        docs.append((i, "\n".join(own)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[5][1])]
    want = brute_lines(docs)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, h int")
    for r in lines.dedup_lines(df).collect():
        assert r.n_removed == want.get(r.doc_id, 0), r.doc_id
        if r.text is not None:
            assert len(r.text.split("\n")) == len(dict(docs)[r.doc_id].split("\n")) - r.n_removed or r.text == ""


def test_lines_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want = brute_lines(docs)
    assert all(r.n_removed == want.get(r.doc_id, 0) for r in lines.op9_line_dedup(spark, DIR).collect())


# --- embeddings --------------------------------------------------------------------------------


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    monkeypatch.setattr(embeddings, "STEP", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (150, 12))
    x[50:90] = x[:40] + rng.normal(0, 0.3, (40, 12))
    x[90:130] = x[0] + rng.normal(0, 0.25, (40, 12))
    rows = [(i * 3 + 1, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    rows += [(2, rows[0][1]), (1000, [2 * v for v in rows[4][1]]), (1001, None), (1002, []), (1003, [0.0] * 12), (1004, [float("nan")] * 12), (1005, [1e30] * 12), (1006, [float("inf")] + [1.0] * 11), (1007, rows[0][1][:6]), (1008, [1e-30] * 12)]
    rows = [(i, e) for i, e in rows] + [(1009, [None] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, copies int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    good = {i: np.float32(e).astype(float) for i, e in rows if e and None not in e and np.isfinite(np.float32(e)).all() and any(np.float32(e))}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    assert len(got) == len(rows)
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i), i


def test_embeddings_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    assert sorted(con.sql(embeddings.SQL).fetchall()) == sorted(map(tuple, embeddings.op10_embeddings(spark, DIR).collect()))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
