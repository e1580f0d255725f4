"""Labelling with failing calls and stopped jobs; calls are counted by files."""

import os
import uuid
from collections import Counter

import pytest

from parley.streaming import labelling

SCHEMA = "turn_id int, role string, raw_text string, text string, raw int"


def labeler(folder, fails=(), stops=None):
    """Answers with the text's length; raises for some, and ends the whole job at the text `stops`."""

    def ask(role, text):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{role}:{text[:20]}")
        if text == stops:
            raise SystemExit("stopped")
        if text in fails:
            raise ValueError(f"no credit for {text}")
        return None if text == "silent" else f'{{"n": {len(text)}}}'

    return ask


def calls(folder):
    out = Counter(open(f"{folder}/{f}").read() for f in os.listdir(folder))
    for f in os.listdir(folder):
        os.remove(f"{folder}/{f}")
    return out


@pytest.fixture
def turns(spark):
    rows = [(i, "client" if i % 2 else "agent", f"text {i % 20}", "x", 1) for i in range(40)]
    rows += [(50, "client", "silent", "x", 1), (51, "client", None, "x", 1), (52, None, "text 1", "x", 1), (53, "client", "y" * 5000, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_failures(spark, turns, tmp_path):
    """Rows that raise stay unlabelled and alone are asked again, until they have failed three times."""
    made, folder = tmp_path / "calls", str(tmp_path / "labels")
    made.mkdir()
    fails = ("text 3", "text 4")
    df = turns.drop("text", "raw")
    got = labelling.label_durably(df, folder, labeler(made, fails), rows=7)
    first = sorted(r.turn_id for r in got.collect())
    assert first == [i for i in range(40) if i % 20 not in (3, 4)] + [53]
    assert {r.turn_id: r.raw for r in got.collect()}[53] == '{"n": 2000}'
    n = calls(made)
    assert len(n) == 22 and set(n.values()) == {1}
    kept = {r.text: (r.n_failed, r.last_error) for r in labelling.tries(spark, folder).where("raw is null").collect()}
    assert kept == {"text 3": (1, "ValueError: no credit for text 3"), "text 4": (1, "ValueError: no credit for text 4"), "silent": (1, "no answer")}
    again = labelling.label_durably(df, folder, labeler(made, fails[:1]), rows=7)
    assert sorted(r.turn_id for r in again.collect()) == sorted([*first, 4, 24])
    assert calls(made) == {"client:text 3": 1, "agent:text 4": 1, "client:silent": 1}
    labelling.label_durably(df, folder, labeler(made, fails[:1]), rows=7)
    assert calls(made) == {"client:text 3": 1, "client:silent": 1}
    labelling.label_durably(df, folder, labeler(made), rows=7)
    assert calls(made) == {}


def test_stopped(spark, turns, tmp_path):
    """What finished micro-batches answered is not asked again after a stop; the rest is."""
    made, folder = tmp_path / "calls", str(tmp_path / "labels")
    made.mkdir()
    df = turns.where("turn_id < 20").drop("text", "raw")
    with pytest.raises(Exception, match="."):
        labelling.label_durably(df, folder, labeler(made, stops="text 9"), at_once=1, rows=4)
    calls(made)
    done = {f"{r.role}:{r.text}" for r in labelling.tries(spark, folder).where("raw is not null").collect()}
    got = labelling.label_durably(df, folder, labeler(made), at_once=1, rows=4).collect()
    assert sorted(r.turn_id for r in got) == list(range(20))
    second = calls(made)
    assert not done & set(second) and done | set(second) == {f"{'client' if i % 2 else 'agent'}:text {i}" for i in range(20)} and set(second.values()) == {1}


def test_nothing_to_ask(spark, turns, tmp_path):
    out = labelling.label_durably(turns.drop("text", "raw").limit(0), str(tmp_path / "labels"), labeler(tmp_path))
    assert out.count() == 0 and set(out.columns) == {"turn_id", "role", "raw_text", "raw"}
