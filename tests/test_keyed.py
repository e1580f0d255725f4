"""The keyed table: merges, resets and replacements against a dictionary; failures between steps; concurrent writers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from parley.sources import keyed

SCHEMA = "id string, batch int, kind string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, path, version=None):
    return sorted(map(tuple, keyed.read(spark, path, version).collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


def test_merges_like_a_dictionary(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(4), {}
    for step in range(4):
        rows = [(rng.choice([*map(str, range(40)), None, ""]), rng.randrange(3), rng.choice("abc")) for _ in range(30)] * 2
        best = {}
        for r in rows:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda r: r[1:])
        want |= best
        assert keyed.merge(path, frame(spark, rows), "id", "batch", buckets=8) == step + 1
        assert held(spark, path) == sorted(want.values(), key=str)
    before = held(spark, path, 3)
    gone = {k for k, r in want.items() if r[2] == "a"}
    keyed.merge(path, frame(spark, [("new", 1, "a")]), "id", instead_of=F.col("kind") == "a")
    want = {k: r for k, r in want.items() if k not in gone} | {"new": ("new", 1, "a")}
    assert held(spark, path) == sorted(want.values(), key=str) and held(spark, path, 3) == before
    keyed.merge(path, frame(spark, [("x", 1, None)]), "id", reset=True)
    assert held(spark, path) == [("x", 1, None)]
    assert keyed.merge(path, frame(spark, []), "id") == 6


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.merge(path, frame(spark, [(str(i), 1, "a") for i in range(400)]), "id", buckets=16)
    before = files(path)
    keyed.merge(path, frame(spark, [("7", 2, "b")]), "id")
    after = files(path)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    assert dict((r.id, r.kind) for r in keyed.read(spark, path).collect()) == {str(i): "b" if i == 7 else "a" for i in range(400)}
    assert keyed.clean(spark, path, keep=1) == 0  # the first folder still holds the other buckets
    keyed.merge(path, frame(spark, [("7", 3, "c")]), "id")
    assert keyed.clean(spark, path, keep=1) == 1 and keyed.read(spark, path).count() == 400


def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.merge(path, frame(spark, [("1", 1, "a"), ("2", 1, "a")]), "id")
    with monkeypatch.context() as m:
        m.setattr(keyed, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            keyed.merge(path, frame(spark, [("2", 2, "b"), ("3", 2, "b")]), "id")
    assert held(spark, path) == [("1", 1, "a"), ("2", 1, "a")]
    keyed.merge(path, frame(spark, [("2", 2, "b"), ("3", 2, "b")]), "id")
    assert held(spark, path) == [("1", 1, "a"), ("2", 2, "b"), ("3", 2, "b")]
    assert keyed.clean(spark, path) == 1 and held(spark, path) == [("1", 1, "a"), ("2", 2, "b"), ("3", 2, "b")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two that start from one version the second to publish fails, and its rows are not half there."""
    path, publish = str(tmp_path / "t"), keyed._publish
    keyed.merge(path, frame(spark, [("1", 1, "a")]), "id")

    def late(*args):
        monkeypatch.setattr(keyed, "_publish", publish)
        keyed.merge(path, frame(spark, [("1", 2, "first")]), "id")
        return publish(*args)

    monkeypatch.setattr(keyed, "_publish", late)
    with pytest.raises(Exception, match="(?i)exist"):
        keyed.merge(path, frame(spark, [("1", 3, "second")]), "id")
    assert held(spark, path) == [("1", 2, "first")]


def test_edges(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        keyed.read(spark, path)
    assert keyed.merge(path, frame(spark, []), "id") == 0
    keyed.merge(path, frame(spark, [(None, 1, "a"), (None, 2, "b"), ("", 1, None)]), "id", "batch")
    assert held(spark, path) == sorted([(None, 2, "b"), ("", 1, None)], key=str)
    with pytest.raises(ValueError):
        keyed.merge(path, spark.createDataFrame([("1", 1)], "id string, batch int"), "id")
    with pytest.raises(ValueError):
        keyed.merge(path, frame(spark, []).withColumn("_bucket", F.lit(1)), "id")
    keyed.merge(path, frame(spark, []), "id", instead_of=F.col("kind").isNull())
    assert held(spark, path) == [(None, 2, "b")]
    keyed.merge(path, frame(spark, []), "id", reset=True)
    assert held(spark, path) == []
