"""Texts and tables that are larger or odder than those of the smallest scale."""

import math
from pathlib import Path

import duckdb
import numpy as np
from pyarrow import parquet

from parley.operators import hierarchy, layout, topics
from parley.operators.neighbours import blocks, count_near, distances, distinct, nearest
from parley.plans.queries import ORACLES, QUERIES
from parley.sources.scratch import folder

from .test_density import brute_hierarchy, frame, groups, planted

SCHEMA = "id long, reduced array<double>"


def points(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA)


def written(spark):
    """Rows in the folder that steps are written to."""
    return sum(parquet.read_metadata(f).num_rows for f in Path(folder(spark).removeprefix("file:")).parent.rglob("*.parquet") if f.is_file())


def tables(spark):
    """Rows of the tables that are left there, by folder."""
    rows = {}
    for f in Path(folder(spark).removeprefix("file:")).parent.rglob("*.parquet"):
        if f.is_file():
            rows[f.parent] = rows.get(f.parent, 0) + parquet.read_metadata(f).num_rows
    return rows


def test_low_quality_of_long_and_odd_texts(spark, tmp_path):
    """Long ones, and such as begin with what JSON escapes, or are empty."""
    texts = ["a" * 200_000, '"quoted" and \\ more' * 20_000, "", "\\", '"', "é", "\U0001f600 and more", "ab", 'x","content":"y']
    rows = [(2 * i + odd, 0, "user", t) for i, t in enumerate(texts) for odd in (0, 1)]
    rows += [(r[0], 1, "assistant", "well") for r in rows] + [(100, 0, "user", "a"), (100, 1, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = {r.conversation_id: r.low_quality for r in QUERIES["low_quality"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(ORACLES["low_quality"]).fetchall()) and len(got) == len(texts) * 2 + 1


def test_neighbours_without_structure(spark):
    """Where no block can be left out, points are not written once for each of the blocks."""
    x = np.random.default_rng(5).normal(0, 1, (600, 24))
    d = distances(x, x)
    eps, begun = float(np.median(d)), written(spark)
    one = distinct(points(spark, x)).cache()
    b = blocks(one, 6)
    assert len(b.block) > 100
    assert {r.id: r.n for r in count_near(one, b, eps).collect()} == dict(enumerate((d <= eps).sum(axis=1).tolist()))
    np.fill_diagonal(d, np.inf)
    near = {r.id: [(n.id, n.d) for n in r.near] for r in nearest(b, 7).collect()}
    assert near == {i: [(int(j), row[j]) for j in np.argsort(row, kind="stable")[:7]] for i, row in enumerate(d)}
    assert written(spark) - begun < 4 * len(x)


def test_neighbours_far_from_the_origin(spark):
    """Distances that products of matrices cannot tell, and such as have no finite square."""
    rng = np.random.default_rng(6)
    x = np.concatenate([1e8 + rng.integers(0, 40, (200, 2)) / 2, rng.normal(0, 1, (100, 2)), [[1e200, 0.0], [-1e200, 1.0]]])
    x = np.unique(x, axis=0)
    with np.errstate(over="ignore"):
        d = distances(x, x)
    one = distinct(points(spark, x)).cache()
    b = blocks(one, 16)
    assert {r.id: r.n for r in count_near(one, b, 1.5).collect()} == dict(enumerate((d <= 1.5).sum(axis=1).tolist()))
    near = {r.id: [n.id for n in r.near] for r in nearest(b, 4).collect()}
    np.fill_diagonal(d, np.inf)
    for i, row in enumerate(d):
        if np.isfinite(row).sum() >= 4:
            assert near[i] == np.argsort(row, kind="stable")[:4].tolist()


def test_core_distance_without_structure(spark):
    """By all others, equal points as often as they occur, without writing a point once for each block."""
    x = np.random.default_rng(7).normal(0, 1, (3000, 16)).round(6)
    x[-30:] = x[:30]
    begun = written(spark)
    got = {r.id: r.core for r in topics.core_distance(points(spark, x)).collect()}
    want = np.sort(distances(x, x), axis=1)[:, topics.MIN_CLUSTER]
    assert len(got) == len(x) and all(got[i] == w for i, w in enumerate(want))
    assert written(spark) - begun < 4 * len(x)
    assert {r.core for r in topics.core_distance(points(spark, x[:4])).collect()} == {math.inf}


def test_density_clusters_of_several_tiles(spark):
    """Long thin clusters that many blocks share, points beside them and noise; a point is not written for each block."""
    rng = np.random.default_rng(8)
    line = lambda n, y: np.stack([rng.uniform(0, 40, n), rng.normal(y, 0.05, n), rng.normal(0, 0.05, n)], axis=1)
    x = np.concatenate([line(1100, 0), line(900, 1.5), rng.uniform(-5, 45, (400, 3)), rng.uniform(0, 40, (100, 1)) + [0, 0.3, 0]]).round(6)
    x = np.concatenate([x, x[:20], x[2000:2004]])
    eps, least, begun = 0.3, 5, written(spark)
    d = distances(x, x)
    dense = (d <= eps).sum(axis=1) >= least
    label = np.where(dense, np.arange(len(x)), len(x))
    while (now := np.where((d <= eps) & dense, label, len(x)).min(axis=1))[dense].tolist() != label[dense].tolist():
        label = np.where(dense, now, len(x))
    near = np.where((d <= eps) & dense, d, np.inf)
    label = np.where(dense, label, np.where(np.isfinite(near).any(axis=1), label[near.argmin(axis=1)], len(x)))
    sizes = np.bincount(label)
    want = {i: int(c) if c < len(x) and sizes[c] >= 5 else None for i, c in enumerate(label)}
    got = {r.id: r.cluster for r in topics.density_clusters(points(spark, x), eps, least).collect()}
    assert got == want and len(set(want.values())) >= 3 and None in want.values()
    assert written(spark) - begun < 8 * len(x)


def test_hierarchical_clusters_without_structure(spark):
    """In rounds over all pairs of tiles a point is not written for each block that it may have an edge to."""
    x, before = planted(9, 8), tables(spark)
    got = hierarchy.hierarchical_clusters(frame(spark, x), 5, 5, 6, 100).collect()
    assert groups(got) == brute_hierarchy(x, 5, 5)
    assert max(n for t, n in tables(spark).items() if t not in before) <= 6 * len(x)


def test_descent_in_parts(spark):
    """Neighbours that meet a part at a time give the same graph, and nothing is left of the rounds but the last."""
    one = distinct(points(spark, np.random.default_rng(10).normal(0, 1, (300, 6)))).cache()
    begun = tables(spark)
    whole, parts = (layout._descend(one, 5, 32, 4, 42, meet) for meet in (300, 60))
    rows = lambda g: sorted((r.id, r.other, r.d) for r in g.collect())
    assert rows(whole) == rows(parts)
    assert len([t for t in tables(spark) if t not in begun]) == 2


def test_texts_of_the_corpus_are_stored_once(spark):
    begun = tables(spark)
    QUERIES["turn_coords"](spark, "/root/testdata/sf0.001")
    left = [t for t in tables(spark) if t not in begun]
    named = [t for t in left if "turn_id" in parquet.read_schema(next(t.glob("*.parquet"))).names]
    assert len(named) == 1 and "raw_text" not in parquet.read_schema(next(named[0].glob("*.parquet"))).names
