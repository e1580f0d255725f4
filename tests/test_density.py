"""Neighbour search and density clusters against loops over all pairs."""

import numpy as np
import pytest

from parley.operators import hierarchy, topics
from parley.operators.neighbours import blocks, count_near, distinct, nearest

SCHEMA = "id long, reduced array<double>"


def planted(seed, dims=3):
    """Two clusters of different density, a third beside the first, noise, and repeated points."""
    rng = np.random.default_rng(seed)
    centre = lambda x, n, s: rng.normal(0, s, (n, dims)) + np.eye(dims)[0] * x
    x = np.concatenate([centre(0, 110, 0.05), centre(3, 90, 0.6), centre(0.8, 40, 0.04), rng.uniform(-4, 6, (50, dims))])
    return np.concatenate([x, x[:4], x[:4], x[200:203]]).round(6)


def frame(spark, x, more=()):
    return spark.createDataFrame([(i * 3 + 1, r.tolist()) for i, r in enumerate(x)] + list(more), SCHEMA)


def between(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def parts(ids, near):
    left, out = np.array(ids), []
    while len(left):
        reached = left[:1]
        while len(more := left[near[np.ix_(reached, left)].any(axis=0) | np.isin(left, reached)]) > len(reached):
            reached = more
        out.append(reached.tolist())
        left = np.setdiff1d(left, reached)
    return out


def tree_weights(reach):
    """The distances at which components can change, by Prim's rule."""
    best, out, free = reach[0].copy(), set(), np.ones(len(reach), bool)
    free[0] = False
    while free.any():
        i = np.where(free, best, np.inf).argmin()
        out.add(best[i])
        free[i] = False
        best = np.minimum(best, reach[i])
    return out


def brute_hierarchy(x, min_size, k):
    """From the whole set downwards: every distance in turn, greatest first."""
    d = between(x)
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    weights = sorted(tree_weights(reach), reverse=True)

    def down(points, birth):
        """(stability with what is below, chosen clusters) of a cluster born at a density."""
        exits, size, now = 0.0, len(points), points
        for w in weights:
            density = 1 / max(w, 1e-9)
            big = [c for c in parts(now, reach < w) if len(c) >= min_size]
            if len(big) == 1 and len(big[0]) == len(now):
                continue
            if len(big) == 1:
                exits += (len(now) - len(big[0])) * density
                now = big[0]
                continue
            exits += len(now) * density
            below = [down(c, density) for c in big]
            best, chosen = sum(b for b, _ in below), [c for _, cs in below for c in cs]
            own = exits - size * birth
            return (own, [points]) if own >= best and birth > 0 else (best, chosen)
        exits += len(now) / 1e-9
        return exits - size * birth, [points] if birth > 0 else []

    return sorted(sorted(c) for c in down(list(range(len(x))), 0.0)[1])


def groups(rows):
    out = {}
    for r in rows:
        if r.cluster is not None:
            out.setdefault(r.cluster, []).append((r.id - 1) // 3)
    assert all(min(m) * 3 + 1 == c for c, m in out.items())
    return sorted(sorted(m) for m in out.values())


@pytest.mark.parametrize("seed,dims,block,at_once", [(1, 3, 16, 1_000_000), (2, 2, 512, 120)])
def test_hierarchy(spark, seed, dims, block, at_once):
    x = planted(seed, dims)
    got = hierarchy.hierarchical_clusters(frame(spark, x, [(10_000, None), (10_003, [1.0, None, 2.0][:dims])]), 5, 5, block, at_once).collect()
    want = brute_hierarchy(x, 5, 5)
    assert len(got) == len(x) + 2 and groups(got) == want
    assert len(want) >= 3 and sum(map(len, want)) < len(x)


def test_hierarchy_ties(spark):
    """A grid, where nearly all distances are equal, with two lines away from it."""
    x = np.array([[i, j] for i in range(6) for j in range(6)] + [[20 + i, 0] for i in range(7)] + [[20 + i, 9] for i in range(7)], float)
    assert groups(hierarchy.hierarchical_clusters(frame(spark, x), 5, 3, 8).collect()) == brute_hierarchy(x, 5, 3)


def test_hierarchy_edges(spark):
    assert hierarchy.hierarchical_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(1, [0.0, 1.0]), (4, [0.0, 1.0]), (7, [5.0, 5.0])]
    assert sorted(map(tuple, hierarchy.hierarchical_clusters(spark.createDataFrame(few, SCHEMA)).collect())) == [(1, None), (4, None), (7, None)]
    same = [(i, [float(i % 2), 0.0]) for i in range(12)]
    assert groups_of(hierarchy.hierarchical_clusters(spark.createDataFrame(same, SCHEMA)).collect()) == [[0, 2, 4, 6, 8, 10], [1, 3, 5, 7, 9, 11]]


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, []).append(r.id)
    return sorted(sorted(m) for m in out.values())


def test_nearest(spark):
    x = planted(3)
    one = distinct(frame(spark, x)).cache()
    b = blocks(one, 16)
    at = {r.id: np.array(r.v) for r in one.collect()}
    assert int(b.size.sum()) == len(at) and len(b.block) > 5
    ids = np.array(sorted(at))
    d = between(np.stack([at[i] for i in ids]))
    for r in nearest(b, 4).collect():
        row = d[np.searchsorted(ids, r.id)].copy()
        row[np.searchsorted(ids, r.id)] = np.inf
        assert [n.id for n in r.near] == ids[np.lexsort((ids, row))[:4]].tolist()
    weight = {r.id: r.weight for r in one.collect()}
    w = np.array([weight[i] for i in ids])
    assert {r.id: r.n for r in count_near(one, b, 0.3).collect()} == dict(zip(ids.tolist(), ((d <= 0.3) @ w).tolist(), strict=True))


def test_few_are_asked(spark):
    """On planted clusters a few percent of all pairs are compared."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.02, (100, 20)) + rng.normal(0, 1, 20) for _ in range(40)])
    one = distinct(frame(spark, x))
    b = blocks(one, 64)
    asked = sum(int(((least <= 0.35) * b.size).sum()) for _, least in b.reach(x))
    assert asked < 0.06 * len(x) ** 2


def test_density_clusters(spark):
    x = planted(4)
    eps, least = 0.25, 5
    d = between(x)
    dense = np.flatnonzero((d <= eps).sum(axis=1) >= least)
    want = {}
    for p in parts(dense.tolist(), d <= eps):
        want |= dict.fromkeys(p, min(p))
    for i in range(len(x)):
        near = [(d[i, j], j) for j in dense if d[i, j] <= eps]
        if i not in want and near:
            want[i] = want[min(near)[1]]
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    got = {(r.id - 1) // 3: r.cluster for r in topics.density_clusters(frame(spark, x), eps, least).collect()}
    assert got == {i: want[i] * 3 + 1 if i in want and sizes[want[i]] >= 5 else None for i in range(len(x))}
