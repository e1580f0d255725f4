"""Hierarchical density clusters: no radius is asked for.

The core distance of a point is that of its min_samples-th neighbour, the reach of two points the greatest of their
distance and their core distances. A minimum spanning tree over reaches is grown by Boruvka rounds: each component
takes a bound from known neighbours, and its points ask only the blocks that may beat it.
From small reaches to large ones components then merge; those of min_size points are clusters, and of each branch
the clusters of greatest stability are chosen. Clusters within equal reach merge at once, so that results do not
depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, stored
from .neighbours import BLOCK, PACKED, SHARE, Blocks, Tile, apart, blocks, compared, distinct, meeting, nearest

#: Merges that one task works on: the tree is cut by reach so that no connected part of a cut has more.
MERGES = 200_000
#: Reaches below this count as this, so that equal points have a finite density.
LEAST_REACH = 1e-9

_EDGE = "struct<w:double,a:bigint,b:bigint>"
_OUT = "kind string, comp long, size long, cluster string, parent string, chosen boolean, exits double, best double, members array<long>"


def core_distances(b: Blocks, min_samples: int) -> DataFrame:
    """nearest() with `core`, the distance within which min_samples other points are; infinite where there are not so many."""
    within = F.aggregate(
        "near", F.struct(F.col("weight").alias("n"), F.when(F.col("weight") > min_samples, 0.0).alias("core")),
        lambda acc, x: F.struct((acc["n"] + x["weight"]).alias("n"), F.coalesce(acc["core"], F.when(acc["n"] + x["weight"] > min_samples, x["d"])).alias("core")),
    )
    near = F.coalesce("near", F.array().cast("array<struct<d:double,id:bigint,weight:bigint>>"))
    return nearest(b, min_samples).withColumn("near", near).withColumn("core", F.coalesce(within["core"], F.lit(float("inf"))))


def _least(edges: DataFrame) -> DataFrame:
    """The least edge of each component."""
    return edges.groupBy("comp").agg(F.min("edge").alias("edge"))


def _labelled(b: Blocks, points: DataFrame) -> DataFrame:
    """b.tiles with `core`, from points (id, block, core)."""

    def put(cores: pa.Table, tile: pa.Table) -> pa.Table:
        x = Tile(tile.combine_chunks().to_batches()[0], 0)
        return tile.append_column("core", pa.array([_in_order(x.ids, cores.column("id"), cores.column("core")).tobytes()], pa.binary()))

    held = points.select(F.shiftright("block", 24).cast("int").alias("tile"), "id", "core")
    return held.groupBy("tile").cogroup(b.tiles.groupBy("tile")).applyInArrow(put, f"{PACKED}, core binary")


def _in_order(ids: np.ndarray, own: pa.ChunkedArray, values: pa.ChunkedArray) -> np.ndarray:
    """values, one for each of `own`, in the order of ids."""
    own = own.to_numpy()
    order = np.argsort(own)
    return values.to_numpy()[order[np.searchsorted(own, ids, sorter=order)]]


def _least_rows(comp: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The least (w, a, b) of each comp."""
    order = np.lexsort((b, a, w, comp))
    order = order[np.flatnonzero(np.concatenate(([True], np.diff(comp[order]) != 0)))] if len(order) else order
    return comp[order], w[order], a[order], b[order]


def _outward(x: Tile, others: Iterator[Tile]) -> pa.RecordBatch:
    """Of each component in a tile the edge of least reach, less than what is known, to another component in others."""
    comp, core, known = x.packed("comp"), x.packed("core", np.float64), x.packed("bound", np.float64).copy()
    found = [np.empty(0, k) for k in (np.int64, np.float64, np.int64, np.int64)]
    # a point whose own core is not below the bound of its component has no better edge
    r = np.where(core < known, known, -np.inf)
    for y in others:
        theirs, their_core = y.packed("comp"), y.packed("core", np.float64)
        for rows, there, d, error in compared(x, y, r):
            bound = known[rows]
            may = ~(d > (bound**2 * (1 + SHARE) + error)[:, None]) & (comp[rows][:, None] != theirs[there]) & (their_core[there] < bound[:, None])
            q, m = np.nonzero(may)
            at, m = rows[q], m + there.start
            w = np.maximum(np.maximum(apart(x.v[at], y.v[m]), core[at]), their_core[m])
            better = w < known[at]
            if better.any():
                at, m = at[better], m[better]
                found = list(_least_rows(*(np.concatenate(c) for c in zip(found, (comp[at], w[better], x.ids[at], y.ids[m]), strict=True))))
                place = np.searchsorted(found[0], comp)
                place[place == len(found[0])] = 0
                known = np.where(found[0][place] == comp, np.minimum(known, found[1][place]), known)
                r[:] = np.where(core < known, known, -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["comp", "w", "a", "b"])


def spanning_tree(b: Blocks, points: DataFrame) -> DataFrame:
    """(a, b, w) from points (id, block, v, core, near): edges of a minimum spanning tree by reach, and possibly
    others of equal reach between the same components."""
    pairs = points.select(F.col("id").alias("a"), F.col("core").alias("ca"), F.explode("near").alias("n")).select("a", "ca", F.col("n.id").alias("b"), F.col("n.d").alias("d"))
    known = stored(pairs.join(points.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w")))
    tiles = stored(_labelled(b, points))
    none = points.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("w")).limit(0)
    edges, labels = None, stored(points.select("id", F.shiftright("block", 24).cast("int").alias("tile"), F.col("id").alias("comp")))
    while labels.agg(F.min("comp") != F.max("comp")).first()[0]:
        label = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
        cross = stored(known.select("a", "b", "w").join(label("a"), "a").join(label("b"), "b").where("ca <> cb"))
        edge = F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        bound = stored(_least(cross.select(F.explode(F.array("ca", "cb")).alias("comp"), edge.alias("edge")).where("edge.w < double('infinity')")))
        now = labels.join(bound.select("comp", F.col("edge.w").alias("w")), "comp", "left").select("tile", "id", "comp", F.coalesce("w", F.lit(float("inf"))).alias("bound"))

        def put(own: pa.Table, tile: pa.Table) -> pa.Table:
            x = Tile(tile.combine_chunks().to_batches()[0], 0)
            for c in ("comp", "bound"):
                tile = tile.append_column(c, pa.array([_in_order(x.ids, own.column("id"), own.column(c)).tobytes()], pa.binary()))
            return tile

        placed = stored(now.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(put, f"{PACKED}, core binary, comp binary, bound binary"))
        asked = stored(meeting(b, placed, placed, _outward, "comp long, w double, a long, b long"))
        ordered = asked.select("comp", F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("edge"))
        found = stored(_least(bound.unionByName(ordered)).select("edge.*").distinct())
        drop(placed, asked, bound)
        drop(known)
        known = cross
        if found.isEmpty():
            break  # what is left is infinitely far
        edges = found if edges is None else edges.unionByName(found)
        links = found.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = _reachable(links)
        labels, old = stored(labels.join(merged, F.col("comp") == F.col("_id"), "left").select("id", "tile", F.coalesce("label", "comp").alias("comp"))), labels
        drop(old)
    return none if edges is None else edges.select("a", "b", "w")


def _reachable(links: DataFrame) -> DataFrame:
    from .topics import smallest_reachable

    links = stored(links)
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return smallest_reachable(nodes, links).select(F.col("id").alias("_id"), "label")


def _merge(min_size: int):
    """Merges the components of one part of a cut, given by their rows in _OUT, along its edges."""

    def work(key: tuple, edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        up = {}
        state = {r.comp: [r.size, r.cluster, r.exits, r.best, list(r.members) if r.members is not None else []] for r in states.itertuples()}
        rows: list[tuple] = []

        def root(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        edges = edges.sort_values("w", kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(edges["w"].to_numpy()) != 0)))
        for i, j in zip(starts, [*starts[1:], len(edges)], strict=True):
            touched = {}
            for a, b in zip(edges["ca"].iloc[i:j].tolist(), edges["cb"].iloc[i:j].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[b] = a
                    touched[a] = touched.pop(a, [a]) + touched.pop(b, [b])
            density = 1 / max(edges["w"].iloc[i], LEAST_REACH)
            for new, olds in touched.items():
                old = [state.pop(x) for x in olds]
                size = sum(s[0] for s in old)
                big, loose = [s for s in old if s[1] is not None], [p for s in old if s[1] is None for p in s[4]]
                outside = sum(s[0] for s in old if s[1] is None)
                if not big and size < min_size:
                    state[new] = [size, None, 0.0, 0.0, loose]
                    continue
                if len(big) == 1:
                    _, name, exits, best, _ = big[0]
                    state[new] = [size, name, exits + outside * density, best, []]
                else:
                    least = min(loose + [int(s[1].split(":")[0]) for s in big])
                    name, best = f"{least}:{size}", 0.0
                    for n, child, exits, below, _ in sorted(big, key=lambda s: s[1]):
                        stability = exits - n * density
                        chosen = stability >= below
                        best += max(stability, below)
                        rows.append(("cluster", None, n, child, name, chosen, stability, below, None))
                    state[new] = [size, name, size * density, best, []]
                rows += [("point", p, None, name, None, None, None, None, None) for p in loose]
        (size, name, exits, best, members), = state.values()
        rows.append(("state", key[0], size, name, None, None, exits, best, members))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"comp": "Int64", "size": "Int64", "chosen": "boolean"})

    return work


def _cut(edges: DataFrame, labels: DataFrame, left: int, merges: int):
    """The edges of least reach, (ca, cb, w), and the part (comp, part) of each component that they touch: half of
    them again and again until no part has more than `merges`. Edges of one reach stay together."""
    most = None
    while True:
        low = edges if most is None else edges.where(F.col("w") <= most)
        label = lambda x: labels.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
        low = stored(low.join(label("a"), "a").join(label("b"), "b").select("ca", "cb", "w"))
        parts = stored(_reachable(low.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("_id").alias("comp"), F.col("label").alias("part")))
        if left <= merges:
            return most, low, parts
        largest = low.join(parts, F.col("ca") == F.col("comp")).groupBy("part").count().agg(F.max("count").alias("n")).first().n
        if largest <= merges:
            return most, low, parts
        half = low.agg(F.percentile("w", F.lit(0.5)).alias("w"), F.min("w").alias("least")).first()
        half = float(low.where(F.col("w") <= max(half.w, half.least)).agg(F.max("w")).first()[0])
        if half == most or half == low.agg(F.max("w")).first()[0]:
            return most, low, parts  # one reach
        most, left = half, low.where(F.col("w") <= half).count()


def merges(points: DataFrame, edges: DataFrame, min_size: int, at_once: int = MERGES) -> tuple[DataFrame, DataFrame]:
    """(cluster, parent, chosen, stability) of all clusters but the root, and (id, cluster), the first cluster that each
    point is in, from points (id, weight) and the edges of a spanning tree. chosen: more stable than all below."""
    own = F.when(F.col("weight") >= min_size, F.concat("id", F.lit(":"), "weight"))
    first = points.select("id", "weight", own.alias("cluster"))
    states = first.select(
        F.lit("state").alias("kind"), F.col("id").alias("comp"), F.col("weight").alias("size"), "cluster", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("boolean").alias("chosen"),
        F.when(F.col("cluster").isNotNull(), F.col("weight") / LEAST_REACH).otherwise(0.0).alias("exits"), F.lit(0.0).alias("best"), F.when(F.col("cluster").isNull(), F.array("id")).otherwise(F.array().cast("array<long>")).alias("members"),
    )
    done = stored(first.where("cluster is not null").select(F.lit("point").alias("kind"), F.col("id").alias("comp"), "cluster", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("boolean").alias("chosen"), F.lit(None).cast("double").alias("exits")))
    states, labels, edges = stored(states), points.select("id", F.col("id").alias("comp")), stored(edges)
    while (left := edges.count()) > 0:
        most, low, parts = _cut(edges, labels, left, at_once)
        part = parts.select(F.col("comp").alias("ca"), "part")
        held = states.join(parts.select("comp", F.col("part").alias("home")), "comp")
        step = stored(low.join(part, "ca").groupBy("part").cogroup(held.groupBy("home")).applyInPandas(_merge(min_size), _OUT))
        states = stored(states.join(parts, "comp", "left_anti").unionByName(step.where("kind = 'state'")))
        done = done.unionByName(step.where("kind <> 'state'").select("kind", "comp", "cluster", "parent", "chosen", "exits"))
        labels = stored(labels.join(parts, "comp", "left").select("id", F.coalesce("part", "comp").alias("comp")))
        edges = edges.limit(0) if most is None else stored(edges.where(F.col("w") > most))
    clusters = done.where("kind = 'cluster'").select("cluster", "parent", "chosen", F.col("exits").alias("stability"))
    return clusters, done.where("kind = 'point'").select(F.col("comp").alias("id"), "cluster")


def hierarchical_clusters(points: DataFrame, min_size: int = 5, min_samples: int | None = None, block: int = BLOCK, at_once: int = MERGES) -> DataFrame:
    """(id, cluster) from points (id long, reduced array<double>): the most stable clusters of at least min_size
    points, whatever their density; the rest is noise (null).

    min_samples is min_size where it is not given. A single cluster of all points is never chosen. Equal points are
    compared once and count as often as they occur; points with a null vector, or a null or infinite value in it,
    are noise. A cluster's number is the least id of its points; stable_ids names it by its turns. An empty table
    gives an empty result.
    """
    one = stored(distinct(points))
    b = blocks(one, block)
    reached = stored(core_distances(b, min_samples or min_size))
    clusters, first = merges(one.select("id", "weight"), spanning_tree(b, reached), min_size, at_once)
    # of the chosen clusters on the way to the root the last one counts; the way is doubled in each step
    way = stored(clusters.select("cluster", F.col("parent").alias("next"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    while not way.where("next is not null").isEmpty():
        on = way.select(F.col("cluster").alias("next"), F.col("next").alias("onward"), F.col("top").alias("above"))
        way = stored(way.join(on, "next", "left").select("cluster", F.col("onward").alias("next"), F.coalesce("above", "top").alias("top")))
    named = first.join(way, "cluster").where("top is not null").select("id", "top")
    number = named.groupBy("top").agg(F.min("id").alias("cluster"))
    labelled = one.join(named.join(number, "top"), "id").select("v", "cluster")
    v = F.transform(F.col("reduced").cast("array<double>"), lambda x: x + F.lit(0.0))
    return points.select("id", v.alias("v")).join(labelled, "v", "left").select("id", "cluster")
