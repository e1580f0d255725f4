"""Topics of client turns: corpus, density clusters, names and drill-down."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import worth_embedding
from ..sources.scratch import drop, stored
from .neighbours import PACKED, SLACK, Tile, apart, blocks, compared, count_near, counted, distances, distinct, inside, lists, meeting, total

#: Least turns of a cluster, and dimensions that turns are reduced to.
MIN_CLUSTER, DIMENSIONS = 5, 20
#: Links up to which components are found without rounds of joins: 2 MB of pairs.
FEW_LINKS = 100_000


def cluster_corpus(turns: DataFrame, convs: DataFrame, mode: str = "faq") -> DataFrame:
    """Client turns worth embedding of AI conversations; 'failure' takes those that did not convert."""
    kept = convs.where("is_ai")
    if mode == "failure":
        kept = kept.where(F.col("outcome").isin("lost", "abandoned"))
    said = turns.where((F.col("role") == "client") & (F.coalesce("raw_text", F.lit("")) != "") & worth_embedding(F.col("raw_text")))
    return said.join(kept.select("conversation_id", "outcome"), "conversation_id").select("conversation_id", "turn_index", "turn_id", "raw_text", "outcome")


def embed(df: DataFrame, text: str = "raw_text", features: int = 256, n: int = 3) -> DataFrame:
    """df with `embedding`, unit vectors of hashed character n-grams; pass an embedding column
    of your own instead where there is an encoder."""
    t = F.lower(F.col(text))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, F.lit(n)))
    out = HashingTF(inputCol="_g", outputCol="_f", numFeatures=features).transform(df.withColumn("_g", grams))
    return Normalizer(inputCol="_f", outputCol="_n").transform(out).withColumn("embedding", vector_to_array("_n")).drop("_g", "_f", "_n")


def reduce(df: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    """df with `reduced`, its min(k, width) leading principal components after scaling to unit length."""
    width = df.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).head()
    k = min(k, width.n) if width else k
    x = Normalizer(inputCol="_v", outputCol="_u").transform(df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>"))))
    return PCA(k=k, inputCol="_u", outputCol="_p").fit(x).transform(x).withColumn("reduced", vector_to_array("_p")).drop("_v", "_u", "_p")


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least id that each node reaches. Rounds of joins, each written to the
    checkpoint folder; pointers skip a step in every round. Up to FEW_LINKS links are followed by the driver."""
    few = edges.select("a", "b").limit(FEW_LINKS + 1).collect()
    if len(few) <= FEW_LINKS:
        forest = _Forest()
        for a, b in few:
            forest.join(a, b)
        known = edges.sparkSession.createDataFrame([(x, forest.root(x)) for x in list(forest.up)], "id long, label long")
        return nodes.join(known, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = stored(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(now, both.a == now.id).groupBy("b").agg(F.min("label").alias("near"))
        step = now.join(near, now.id == near.b, "left").select("id", "label", F.least("label", "near").alias("new"))
        roots = now.select(F.col("id").alias("new"), F.col("label").alias("root"))
        nxt = stored(step.join(roots, "new", "left").select("id", "label", F.least("new", "root").alias("new")))
        if nxt.where("label != new").isEmpty():
            return now
        now = nxt.select("id", F.col("new").alias("label"))


def _back(points: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """columns of distinct vectors (v) for each point."""
    v = F.transform(F.col("reduced").cast("array<double>"), lambda x: x + F.lit(0.0))
    return points.select("id", v.alias("v")).join(named.select("v", *columns), "v").select("id", *columns)


def neighbour_counts(points: DataFrame, eps: float) -> DataFrame:
    """(id, n) from points (id long, reduced array<double>): how many points lie within eps, the point itself
    included. Points with a null vector, or a null or infinite value in it, are left out."""
    one = stored(distinct(points))
    return _back(points, one.join(count_near(one, blocks(one), eps), "id"), "n")


def core_distance(points: DataFrame, min_samples: int = MIN_CLUSTER) -> DataFrame:
    """(id, core): the distance within which each point has min_samples others; infinite where there are not so many.
    Points with a null vector, or a null or infinite value in it, are left out."""
    from .hierarchy import core_distances

    return _back(points, core_distances(blocks(stored(distinct(points))), min_samples), "core")


def _local_components(near: np.ndarray) -> np.ndarray:
    """The least index that each of some points reaches, from the matrix of which are near."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


class _Forest:
    """Least members of sets that grow together."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _marked(eps: float, min_samples: int):
    """Tiles with `dense` and `part`, the least id of the connected dense points of its block that a dense point is one of."""

    def mark(found: pa.Table, tile: pa.Table) -> pa.Table:
        x = Tile(tile.combine_chunks().to_batches()[0], 0)
        dense, part = total(found) >= min_samples, x.ids.copy()
        for lo, hi in pairwise(x.starts):
            at = lo + np.flatnonzero(dense[lo:hi])
            label = _local_components(distances(x.v[at], x.v[at]) <= eps) if len(at) else at
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, label, x.ids[at])
            part[at] = least[label]
        for name, values in (("dense", dense.astype(np.int64)), ("part", part)):
            tile = tile.append_column(name, pa.array([values.tobytes()], pa.binary()))
        return tile

    return mark


def _met(eps: float):
    """Of a tile and others: links of parts, d -1, of which those that others make up for are left out, and the nearest
    dense point within eps of each other point."""

    def meet(x: Tile, others: Iterator[Tile]) -> pa.RecordBatch:
        dense, part, n = x.packed("dense") > 0, x.packed("part"), len(x.ids)
        r, best, nearest = np.full(n, eps + SLACK), np.full(n, np.inf), np.zeros(n, np.int64)
        forest, links = _Forest(), []
        for y in others:
            may, theirs = y.packed("dense") > 0, y.packed("part")
            for rows, there, d, error in compared(x, y, r):
                m = there.start + np.flatnonzero(may[there])
                if not len(m):
                    continue
                near, own = inside(x, y, rows, there, d, error, eps)[:, may[there]], dense[rows]
                (one, i), (two, j) = np.unique(part[rows[own]], return_inverse=True), np.unique(theirs[m], return_inverse=True)
                hit, (q, k) = np.zeros((len(one), len(two)), bool), np.nonzero(near[own])
                hit[i[q], j[k]] = True
                q, k = np.nonzero(hit & (one[:, None] < two))
                links += [(a, b) for a, b in zip(one[q].tolist(), two[k].tolist(), strict=True) if forest.join(a, b)]
                q, k = np.nonzero(near[~own])
                at, to = rows[~own][q], m[k]
                e = apart(x.v[at], y.v[to])
                order = np.lexsort((y.ids[to], e, at))
                order = order[np.diff(at[order], prepend=-1) > 0]
                at, to, e = at[order], y.ids[to[order]], e[order]
                better = (e < best[at]) | ((e == best[at]) & (to < nearest[at]))
                best[at[better]], nearest[at[better]] = e[better], to[better]
        edge, pairs = np.isfinite(best), np.array(links, np.int64).reshape(-1, 2)
        columns = (pairs[:, 0], x.ids[edge]), (pairs[:, 1], nearest[edge]), (np.full(len(pairs), -1.0), best[edge])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["id", "other", "d"])

    return meet


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in (Tile(b, i) for b in batches for i in range(b.num_rows)):
        part = pa.array(x.packed("part"), mask=x.packed("dense") == 0)
        yield pa.RecordBatch.from_arrays([pa.array(x.ids), part, lists(x.v.ravel(), np.full(len(x.ids), x.v.shape[1]))], ["id", "part", "v"])


def density_clusters(points: DataFrame, eps: float, min_samples: int = MIN_CLUSTER, min_size: int = MIN_CLUSTER) -> DataFrame:
    """(id, cluster) from points (id long, reduced array<double>): dense points within eps of
    each other are one cluster, near ones join the nearest, and the rest is noise (null).

    Neighbours are exact. Connected parts of blocks are linked, and a link that others make up for is left out, so
    that links do not grow with the square of a dense region. Equal points count as often as they occur but are compared once;
    points with a null vector, or a null or infinite value in it, are noise. A cluster's number is the least
    id of its dense points; stable_ids names it by its turns, cluster_sizes ranks it.
    """
    one = stored(distinct(points))
    b = blocks(one)
    drop(one)
    flagged = stored(counted(b, eps).groupBy("tile").cogroup(b.tiles.groupBy("tile")).applyInArrow(_marked(eps, min_samples), f"{PACKED}, dense binary, part binary"))
    drop(b.tiles)
    met = stored(meeting(b, flagged, flagged, _met(eps), "id long, other long, d double"))
    each = flagged.mapInArrow(_each, "id long, part long, v array<double>")
    part = stored(each.where("part is not null").select("id", "part"))
    links = met.where("d < 0").select(F.col("id").alias("a"), F.col("other").alias("b"))
    of_part = smallest_reachable(part.select(F.col("part").alias("id")).distinct(), links).withColumnRenamed("id", "part")
    labels = stored(part.join(of_part, "part").select("id", "label"))
    # border points take the label of the nearest dense point
    border = met.where("d >= 0").join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min_by("label", F.struct("d", "other")).alias("label"))
    named = each.join(labels.unionByName(border), "id", "left").select("v", "label")
    v = F.transform(F.col("reduced").cast("array<double>"), lambda x: x + F.lit(0.0))
    all_ = stored(points.select("id", v.alias("v")).join(named, "v", "left").select("id", "label"))
    drop(flagged, met, part, labels)
    sizes = all_.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return all_.join(sizes.select("label", F.col("label").alias("cluster")), "label", "left").select("id", "cluster")


def stable_ids(assigned: DataFrame, cluster_type: str, cluster: str = "cluster") -> DataFrame:
    """(cluster, cluster_id): an id that is the same in every run that finds the same cluster, from the
    type and the least turn_id of its members."""
    least = assigned.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.min("turn_id").alias("_t"))
    return least.select(cluster, F.md5(F.concat_ws(":", F.lit(cluster_type), "_t")).alias("cluster_id"))


def turn_coords(points: DataFrame, assigned: DataFrame, cluster_type: str, cluster: str = "cluster") -> DataFrame:
    """(cluster_type, turn_id, x, y, cluster_id) from points (turn_id, x, y) and assigned (turn_id, cluster):
    every point, the id null for noise. Keyed by type and turn, so that types do not replace each other."""
    own = assigned.select("turn_id", F.col(cluster).alias("_c"))
    named = own.join(stable_ids(own, cluster_type, "_c"), "_c").select("turn_id", "cluster_id")
    return points.join(named, "turn_id", "left").select(F.lit(cluster_type).alias("cluster_type"), "turn_id", "x", "y", "cluster_id")


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Turns of each cluster with its rank by size, and the share of noise."""
    sizes = assigned.groupBy(cluster).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    noise = F.coalesce(F.sum(F.when(F.col(cluster).isNull(), F.col("n"))).over(Window.partitionBy()), F.lit(0))
    out = sizes.select(cluster, "n", F.round(noise / total, 6).alias("noise_share")).where(F.col(cluster).isNotNull())
    return out.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), cluster)) - 1)


def cluster_samples(members: DataFrame, n: int = 12) -> DataFrame:
    own = Window.partitionBy("cluster_id").orderBy("turn_id")
    return members.where("cluster_id is not null").withColumn("r", F.row_number().over(own)).where(F.col("r") <= n).select("cluster_id", "r", "turn_id", "raw_text")


def cluster_terms(members: DataFrame, n: int = 5) -> DataFrame:
    """A cluster's name: its top terms by count times ln(1 + clusters / clusters with the term)."""
    words = members.where("cluster_id is not null").select("cluster_id", F.explode(F.split(F.lower("raw_text"), r"[^a-z]+")).alias("term")).where("length(term) > 2")
    tf = words.groupBy("cluster_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    k = members.where("cluster_id is not null").select("cluster_id").distinct().agg(F.count("*").alias("k"))
    w = tf.join(df, "term").join(F.broadcast(k)).withColumn("w", F.round(F.col("tf") * F.log(1 + F.col("k") / F.col("df")), 6))
    top = w.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("w"), "term"))).where(F.col("r") <= n)
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("name"))


def top_clusters(members: DataFrame, n: int = 10) -> DataFrame:
    """The n largest clusters with their share of these n."""
    top = members.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(n)
    return top.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 1))


def cluster_map(coords: DataFrame, turns: DataFrame, clusters: DataFrame) -> DataFrame:
    """Points with short text and cluster label, 'Noise' where there is none."""
    out = coords.join(turns.select("turn_id", "raw_text"), "turn_id").join(clusters.select("cluster_id", "label"), "cluster_id", "left")
    return out.select("turn_id", "x", "y", F.coalesce("label", F.lit("Noise")).alias("label"), F.substring("raw_text", 1, 80).alias("text"))


def cluster_drilldown(members: DataFrame, turns: DataFrame, convs: DataFrame, cluster: int) -> DataFrame:
    """One cluster's turns with their conversations' outcomes; filtered before it is joined."""
    own = members.where(F.col("cluster_id") == cluster).select("turn_id", "conversation_id")
    return own.join(turns.select("turn_id", "raw_text"), "turn_id").join(convs.select("conversation_id", "outcome"), "conversation_id").orderBy("outcome", "raw_text")


def cluster_outcomes(members: DataFrame, convs: DataFrame, cluster: int) -> DataFrame:
    own = members.where(F.col("cluster_id") == cluster).join(convs.select("conversation_id", "outcome"), "conversation_id")
    return own.groupBy("outcome").agg(F.count("*").alias("n"))
