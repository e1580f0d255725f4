"""Operator 10: embedding near-dedup by int8 quantised tile products.

Distinct vectors are packed into blocks of int8 codes with scales and errors, and each block has a centre
and a radius. Pairs of blocks whose directions lie too far apart go first, by the triangle inequality;
each pair that is left is a tile. A tile multiplies int8 vectors and bounds every product by the vectors'
own quantisation errors: what is surely below the threshold is dropped, what is surely above it links. Only
tiles with products that may be either get the vectors in full, and compute those again in double
precision. A tile hands on each vector's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, save
from .components import components

#: Vectors of a block, and of the part of it that is multiplied at a time.
BLOCK, STEP = 4096, 512
#: Blocks whose centres are compared with as many others at a time.
GROUP = 1024
#: Room for rounding in double precision: products that near the threshold are computed again.
ROOM = 1e-9


class Codes:
    """Unit vectors as int8 with a scale, and the exact length of each one's error; unit, the vectors in
    double precision, may be None."""

    def __init__(self, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, unit: np.ndarray | None):
        self.codes, self.scale, self.error, self.unit = codes, scale, error, unit

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        raw = x.astype(np.float64)
        # by the largest component first, so that no square overflows or vanishes
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1) / 127
        q = np.rint(unit / scale[:, None])
        return cls(q.astype(np.int8), scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)), unit)

    def part(self, at: slice):
        """Codes as floats (their products are whole numbers below 2**24 up to 1,040 dimensions;
        beyond that in double), scales, errors, and centre and radius of the part's directions."""
        kind = np.float32 if self.codes.shape[1] <= 1040 else np.float64
        near = self.codes[at] * self.scale[at, None]
        return self.codes[at].astype(kind), self.scale[at], self.error[at], *ball(near, self.error[at])


def ball(x: np.ndarray, error: np.ndarray):
    """A direction, and an angle around it that holds all vectors of about unit length, each of which is
    off by `error` at most."""
    mean = x.sum(axis=0)
    length = np.sqrt(mean @ mean)
    centre = mean / length if length > 1e-9 else np.eye(1, len(mean))[0]
    return centre, np.arccos(np.clip(x @ centre - error, -1, 1)).max() + 1e-9


def apart(cx, rx, cy, ry, threshold: float):
    """Whether no vector of one ball can reach the threshold with one of the other."""
    return np.arccos(np.clip(cx @ cy.T, -1, 1)) > rx + ry + np.arccos(threshold) + 1e-6


def links_of(a: Codes, b: Codes, threshold: float):
    """Index pairs (i in a, j in b) with cosine >= threshold, part by part. Without the vectors in full,
    None where they are needed."""
    right = [(j, b.part(slice(j, j + STEP))) for j in range(0, len(b.codes), STEP)]
    for i in range(0, len(a.codes), STEP):
        x, sx, ex, cx, rx = a.part(slice(i, i + STEP))
        for j, (y, sy, ey, cy, ry) in right:
            if a is b and j < i or apart(cx, rx, cy, ry, threshold):
                continue
            # a first cut by the largest errors, with room for the bounds' own rounding to float32
            least = threshold - ROOM - (ex.max() * (1 + ey.max()) + (1 + ex.max()) * ey.max() + ex.max() * ey.max())
            product = x @ y.T
            p, q = np.nonzero(product >= np.multiply.outer(((least - 1e-6) / sx).astype(x.dtype), (1 / sy).astype(x.dtype)) * x.dtype.type(1 - 1e-6))
            value = product[p, q].astype(np.float64) * sx[p] * sy[q]
            slack = ex[p] * (1 + ey[q]) + (1 + ex[p]) * ey[q] + ex[p] * ey[q]
            may = value + slack >= threshold - ROOM
            p, q, good = p[may], q[may], (value - slack)[may] >= threshold + ROOM
            if a is b:
                once = p + i < q + j
                p, q, good = p[once], q[once], good[once]
            unsure = np.flatnonzero(~good)
            if len(unsure) and a.unit is None:
                yield None
                return
            for at in range(0, len(unsure), 1 << 15):
                some = unsure[at : at + (1 << 15)]
                good[some] = (a.unit[i + p[some]] * b.unit[j + q[some]]).sum(axis=1) >= threshold
            if good.any():
                yield p[good] + i, q[good] + j


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def usable() -> F.Column:
    """Whether a vector can link at all."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some, F.lit(False))


def near_links(vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Per distinct vector: (rep, embedding key, copies), and its links to others: (a, b, n)
    where n counts links of a in one tile and b is a vector of its component there."""
    one = vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # near vectors lie near one another: ordered by signs of the first components
    code = F.array_join(F.transform(F.slice("embedding", 1, 24), lambda x: F.when(x > 0, "1").otherwise("0")), "")

    def pack(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for rows in _blocks(batches, BLOCK):
            ids, copies, vectors = (pa.concat_arrays([r.column(c) for r in rows]) for c in range(3))
            widths = np.diff(vectors.offsets.to_numpy())
            data, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
            for width in np.unique(widths).tolist():  # vectors of different widths do not meet
                own = np.flatnonzero(widths == width)
                x = data[at[own][:, None] + np.arange(width)]
                code = Codes.of(x)
                centre, radius = ball(code.unit, np.zeros(len(own)))
                packed = [ids.to_numpy()[own].astype("<i8"), copies.to_numpy()[own].astype("<i8"), code.codes, code.scale, code.error, x.astype("<f8"), centre.astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([width]), *[pa.array([v.tobytes()], pa.binary()) for v in packed], pa.array([float(radius)])], BLOCK_COLUMNS)
                k += 1

    n = one.count()
    ordered = one.withColumn("code", code).repartitionByRange(max(1, -(-n // BLOCK)), "code", "rep").sortWithinPartitions("code", "rep")
    blocks = save(ordered.select("rep", "copies", "embedding").mapInArrow(pack, ", ".join(f"{c} {t}" for c, t in zip(BLOCK_COLUMNS, BLOCK_TYPES, strict=True))))
    pairs = save(near_blocks(blocks, threshold))
    first = save(_tiles(blocks, pairs, threshold, False))
    todo = first.where("a is null").select(F.col("i"), F.col("j"))
    again = save(_tiles(blocks, todo, threshold, True))
    return one, first.where("a is not null").unionByName(again).select("a", "b", "n")


BLOCK_COLUMNS = ["block", "width", "ids", "copies", "codes", "scale", "error", "data", "centre", "radius"]
BLOCK_TYPES = ["long", "long", "binary", "binary", "binary", "binary", "binary", "binary", "binary", "double"]


def _blocks(batches, size: int):
    """The rows of Arrow batches, so many at a time."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, size - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == size:
                yield held
                held, n = [], 0
    if held:
        yield held


def near_blocks(blocks: DataFrame, threshold: float) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks of one width that are not too far apart. Their centres alone are
    compared, GROUP blocks with as many others at a time."""

    def bundle(batches):
        from pyspark import TaskContext

        for k, b in enumerate(batches):
            for at in range(0, b.num_rows, group):
                part = b.slice(at, group)
                yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + (k << 16) + at]), *[pa.array([part.column(c).to_pylist()]) for c in range(4)]], ["g", "block", "width", "centre", "radius"])

    size, group = blocks.count(), GROUP
    few = blocks.select("block", "width", "centre", "radius").coalesce(max(1, -(-size // (4 * GROUP))))
    groups = save(few.mapInArrow(bundle, "g long, block array<long>, width array<long>, centre array<binary>, radius array<double>"))
    names = [r.g for r in groups.select("g").collect()]  # one number for GROUP * BLOCK vectors
    both = groups.withColumn("h", F.explode(F.lit(names) if names else F.array().cast("array<long>")))

    def compare(table: pa.Table) -> pa.Table:
        x, y = (table.slice(k, 1).to_pylist()[0] for k in (0, table.num_rows - 1))
        i, j = [], []
        for width in set(x["width"]) & set(y["width"]):
            a, b = ([k for k, w in enumerate(s["width"]) if w == width] for s in (x, y))
            centre = [np.array([np.frombuffer(s["centre"][k], "<f8") for k in own]) for s, own in ((x, a), (y, b))]
            radius = [np.array([s["radius"][k] for k in own]) for s, own in ((x, a), (y, b))]
            p, q = np.nonzero(~apart(centre[0], radius[0][:, None], centre[1], radius[1], threshold))
            i += [x["block"][a[k]] for k in p]
            j += [y["block"][b[k]] for k in q]
        i, j = np.array(i, np.int64), np.array(j, np.int64)
        keep = i <= j if x["g"] == y["g"] else np.ones(len(i), bool)
        return pa.table({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep]})

    tiled = both.select(F.least("g", "h").alias("_i"), F.greatest("g", "h").alias("_j"), "g", "block", "width", "centre", "radius")
    return tiled.groupBy("_i", "_j").applyInArrow(compare, "i long, j long")


def _tiles(blocks: DataFrame, pairs: DataFrame, threshold: float, full: bool) -> DataFrame:
    """(a, b, n, i, j): the links of each pair of blocks. Without the vectors in full, one row with null a
    stands for a tile that needs them."""
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    columns = ["width", "ids", "copies", "data"] if full else ["width", "ids", "copies", "codes", "scale", "error"]
    tiled = sides.join(blocks.select("block", *columns), "block")

    def multiply(table: pa.Table) -> pa.Table:
        got = {r["block"]: r for r in table.to_pylist()}
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sides = []
        for key in dict.fromkeys((i, j)):
            r = got[key]
            ids, shape = np.frombuffer(r["ids"], "<i8"), (-1, r["width"])
            code = Codes.of(np.frombuffer(r["data"], "<f8").reshape(shape)) if full else Codes(np.frombuffer(r["codes"], np.int8).reshape(shape), np.frombuffer(r["scale"], "<f8"), np.frombuffer(r["error"], "<f8"), None)
            sides.append((ids, np.frombuffer(r["copies"], "<i8"), code))
        a, b = sides[0], sides[-1]
        node = np.concatenate([a[0], b[0]]) if i != j else a[0]
        shift = len(a[0]) if i != j else 0
        count, ps, qs = np.zeros(len(node), np.int64), [], []
        for found in links_of(a[2], b[2], threshold):
            if found is None:
                return pa.table({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), "n": pa.array([0]), "i": [i], "j": [j]})
            p, q = found[0], found[1] + shift
            np.add.at(count, p, b[1][q - shift])
            np.add.at(count, q, a[1][p])
            label = forest(len(node), np.concatenate([p, *ps]), np.concatenate([q, *qs]))
            ps, qs = [np.flatnonzero(label != np.arange(len(node)))], [label[label != np.arange(len(node))]]
        has = np.flatnonzero(count)
        label = forest(len(node), *[np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ps, qs)])
        return pa.table({"a": node[has], "b": node[label[has]], "n": count[has], "i": np.full(len(has), i), "j": np.full(len(has), j)})

    return tiled.groupBy("i", "j").applyInArrow(multiply, "a long, b long, n long, i long, j long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors link at a cosine of `threshold` or more in double precision; n_links counts the
    other rows linked directly, component_id is the smallest vec_id reachable, kept tells
    whether it is the row's own. Vectors that are null, empty, all zero, or hold null, NaN or
    infinity, and vectors of different widths, link with nothing. Repeated rows link with each
    other; a null vec_id links with nothing. Other columns are not read.
    """
    named = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("good", usable())
    good = save(named.where("good").drop("good"))
    one, links = near_links(good, threshold)
    links = save(links)
    labels = components(links.select("a", "b"))
    totals = links.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    classes = one.join(totals, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    linked = good.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    rest = named.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(r) AS component_id, min(r) = e.vec_id AS kept
FROM embeddings e JOIN reach USING (vec_id) GROUP BY e.vec_id
"""
