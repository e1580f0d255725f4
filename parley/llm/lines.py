"""Operator 9: fuzzy line dedup by MinHash, in DataFrame operations only.

Equal lines are one node, named by a 64-bit hash. Each node's character shingles are exploded and
hashed; every band has its own part of all shingles, and its key is ROWS minima over that part. Lines
that share a band's key are candidates; their exact Jaccard similarity is taken over whole lines;
linked lines are merged by distributed union-find, and of each component the first line of the
smallest doc_id stays.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, load, save
from .components import link_buckets

#: Characters of the shingles that are compared: short ones, so that a line of 39 characters or more
#: still links after a change of one.
SHINGLE = 4
BANDS = 16
#: How lines are signed, by their characters, or by their different shingles where these are clearly fewer: (least, most, shingle's width, minima of a key, bands
#: that each shingle is in; under 1: the part of all shingles that is looked at). Shingles of 6 are
#: seldom shared by chance; a change of one character costs them half as much again, so that 0.8 over
#: shingles of 4 is about 0.71 over these: 1 - (1 - 0.71**4)**16 = 0.992 share a band. Short lines have
#: too few, and are signed with shingles of 4 that are in all bands: 1 - (1 - 0.8**5)**16 = 0.998.
#: Neighbouring classes overlap by a factor of 1.25, so two sets at 0.8 have a class in common.
CLASSES = ((0, 64, 4, 5, BANDS), (52, 200, 6, 4, 2), (160, 400, 6, 4, 1), (320, 1600, 6, 4, 0.5), (1280, None, 6, 4, 0.125))
#: A digest has 64 bits a band, one set by each shingle. Two lines are compared in full where their digests differ in no more
#: bits than a third of the mean number that is set, and three deviations.
DIFFER = 1 / 3


def _units(line: str) -> Column:
    """Two bytes a character (UTF-16), so that a shingle is cut out in constant time."""
    return F.encode(line, "UTF-16BE")


def _exploded(units: DataFrame, width: int, *kept: str) -> DataFrame:
    """(kept columns, x): the hash of each shingle of a column u of _units; a shorter line is one shingle."""
    last = F.greatest(F.lit(1), (F.length("u") / 2).cast("int") - width + 1)
    each = units.select(*kept, "u", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    return each.select(*kept, F.expr(f"xxhash64(substring(u, i * 2 - 1, {2 * width}))").alias("x"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, h) for each line that is not blank; th tells texts apart."""
    exploded = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return exploded.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _extent(line: str, units: Column, width: int = SHINGLE) -> Column:
    """The length of a line, or where eight characters in its middle and at both quarters occur three times each, that of a
    line of as many different shingles without repeats: lines of equal sets have about the same, whatever their lengths."""
    n = F.length(line)
    part = [F.substring(line, F.greatest(F.lit(1), (n * k / 4).cast("int")), F.lit(8)) for k in (1, 2, 3)]
    often = [(n - F.length(F.replace(line, p, F.lit("")))) >= 3 * F.length(p) for p in part]
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))
    shingles = lambda u: F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring(u, i * 2 - 1, F.lit(2 * width)))))
    # an array of one binds the units, which would else be made again for each shingle
    different = F.element_at(F.transform(F.array(units), lambda u: F.size(shingles(u))), 1)
    repeats = (n > 3 * width) & reduce(Column.__and__, often)
    return F.when(repeats, different + width - 1).otherwise(n)


def banded(lines: DataFrame, classes: tuple = CLASSES, bands: int = BANDS) -> DataFrame:
    """(node, class, band, key, d): for each class of a line and each band that has a shingle of it, the band's key and its 64
    bits of the digest. lines: (h, line), partitioned by h, so that no shingle is shuffled, and n, their _extent, where it is
    known. Classes that differ only in how many shingles are looked at are one pass."""
    units = lines.withColumn("u", _units("line"))
    units = units.select("h", F.col("n") if "n" in lines.columns else _extent("line", F.col("u")).alias("n"), "u")
    passes: dict[tuple, list[int]] = {}
    for k, (*_, width, rows, per) in enumerate(classes):
        passes.setdefault((width, rows, max(1, int(per))), []).append(k)
    made = []
    for (width, rows, per), members in passes.items():
        within = [(F.col("n") >= classes[k][0]) & (F.lit(True) if classes[k][1] is None else F.col("n") <= classes[k][1]) for k in members]
        own = F.array_compact(F.array(*[F.when(w, F.lit(k).cast("byte")) for k, w in zip(members, within, strict=True)]))
        x = _exploded(units.where(reduce(Column.__or__, within)).select("h", "u", F.explode(own).alias("class")), width, "h", "class")
        if any(classes[k][4] < 1 for k in members):
            mask = reduce(lambda c, k: F.when(F.col("class") == k, F.lit(round(1 / min(1, classes[k][4])) - 1)).otherwise(c), members, F.lit(0))
            x = x.where(F.shiftrightunsigned("x", 32).bitwiseAND(mask.cast("long")) == 0)
        bytes_ = [F.shiftrightunsigned("x", 8 * i).bitwiseAND(bands - 1).cast("int") for i in range(per)]
        band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))) if per == bands else F.explode(F.array(*bytes_)) if per > 1 else bytes_[0]
        all_ = x.select("h", "class", "x", band.alias("band"))
        # orders of a band's own shingles by bits 13 apart; where bands share them, by a hash for each
        order = [F.xxhash64("x", F.col("band") * rows + r) if per == bands else F.shiftleft("x", 13 * r) for r in range(rows)]
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("x", 20).bitwiseAND(63).cast("int"))
        # in the digest no shingle is in all bands
        bit = F.when(bytes_[0] == F.col("band"), bit).otherwise(F.lit(0).cast("long")) if per == bands else bit
        minima = all_.groupBy("h", "class", "band").agg(F.bit_or(bit).alias("d"), *[F.min(o).alias(f"m{r}") for r, o in enumerate(order)])
        key = F.xxhash64(F.col("class").cast("int"), "band", *[f"m{r}" for r in range(rows)])
        made.append(minima.select(F.col("h").alias("node"), "class", F.col("band").cast("byte").alias("band"), key.alias("key"), "d"))
    return reduce(DataFrame.unionByName, made)


def sketches(banded: DataFrame, bands: int = BANDS, keys: bool = False) -> DataFrame:
    """(node, class, p, d0, ...): the digest in one row, 0 for a band without a shingle, and the number of its bits that are set;
    with `keys` also k0, ..., null for such a band."""
    of = lambda c, b: F.max(F.when(F.col("band") == b, F.col(c)))
    named = [of("key", b).alias(f"k{b}") for b in range(bands)] if keys else []
    return banded.groupBy("node", "class").agg(*named, F.sum(F.bit_count("d")).cast("int").alias("p"), *[F.coalesce(of("d", b), F.lit(0).cast("long")).alias(f"d{b}") for b in range(bands)])


def signed(lines: DataFrame, classes: tuple = CLASSES, bands: int = BANDS) -> DataFrame:
    """(node, class, k0, ..., p, d0, ...): the keys of a line and its digest, once for each of its classes."""
    return sketches(banded(lines, classes, bands), bands, keys=True)


def shared_keys(banded: DataFrame, rounds: int = 4) -> DataFrame:
    """(key, node): the keys that two lines or more have, so many bands at a time, so that only a part of the keys is
    shuffled at once."""
    found = []
    for at in range(rounds):
        some = banded.where(F.col("band") % rounds == at).select("node", "key")
        often = some.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        # few keys are shared, so their side is hashed and all the others need no sort
        found.append(save(some.join(often.hint("shuffle_hash"), "key", "left_semi").select("key", "node")))
    members = save(reduce(DataFrame.unionByName, found))
    drop(*found)
    return members


def _agree(bands: int = BANDS, differ: float = DIFFER):
    """Two signatures are of one class and their digests differ in few of their bits."""

    def could(x: str, y: str) -> Column:
        unequal = reduce(Column.__add__, [F.bit_count(F.col(f"{x}d{b}").bitwiseXOR(F.col(f"{y}d{b}"))) for b in range(bands)])
        mean = (F.col(f"{x}p") + F.col(f"{y}p")) * (differ / 2)
        most = mean + 3 * F.sqrt(mean) + 2
        # the numbers differ by no more than the bits
        return (F.col(f"{x}class") == F.col(f"{y}class")) & (F.abs(F.col(f"{x}p") - F.col(f"{y}p")) <= most) & (unequal <= most)

    return could


def _exact(classes: tuple = CLASSES, width: int = SHINGLE) -> tuple:
    """Classes whose digests hold every shingle that is compared, of lines without an upper length an eighth of them."""
    return tuple((least, most, width, 1, 1 if most is not None else 0.125) for least, most, *_ in classes)


def exact_sketches(lines: DataFrame, classes: tuple = CLASSES, width: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(node, class, p, d0, ..., s, f): digests of the shingles that are compared; s: how many these are, estimated from the bits
    set; f: variance of a digest's differing bits, as a part of their number. lines: (h, line), partitioned by h."""
    most, drawn = 64 * bands, [k for k, c in enumerate(_exact(classes, width)) if c[4] < 1]
    out = sketches(banded(lines, _exact(classes, width), bands), bands)
    size = F.log(1 - F.least("p", F.lit(most - 1)) / most) * -most
    return out.withColumns({"s": size, "f": F.when(F.col("class").isin(drawn), 1.5).otherwise(F.col("p") / most)})


def _close(similarity: float, bands: int = BANDS):
    """Two exact sketches are of one class and differ in no more bits than sets at the similarity do, and three deviations."""

    def could(x: str, y: str) -> Column:
        most = 64 * bands
        unequal = reduce(Column.__add__, [F.bit_count(F.col(f"{x}d{b}").bitwiseXOR(F.col(f"{y}d{b}"))) for b in range(bands)])
        union = (F.col(f"{x}s") + F.col(f"{y}s")) / (1 + similarity)
        # bits that no shared shingle sets and one of the others does
        mean = F.exp(union * (-similarity / most)) * (1 - F.exp(union * ((similarity - 1) / most))) * most
        near = unequal <= mean + 3 * F.sqrt(mean * F.greatest(f"{x}f", f"{y}f")) + 2
        return (F.col(f"{x}class") == F.col(f"{y}class")) & near

    return could


def _slices(members: Column) -> Column:
    """A slice is 16 times the root of its bucket, so that what is shipped grows with the power 1.5 of a bucket and not its square."""
    return F.ceil(F.sqrt(members) / 16)


def _alike(similarity: float) -> Column:
    """Whether an intersection of i elements and a union of u reach the similarity, in whole numbers."""
    num, den = Fraction(str(similarity)).as_integer_ratio()
    return den * F.col("i") >= num * F.col("u")


def _common(a: str, b: str, width: int) -> Column:
    """(i, u): the sizes of the intersection and the union of two lines' sets of shingles, within their row."""

    def shingles(units: Column) -> Column:
        # an array of one binds the units
        last = lambda u: F.greatest(F.lit(1), (F.length(u) / 2).cast("int") - width + 1)
        each = lambda u: F.array_distinct(F.transform(F.sequence(F.lit(1), last(u)), lambda i: F.xxhash64(F.substring(u, i * 2 - 1, F.lit(2 * width)))))
        return F.element_at(F.transform(F.array(units), each), 1)

    sets = F.struct(shingles(_units(a)).alias("a"), shingles(_units(b)).alias("b"))
    sizes = F.transform(F.array(sets), lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("i"), (F.size(s["a"]) + F.size(s["b"])).alias("both")))
    return F.element_at(F.transform(sizes, lambda s: F.struct(s["i"].alias("i"), (s["both"] - s["i"]).alias("u"))), 1)


def verify_pairs(lines: DataFrame, width: int, similarity: float):
    """Of pairs (a, b) those whose sets of shingles are at the similarity, each compared within its row, so that pairs of one
    node need not meet in a task. lines: (node, line), a node repeated or not."""

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = save(lines.join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("line").alias("line")))
        side = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        linked = save(both.select("a", "b", F.inline(F.array(_common("line_a", "line_b", width)))).where(_alike(similarity)).select("a", "b"))
        drop(texts)
        return linked

    return verify


def dedup_lines(docs: DataFrame, width: int = SHINGLE, classes: tuple = CLASSES, similarity: float = 0.8) -> DataFrame:
    """docs with `text` without its repeated lines, and columns n_lines and n_removed (long).

    Lines are split at line feeds. Lines link where the Jaccard similarity of their sets of
    `width`-character shingles is `similarity` or more and they share a band; equal lines always
    do. Of the lines of a component the one of smallest (doc_id, position) stays, null ids
    before all. Blank lines stay and are not counted. A null text stays null. Rows repeated in
    full are one document and come out alike; rows that share only a doc_id are told apart by
    their texts. Columns named n_lines or n_removed are replaced; all others stay.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = lines_of(docs.select("doc_id", "text"))
    place = F.struct("doc_id", "pos", "th")
    first = save(lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    # extents are taken before the shuffle that all classes share
    sized = lines.withColumn("n", _extent("line", _units("line"))).groupBy("h").agg(F.any_value("line").alias("line"), F.any_value("n").alias("n"))
    signatures = save(banded(sized, classes))
    members = shared_keys(signatures)
    nodes = save(members.select("node").distinct())
    few = nodes.hint("shuffle_hash")
    # half of the bands at a time, as all lines' are shuffled
    halves = [save(signatures.where(F.col("band") % 2 == at).drop("key").join(few, "node", "left_semi")) for at in (0, 1)]
    drop(signatures)
    digests = save(sketches(reduce(DataFrame.unionByName, halves)))
    drop(*halves)
    # each round compares some of these lines, so they are taken out of the documents once
    held = save(lines.select(F.col("h").alias("node"), "line").join(few, "node", "left_semi").groupBy("node").agg(F.any_value("line").alias("line")))
    drop(nodes)

    verify = verify_pairs(held, width, similarity)

    def last(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = held.join(some, "node", "left_semi").select(F.col("node").alias("h"), "line").repartition("h")
        exact = save(exact_sketches(own, classes, width))
        side = lambda x, at: exact.select(F.col("node").alias(at), *[F.col(c).alias(f"{x}{c}") for c in exact.columns if c != "node"])
        near = save(pairs.join(side("x_", "a"), "a").join(side("y_", "b"), "b").where(_close(similarity)("x_", "y_")).select("a", "b").distinct())
        found = verify(near)
        drop(exact, near)
        return found

    labels = link_buckets(members, verify, _agree(), digests, slices=_slices, parts=4, last=last)
    drop(digests, held)
    # lines that are not alone, with the place of the one that stays
    linked = first.join(labels.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or label is not null").withColumn("label", F.coalesce("label", "h"))
    stays = linked.groupBy("label").agg(F.min("first").alias("stay"))
    fate = save(linked.join(stays, "label").select("h", "stay"))
    gone = lines.select("doc_id", "th", "pos", "h").join(fate, "h").where(~F.col("stay").eqNullSafe(place))
    dropped = gone.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone"))
    joined = docs.select(*kept).withColumn("_t", F.xxhash64("text")).join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left")
    parts = F.split("text", "\n")
    rest = F.filter(parts, lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    n = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = joined.withColumns({"n_lines": F.greatest(n, F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "text": text})
    drop(members)
    return out.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long"))).select(*kept, "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, how many went, and a digest of the text that is left."""
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("kept_sha256"))
