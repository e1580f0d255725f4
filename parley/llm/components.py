"""Connected components and bucket linking on DataFrames of 64-bit node ids.

Nothing is collected: each round is a join and an aggregation, and ends in a table in the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, label) for every node with an edge; label is the smallest
    node of its component. Self-links and repeated links are ignored; nulls link nothing.

    Each round hooks every node to its smallest smaller neighbour and hands its other links to
    that neighbour, then lets every pointer skip one step. It ends when each node has one
    pointer and that leads to a root. No round needs all links of a node in one task: the
    smallest neighbour is a partial aggregation, the rest are joins which Spark can split.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    now = save(links.where(F.col("hi") > F.col("lo")).distinct())
    while True:
        least = save(now.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        # where a pointer's target points in turn
        onward = least.select(F.col("hi").alias("m"), F.col("m").alias("mm"))
        short = least.join(onward, "m", "left").select("hi", "m", "n", F.coalesce("mm", "m").alias("to"))
        state = short.agg(F.max("n").alias("n"), F.max((F.col("to") != F.col("m")).cast("int")).alias("moved")).first()
        if (state.n or 1) == 1 and not state.moved:
            drop(now)
            return least.select(F.col("hi").alias("node"), F.col("m").alias("label")).unionByName(least.select(F.col("m").alias("node"), F.col("m").alias("label")).distinct())
        kept = short.select("hi", F.col("to").alias("lo"))
        handed = now.join(least.where("n > 1"), "hi").where("lo != m").select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo"))
        nxt = save(kept.unionByName(handed).where("hi > lo").distinct())
        drop(least, now)
        now = nxt


#: In the last step the members of a bucket are compared by so many at a time with all others.
SLICE = 256


def _whole_buckets(labelled: DataFrame, could: Callable[[str, str], F.Column], sketches: DataFrame | None, slices: Callable[[F.Column], F.Column], parts: int) -> DataFrame:
    """(a, b): of all pairs of a bucket in different components those that pass `could`, tested
    inside the join, so that no other pair leaves it. Large buckets are dealt by slices, and so many
    parts of the buckets follow one another, as each member is shipped with its sketch."""
    sizes = labelled.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h"), F.count("*").alias("_c")).where("_l < _h")
    some = save(labelled.join(sizes.select("key", slices(F.col("_c")).cast("int").alias("_c")), "key"))
    found = []
    for part in range(parts):
        own = some.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else some
        full = own.join(sketches, "node") if sketches is not None else own
        named = lambda x, at: full.select("key", at.alias("_slice"), *[F.col(c).alias(f"{x}{c}") for c in full.columns if c not in ("key", "_c")])  # noqa: B023, E731
        x = named("x_", F.pmod(F.xxhash64("node", F.lit(1)), "_c").cast("int"))
        y = named("y_", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
        both = x.join(y, ["key", "_slice"]).where((F.col("x_label") < F.col("y_label")) & could("x_", "y_"))
        found.append(save(both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()))
    pairs = found[0]
    if parts > 1:
        pairs = save(reduce(DataFrame.unionByName, found).distinct())
        drop(*found)
    drop(some)
    return pairs


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], could: Callable[[str, str], F.Column], sketches: DataFrame | None = None, rounds: int = 2, prefer: tuple[str, ...] = (), slices: Callable[[F.Column], F.Column] = lambda c: F.ceil(c / SLICE), parts: int = 1, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the nodes that share a bucket and pass `verify`: (node, label).

    members: (key long, node long, and columns that `could` reads), one row per key and node.
    verify: gets distinct pairs (a, b) and returns those that are links.
    could: a condition on columns of two members, prefixed x_ and y_, that true links pass.
    sketches: a table by node whose columns `could` reads.
    prefer: columns of which a low value lets a member pass `could` more often.
    slices: into how many slices a bucket of so many members is cut in the last step; it is shipped once for each.
    parts: so many parts of the buckets follow one another in the last step, so that less is shipped at once.
    last: verifies the pairs of the last step, where a node can have many.

    In each round every bucket names one member, and every node is verified against one of those
    named by its buckets, from the second round on against eight, so that a group of copies costs its
    size and not the square of it. Only buckets whose nodes are still in different components go on.
    In the last step every pair of nodes of different components in a bucket that passes `could` is
    verified, so no link that could join two components is left out.
    """
    extra = [c for c in members.columns if c not in ("key", "node")]
    labelled, links, tested, labels, made = members.withColumn("label", F.col("node")), None, None, None, []

    def keep(df: DataFrame) -> DataFrame:
        made.append(save(df))
        return made[-1]

    for step in range(rounds + 1):
        if step:
            mixed = labelled.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l < _h").select("key")
            labelled = keep(labelled.join(mixed, "key", "left_semi"))
        if step == rounds:
            pairs = _whole_buckets(labelled, could, sketches, slices, parts)
            made.append(pairs)
        else:
            turn = F.col("node") if not step else F.struct(*prefer, F.xxhash64("node", "key", F.lit(step)))
            named = labelled.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "label", *extra)).alias("y"))
            y = named.select("key", F.col("y.turn").alias("turn"), *[F.col("y")[c].alias(f"y_{c}") for c in ("node", "label", *extra)])
            x = labelled.select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", *extra)])
            both = x.join(y, "key").where("x_label != y_label")
            if sketches is None:
                both = both.where(could("x_", "y_"))
            tries = both.groupBy("x_node", "y_node").agg(F.min("turn").alias("turn"), F.count("*").alias("n"))
            if step:
                # a node of a loosely knit group is tried against a few, whose components then merge
                own = Window.partitionBy("x_node").orderBy("turn", "y_node")
                tries = tries.withColumn("r", F.row_number().over(own)).where("r <= 8")
            else:
                tries = tries.groupBy("x_node").agg(F.max_by("y_node", F.struct("n", "y_node")).alias("y_node"))
            if sketches is not None:
                known = lambda x: sketches.select(*[F.col(c).alias(f"{x}{c}") for c in sketches.columns])
                tries = tries.join(known("x_"), "x_node").join(known("y_"), "y_node").where(could("x_", "y_"))
            pairs = tries.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs)
        found = (last if last and step == rounds else verify)(pairs)
        if hasattr(found, "_scratch"):
            made += [] if found is pairs else [found]
        else:
            found = keep(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if labels is not None and found.isEmpty():
            continue  # nothing new has merged
        labels = keep(components(links))
        if step < rounds:
            labelled = keep(labelled.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "node", "label", *extra))
    drop(*[df for df in made if df is not labels])
    return labels
