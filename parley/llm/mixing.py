"""Operator 1: mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact word count within each source. A source's budget is filled with
whole passes, then with an equal share of every length, then with a bounded-knapsack dynamic
program over the lengths that are left; seeded hashes choose the documents of each length.
Only one row a source reaches the driver, and one row a length of it a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, load, save

#: Words: runs of anything but these blanks (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: The dynamic program fills this many words of a budget, plus at most one document; where it ends
#: short, four times as many again and again, as long as its tables stay under so many bytes.
LAST, ROOM = 4096, 1 << 27


def targets(sizes: list[int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> list[float]:
    """Targets of sources in their order: share * all sizes dealt by weight, none above twice
    its size; what is above is dealt again to the others."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        for i in open_:
            out[i] = left * weights[i % len(weights)] / total
        over = [i for i in open_ if out[i] > 2 * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near `budget` from
    below as can be: counts bounded, lengths distinct and positive. A miss is the least possible
    if the tables of the whole budget stay under ROOM; else it may be larger, but not than the
    shortest document left."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    words = lambda take: sum(n * t for n, t in zip(lengths, take, strict=True))
    best, last = _fit(lengths, counts, budget, budget, LAST), 0
    while words(best) < budget and last < budget:
        last = min(max(LAST, 4 * last), budget)
        steps = sum(min(c, budget // n, last // n + 1).bit_length() for n, c in zip(lengths, counts, strict=True))
        if steps * (last + max(lengths)) // 8 > ROOM:
            break
        # the proportional share leaves more to the dynamic program
        best = max(best, _fit(lengths, counts, budget, budget - last, last), key=words)
    return best


def _fit(lengths: list[int], counts: list[int], budget: int, dealt: int, last: int) -> list[int]:
    """fit() with `dealt` words by equal share, and the dynamic program from `last` words on."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [c * dealt // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left > last:
            more = min(counts[i] - take[i], max(0, (left - last) // lengths[i]))
            take[i] += more
            left -= more * lengths[i]
    # reachable sums as the bits of an integer; counts are split into powers of two
    items, reach = [], [1]
    full = (1 << (left + 1)) - 1
    for i in reversed(order):
        spare, k = min(counts[i] - take[i], left // lengths[i]), 1
        while spare > 0 and not reach[-1] >> left & 1:
            k = min(k, spare)
            items.append((i, k))
            reach.append((reach[-1] | reach[-1] << lengths[i] * k) & full)
            spare, k = spare - k, 2 * k
    at = reach[-1].bit_length() - 1
    for (i, k), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= lengths[i] * k
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, seed: int = 17) -> DataFrame:
    """docs with columns size, source_size, target (long, long, double) and taken (long): the
    words of each document that the mix takes, 0, 1 or 2 times its size.

    Sources in order of code points, null last, have the weights in turn. A source's taken words
    are its target rounded, or the nearest sum below that whole documents can make, as far as
    fit() finds it. A null or
    blank text has size 0 and is never taken. Repeated rows count each for itself; which of
    them is taken is not told apart. Columns of these names that docs already has are replaced.
    An empty table gives an empty result.
    """
    mine = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in mine]
    sized = docs.select(*kept).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    small = save(sized.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), "size"))
    chosen = save(choose(small, weights, share, seed))
    drop(small)
    # repeated doc_ids: the k-th row of one (doc_id, source, size) has the k-th choice
    order = Window.partitionBy("doc_id", "_s", "size")
    left = sized.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    twice = chosen.groupBy("doc_id", "_s", "size").count().where("count > 1").limit(1)
    right = chosen.withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))).drop("doc_id")
    on = ["_id", "_s", "size"]
    if not twice.isEmpty():
        left = left.withColumn("_k", F.row_number().over(order.orderBy("text")))
        right = right.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_s", "size").orderBy(F.desc("taken"))))
        on = [*on, "_k"]
    return left.join(right, on).select(*kept, *mine)


def choose(small: DataFrame, weights: tuple[int, ...], share: float, seed: int) -> DataFrame:
    """(doc_id, _s, size, source_size, target, taken) from (doc_id, _s, size)."""
    totals = {r["_s"]: int(r["n"]) for r in small.groupBy("_s").agg(F.sum("size").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s == "", s))
    goal = dict(zip(names, targets([totals[s] for s in names], weights, share), strict=True))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        s, rows = rows["_s"].iloc[0], rows.sort_values("size")
        budget = round(goal[s])
        passes = min(2, budget // totals[s]) if totals[s] else 0
        take = fit(rows["size"].tolist(), rows["n"].tolist(), budget - passes * totals[s])
        return rows.assign(take=take, passes=passes, source_size=totals[s], target=goal[s])[["_s", "size", "take", "passes", "source_size", "target"]]

    lengths = small.where("size > 0").groupBy("_s", "size").agg(F.count("*").alias("n"))
    plans = lengths.groupBy("_s").applyInPandas(plan, "_s string, size long, take long, passes long, source_size long, target double")
    # rank by hash within a length, hash range by hash range, so that no length is sorted whole
    hashed = small.where("size > 0").withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_b", F.shiftrightunsigned("_h", 54))
    before = Window.partitionBy("_s", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = hashed.groupBy("_s", "size", "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.join(plans, ["_s", "size"]).drop("_n")
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "size", "_b").orderBy("_h", "doc_id")))
    some = ranked.join(ranges, ["_s", "size", "_b"]).withColumn("taken", F.col("size") * (F.col("passes") + (F.col("_r") + F.col("_before") <= F.col("take")).cast("long")))
    sources = small.sparkSession.createDataFrame([(s, totals[s], goal[s]) for s in names], "_s string, source_size long, target double")
    none = small.where("size = 0").join(sources, "_s").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "_s", "size", "source_size", "target", "taken"]
    return some.select(*columns).unionByName(none.select(*columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    out = mix(docs, **options).where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return out.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    small = save(docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), size.alias("size")))
    return choose(small, (3, 1, 2), 1.5, 17).drop("_s")
