"""Totals and breakdowns. Every grouping key has few values or is pre-aggregated; windows run
on aggregated rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _percent(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))


def kpi_overview(convs: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    out = convs.agg(
        F.count("*").alias("total"), n(F.col("outcome") == "closed").alias("ai_closed"), n(F.col("outcome") == "human-closed").alias("human_closed"),
        n(F.col("outcome") == "lost").alias("lost"), n(F.col("outcome") == "abandoned").alias("abandoned"), n(F.col("is_ai")).alias("ai_total"),
    )
    return out.withColumns({
        "conversion_pct": F.round(_percent(F.col("ai_closed") + F.col("human_closed"), F.col("total")), 6),
        "takeover_pct": F.round(_percent(F.col("human_closed"), F.col("total")), 6),
        "ai_close_pct": F.round(_percent(F.col("ai_closed"), F.col("ai_total")), 6),
    })


def loss_rate(convs: DataFrame) -> DataFrame:
    out = convs.where("is_ai").agg(F.count("*").alias("total"), F.count_if(F.col("outcome").isin("lost", "abandoned")).alias("lost"))
    return out.withColumn("loss_rate", F.round(_percent(F.col("lost"), F.col("total")), 6))


def outcome_breakdown(convs: DataFrame) -> DataFrame:
    counts = convs.groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 1)).orderBy(F.desc("n"), "outcome")


def platform_breakdown(convs: DataFrame) -> DataFrame:
    out = convs.where("platform is not null").groupBy("platform").agg(F.count("*").alias("total"), F.count_if("converted").alias("converted"))
    return out.withColumn("rate", F.bround(F.col("converted") / F.col("total") * 100, 1)).orderBy("platform")


#: Period ends by granularity, step from one to the next, and label format.
_DAY = lambda c: F.to_date(c)
PERIODS = {
    "daily": (lambda c: _DAY(c), "interval 1 day", "MMM dd"),
    "weekly": (lambda c: F.next_day(F.date_sub(_DAY(c), 1), "MON"), "interval 7 day", "'Week of 'MMM dd"),
    "monthly": (lambda c: F.last_day(_DAY(c)), "interval 1 month", "MMM yyyy"),
}


def by_period(convs: DataFrame, granularity: str) -> DataFrame:
    """Totals of each day, week ending on Monday, or month, without gaps between first and last."""
    end, step, label = PERIODS[granularity]
    facts = convs.where("created is not null").groupBy(end(F.col("created")).alias("period")).agg(F.count("*").alias("total"), F.count_if("converted").alias("converted"))
    bounds = facts.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    if granularity == "monthly":
        all_ = bounds.select(F.explode(F.expr(f"sequence(trunc(a, 'month'), trunc(b, 'month'), {step})")).alias("d")).select(F.last_day("d").alias("period"))
    else:
        all_ = bounds.select(F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    out = all_.join(facts, "period", "left").select("period", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("converted", F.lit(0)).alias("converted"))
    return out.withColumns({"rate": F.round(_percent(F.col("converted"), F.col("total")), 6), "label": F.date_format("period", label)})


def drop_off_distribution(convs: DataFrame) -> DataFrame:
    some = convs.where("is_ai and outcome in ('lost', 'abandoned') and drop_off_turn is not null")
    return some.groupBy("drop_off_turn").agg(F.count("*").alias("n")).orderBy("drop_off_turn")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def histogram(df: DataFrame, column: str, by: str) -> DataFrame:
    """How often each value of a column occurs, for each value of another."""
    return df.groupBy(by, column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max; approximate quartiles hold a
    sketch instead of the column's distinct values."""
    q = (lambda p: F.percentile(column, F.lit(p))) if exact else (lambda p: F.percentile_approx(column, p, 10_000).cast("double"))
    return df.agg(
        F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"), F.min(column).alias("low"),
        q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(column).alias("high"),
    )


def filter_slice(convs: DataFrame, platform: str | None = None, first: str | None = None, last: str | None = None, ai_only: bool = False) -> DataFrame:
    """Rows of one platform whose date is between two, both included; the bounds are on the
    timestamp itself so that they prune files."""
    out = convs
    if platform is not None:
        out = out.where(F.col("platform") == platform)
    if first is not None:
        out = out.where(F.col("created") >= F.to_timestamp(F.lit(first)))
    if last is not None:
        out = out.where(F.col("created") < F.date_add(F.to_date(F.lit(last)), 1).cast("timestamp"))
    return out.where("is_ai") if ai_only else out


def filter_domain(convs: DataFrame) -> DataFrame:
    """Each platform, with the first and last date of all rows."""
    span = convs.agg(F.min(F.to_date("created")).alias("first_date"), F.max(F.to_date("created")).alias("last_date"))
    return convs.where("platform is not null").select("platform").distinct().join(F.broadcast(span)).orderBy("platform")
