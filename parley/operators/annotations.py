"""Annotations of conversations by tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tags(column: str = "failure_type") -> Column:
    """Tags of a JSON list; a bare string is one tag; null and empty have none."""
    c = F.col(column)
    is_list = F.expr(f"coalesce(schema_of_variant(try_parse_json({column})) like 'ARRAY%', false)")
    return F.when(is_list, F.from_json(c, "array<string>")).when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def latest(annotations: DataFrame) -> DataFrame:
    own = Window.partitionBy("conversation_id").orderBy(F.desc("annotated_at"), F.desc("id"))
    return annotations.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def tag_distribution(annotations: DataFrame, latest_only: bool = False) -> DataFrame:
    """Saves of each tag and their share; of each conversation's last save alone if asked."""
    rows = latest(annotations) if latest_only else annotations
    counts = rows.select(F.explode(tags()).alias("tag")).where("tag is not null and tag != ''").groupBy("tag").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 1)).orderBy(F.desc("n"), "tag")


def annotation_coverage(annotations: DataFrame, convs: DataFrame, exact: bool = True) -> DataFrame:
    """Saves, conversations with one, lost AI conversations, and the ratio of the last two."""
    distinct = F.countDistinct("conversation_id") if exact else F.approx_count_distinct("conversation_id")
    a = annotations.agg(F.count("*").alias("n_annotations"), distinct.alias("n_annotated"))
    c = convs.agg(F.count_if(F.col("is_ai") & F.col("outcome").isin("lost", "abandoned")).alias("n_lost"))
    return a.join(F.broadcast(c)).withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("n_annotated").cast("double"), "n_lost"), F.lit(0.0)), 6))


def merge_tags(annotations: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Annotations that change, with their new tags: sources become the target, once, in place."""
    new = F.array_distinct(F.transform(tags(), lambda t: F.when(t.isin(*sources), target).otherwise(t)))
    return annotations.withColumn("tags", new).where(~F.col("tags").eqNullSafe(tags()))


def merged_tag_list(names: DataFrame, sources: list[str], target: str) -> DataFrame:
    return names.where(~F.col("name").isin(*[s for s in sources if s != target]))


def unannotated_lost(convs: DataFrame, annotations: DataFrame) -> DataFrame:
    out = convs.where("not converted").join(annotations.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return out.orderBy(F.desc("created"), "conversation_id")


def tag_examples(annotations: DataFrame, convs: DataFrame, tag: str) -> DataFrame:
    some = annotations.where(F.array_contains(tags(), tag))
    return some.join(convs.select("conversation_id", "outcome"), "conversation_id").orderBy(F.desc("annotated_at"), F.desc("id"))
