"""Conversation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chat_labels(convs: DataFrame) -> DataFrame:
    """A line of mark, time, platform and user for each conversation."""
    user = F.coalesce(F.nullif("user_name", F.lit("")), "user_id", F.lit("?"))
    mark = F.when(F.col("converted"), "✓").otherwise("✗")
    line = F.format_string("[%s] %s  %s  %s", mark, F.date_format("created", "yyyy-MM-dd HH:mm"), F.coalesce("platform", F.lit("?")), F.substring(user, 1, 22))
    return convs.select("conversation_id", line.alias("label"))


def conversation_list(convs: DataFrame, annotations: DataFrame | None = None, converted: bool | None = None, unannotated: bool = False, hide_low_quality: bool = False, intervention: bool = False) -> DataFrame:
    """Conversations that pass the chosen filters, newest first."""
    out = convs
    if converted is not None:
        out = out.where(F.col("converted") == converted)
    if hide_low_quality:
        out = out.where("not low_quality")
    if intervention:
        out = out.where("operator_intervention")
    if unannotated and annotations is not None:
        out = out.join(annotations.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return out.orderBy(F.desc("created"), "conversation_id")
