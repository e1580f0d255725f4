"""Transcript files in, tables and exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "chat_id string, user_id string, user_name string, from_messenger string, created string, messages string"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and a quoted JSON column over several lines. Such a file is not split,
    so ship many of them, or convert them once."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').schema(RAW).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None) -> None:
    """A full rebuild by default; with a partition column, only the partitions in df are replaced."""
    writer = df.write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8."""
    df.write.mode("overwrite").json(path)


def with_ordinal(raw: DataFrame) -> DataFrame:
    """A place in file order for rows that have none; stable as long as the files are."""
    return raw.withColumn("ordinal", F.monotonically_increasing_id())
