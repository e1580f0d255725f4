"""Lineage cut through the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share. Where spark.checkpoint.dir names none, one of this machine serves a
    local session; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
    return f"{context.getCheckpointDir()}/step-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to a new shared folder and read again, which cuts its lineage. Shuffle files of the step
    are not needed again and go at once."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by stored() which no later step reads."""
    for df in tables:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
