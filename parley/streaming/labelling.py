"""Labelling that survives failing calls and stopped jobs.

What is to be asked waits in a queue, a table of small files; a stream takes some of these at a time, and each
micro-batch is answered and written before the next. A call that fails is written as a failure and hurts no other
row. A job that stops leaves the answers of all finished micro-batches; the next run first takes what the stream
had not finished, then asks what has no answer and has not failed too often.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import LABELER_CHARS

ASK = "role string, text string"
ANSWER = "role string, text string, raw string, error string"


def _answer(labeler: Callable[[str, str], str | None]):
    """Asks row by row. An exception, or null for an answer, is an error of its row alone."""

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw, error = [], []
            for role, text in zip(f["role"], f["text"], strict=True):
                try:
                    got = labeler(role, text)
                    raw.append(got)
                    error.append(None if got is not None else "no answer")
                except Exception as e:  # whatever a service raises belongs to this row
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"role": f["role"], "text": f["text"], "raw": pd.Series(raw, dtype=object, index=f.index), "error": pd.Series(error, dtype=object, index=f.index)})

    return ask


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def tries(spark: SparkSession, folder: str) -> DataFrame:
    """(role, text, raw, n_failed, last_error): one row for each text that was asked; raw is its answer or null."""
    if not _exists(spark, f"{folder}/answers"):
        return spark.createDataFrame([], ANSWER.replace("error string", "n_failed long, last_error string"))
    rows = spark.read.schema(f"{ANSWER}, batch string").parquet(f"{folder}/answers")
    return rows.groupBy("role", "text").agg(F.min("raw").alias("raw"), F.count("error").alias("n_failed"), F.max_by("error", F.col("batch")).alias("last_error"))


def _drain(spark: SparkSession, folder: str, labeler: Callable[[str, str], str | None], at_once: int) -> None:
    """Answers what is in the queue, one file a micro-batch. A micro-batch that is run again replaces what it wrote."""

    def commit(batch: DataFrame, number: int) -> None:
        # as many tasks as calls may run at a time
        answered = batch.repartition(at_once, F.xxhash64("role", "text")).mapInPandas(_answer(labeler), ANSWER)
        answered.write.mode("overwrite").parquet(f"{folder}/answers/batch={number:012d}")

    queue = spark.readStream.schema(ASK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queue")
    queue.writeStream.foreachBatch(commit).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def label_durably(turns: DataFrame, folder: str, labeler: Callable[[str, str], str | None], attempts: int = 3, at_once: int = 8, rows: int = 1000) -> DataFrame:
    """turns (with role and raw_text) with `raw`, the labeler's JSON for (role, text); turns without an answer are left
    out and stay unlabelled. Answers are kept in `folder`, shared by driver and executors, one folder a labeler.

    Equal (role, text) pairs are asked once, with LABELER_CHARS characters at most. `rows` answers are committed at a
    time, and up to `at_once` calls run at once. A call that raises or returns null leaves its row for the next run,
    until it has failed `attempts` times. After a stop only the micro-batch that was under way is asked again. Null
    roles or texts are not asked. One run at a time may use a folder.
    """
    spark = turns.sparkSession
    if _exists(spark, f"{folder}/queue"):
        _drain(spark, folder, labeler, at_once)
    text = F.substring("raw_text", 1, LABELER_CHARS)
    asked = turns.select("role", text.alias("text")).where("role is not null and text is not null").distinct()
    settled = tries(spark, folder).where((F.col("raw").isNotNull()) | (F.col("n_failed") >= attempts)).select("role", "text")
    todo = asked.join(settled, ["role", "text"], "left_anti")
    # files of `rows` rows: the parts are dealt by hash, so that their sizes are near it
    n = todo.count()
    if n:
        # written aside and moved in whole, so that a stopped run leaves no part of a queue
        aside, name = f"{folder}/aside-{uuid.uuid4().hex}", uuid.uuid4().hex
        todo.repartition(-(-n // rows), F.xxhash64("role", "text", F.lit(3))).write.option("maxRecordsPerFile", rows).parquet(aside)
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path(f"{folder}/queue"))
        for i, f in enumerate(x for x in system.listStatus(path(aside)) if x.getPath().getName().startswith("part-")):
            system.rename(f.getPath(), path(f"{folder}/queue/{name}-{i:06d}.parquet"))
        system.delete(path(aside), True)
        _drain(spark, folder, labeler, at_once)
    answers = tries(spark, folder).where("raw is not null").select("role", "text", "raw")
    return turns.withColumn("text", text).join(answers, ["role", "text"]).drop("text")
