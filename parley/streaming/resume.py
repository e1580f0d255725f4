"""The resumable load over a folder of transcripts: each micro-batch runs the batch operators and
appends conversations whose id is not in the table yet. No other streaming is offered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest


def load_new(spark: SparkSession, source: str, schema, table: str, checkpoint: str) -> None:
    """Loads what has come to `source` since the last run into the parquet table, then stops."""

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("conversation_id", ingest.conversation_id())
        try:
            loaded = spark.read.parquet(table)
        except Exception as e:  # the first run finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            loaded = rows.select("conversation_id").limit(0)
        new = ingest.new_only(rows, loaded)
        ingest.conversations(ingest.parse_messages(new)).write.mode("append").parquet(table)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
