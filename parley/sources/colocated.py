"""Tables bucketed and sorted by one key, so that joins, windows and aggregations by it read them without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, ORDER = "conversation_id", "turn_index"


def write(df: DataFrame, name: str, path: str, buckets: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """df as table `name` in the folder `path`, which is replaced: `buckets` files by hash of the key, sorted by key and
    `order` where df has it. Tables that are to be joined need the same number; a file should hold a few hundred
    megabytes. A key is never split, so a bucket holds at least its largest key."""
    within = [key, order] if order in df.columns else [key]
    spread = df.repartition(buckets, key)
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(*within).saveAsTable(name)
    return df.sparkSession.table(name)


def attach(spark: SparkSession, name: str, path: str, buckets: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """A folder that `write` made as table `name` of a session whose catalog does not know it."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    within = f"`{key}`, `{order}`" if order in schema.names else f"`{key}`"
    spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by ({within}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def keys_by_bucket(table: DataFrame, buckets: int, key: str = KEY) -> DataFrame:
    """(bucket, n_rows, n_keys, largest): rows and keys of each bucket, and the rows of its largest key, to choose their number."""
    each = table.groupBy(key).agg(F.count("*").alias("n"))
    return each.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max("n").alias("largest"))
