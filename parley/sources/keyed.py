"""A stored table that rows are merged into by key: copy on write by hash bucket.

Rows lie in folders by bucket of their key. A merge rewrites the buckets that it touches into a new folder and then
publishes a version, a small file that names the folder of each bucket. Readers take the newest version, so they see the
table before or after a merge and nothing between; a merge that fails leaves only files that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import scratch

#: The column that files are laid out by; tables must not have one of this name.
BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    _, at, fs = _fs(spark, f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    number = known[-1] if version is None else version
    return json.loads(spark.read.text(f"{path}/versions/{number:012d}.json", wholetext=True).first()[0]) | {"version": number}


def _publish(spark: SparkSession, path: str, state: dict) -> int:
    """Names a version by a rename that fails where another writer has taken the number."""
    number = state["version"] + 1
    hadoop, part, fs = _fs(spark, f"{path}/versions/{uuid.uuid4().hex}.part")
    out = fs.create(part)
    out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}), "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(part, hadoop.Path(f"{path}/versions/{number:012d}.json"), none)
    except Exception:
        fs.delete(part, False)
        raise
    return number


def _rows(spark: SparkSession, path: str, state: dict, buckets) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/{state['folders'][str(b)]}/{BUCKET}={b}" for b in buckets if str(b) in state["folders"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of the table, or the one asked for; the rows stay those of that version while others merge."""
    state = _state(spark, path, version)
    if state is None:
        raise ValueError(f"no version {'' if version is None else version} of a table at {path}")
    return _rows(spark, path, state, range(state["buckets"]))


def _latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the greatest by `order`, then by the other columns, as a partial aggregation, so that a key
    that holds most rows is not one task's work."""
    others = [c for c in rows.columns if c != key]
    ranked = order + [c for c in others if c not in order]
    best = rows.groupBy(key).agg(F.max(F.struct(*ranked)).alias("_b"))
    return best.select(*[F.col(key) if c == key else F.col("_b")[c].alias(c) for c in rows.columns])


def merge(path: str, new: DataFrame, key: str, order: str | None = None, instead_of: Column | None = None, reset: bool = False, buckets: int = 64) -> int:
    """Puts the rows of `new` into the table at `path`, made where there is none, and returns the version that has them.

    A new row takes the place of the stored one of its key, whatever their `order`; of new rows of one key the greatest by
    `order` stays, then by the other columns. A null key is a key like others. `instead_of` is a condition on stored rows:
    those that it holds for go first, unlike those it is null for. `reset` lets all stored rows go. Only buckets that hold
    rows which come or go are rewritten. Without such rows no version is made. The columns are those of the table; others,
    a missing one or another type are an error. Of two merges at a time the later to publish fails and can be run again.
    `buckets` is fixed when the table is made: so many that one's rows (table size / buckets) suit a few tasks.
    """
    spark = new.sparkSession
    state = _state(spark, path) or {"version": 0, "buckets": buckets, "key": key, "folders": {}, "schema": None}
    if BUCKET in new.columns:
        raise ValueError(f"a column named {BUCKET} is not allowed")
    if state["schema"] is not None:
        schema = StructType.fromJson(state["schema"])
        if state["key"] != key or {f.name: f.dataType for f in schema} != {f.name: f.dataType for f in new.schema}:
            raise ValueError("the key or the columns are not those of the table")
        new = new.select(*schema.names)
    else:
        state["schema"] = json.loads(new.schema.json())
        for f in state["schema"]["fields"]:
            f["nullable"] = True
    bucket = F.pmod(F.xxhash64(key), F.lit(state["buckets"])).cast("int").alias(BUCKET)
    # a table, so that the buckets found and the rows written are those of one run
    coming = scratch.stored(_latest(new, key, [order] if order else []))
    touched = {r[0] for r in coming.select(bucket).distinct().collect()}
    if reset:
        touched |= {int(b) for b in state["folders"]}
    elif instead_of is not None:
        old = _rows(spark, path, state, range(state["buckets"]))
        touched |= {r[0] for r in old.where(instead_of).select(bucket).distinct().collect()}
    if not touched:
        return state["version"]
    out = coming
    if not reset:
        old = _rows(spark, path, state, sorted(touched))
        stays = old if instead_of is None else old.where(~F.coalesce(instead_of, F.lit(False)))
        keys = coming.select(F.col(key).alias("_k"))
        out = stays.join(keys, F.col(key).eqNullSafe(F.col("_k")), "left_anti").unionByName(coming)
    folder = f"rows/{uuid.uuid4().hex}"
    # few files a bucket; a large bucket is split
    out.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    hadoop, at, fs = _fs(spark, f"{path}/{folder}")
    made = {s.getPath().getName().split("=")[1] for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{BUCKET}=")}
    kept = {b: f for b, f in state["folders"].items() if int(b) not in touched}
    return _publish(spark, path, state | {"folders": kept | {b: folder for b in made}})


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the versions before the newest `keep` and the folders of rows that none of the rest names; returns how many
    folders went. Not while a merge or a reader of an older version is at work."""
    known = _versions(spark, path)
    if not known:
        return 0
    gone, stay = known[: -max(1, keep)], known[-max(1, keep) :]
    named = {f for v in stay for f in _state(spark, path, v)["folders"].values()}
    hadoop, at, fs = _fs(spark, path)
    for v in gone:
        fs.delete(hadoop.Path(f"{path}/versions/{v:012d}.json"), False)
    unnamed = [s.getPath() for s in fs.listStatus(hadoop.Path(f"{path}/rows")) if f"rows/{s.getPath().getName()}" not in named]
    for p in unnamed:
        fs.delete(p, True)
    return len(unnamed)
