"""Large transcript files, read in parallel and numbered by their place.

A quoted field may hold line feeds, so a record cannot be told from one byte range alone. The text reader splits
files by range into lines; each range reports its quotes and the records it would begin when entered outside or
inside quotes. Running sums over these few rows give every range its state and its first record's number, and a
second read puts the lines of a record together, also across ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import RAW

_LINES = "file string, block long, i long, value string, inside boolean, outer long, inner long"
_RANGES = "file string, block long, quotes long, outer long, inner long"


def _numbered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines with their place in the range, whether quotes opened in the range are open before them, and how many
    lines up to them began outside (outer) and inside (inner) of these. Lines of a range come one after the other."""
    now, i, quotes, outer, inner = None, 0, 0, 0, 0
    for f in frames:
        keys = list(zip(f["file"], f["block"], strict=True))
        cuts = [0, *[j for j in range(1, len(keys)) if keys[j] != keys[j - 1]], len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
            if lo == hi:
                continue
            if keys[lo] != now:
                now, i, quotes, outer, inner = keys[lo], 0, 0, 0, 0
            part = f.iloc[lo:hi]
            n = part["value"].str.count('"').to_numpy(np.int64)
            after = quotes + np.cumsum(n)
            inside = (after - n) % 2 == 1
            out = part.assign(i=np.arange(i, i + len(part)), inside=inside, outer=outer + np.cumsum(~inside), inner=inner + np.cumsum(inside))
            i, quotes, outer, inner = i + len(part), int(after[-1]), int(out["outer"].iloc[-1]), int(out["inner"].iloc[-1])
            yield out[["file", "block", "i", "value", "inside", "outer", "inner"]].assign(quotes=after)


def _lines(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _numbered(frames):
        yield f.drop(columns="quotes")


def _ranges(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for f in _numbered(frames):
        end = f.iloc[[-1]][["file", "block", "quotes", "outer", "inner"]]
        if last is not None and (last["file"].iloc[0], last["block"].iloc[0]) != (end["file"].iloc[0], end["block"].iloc[0]):
            yield last
        last = end
    if last is not None:
        yield last


def read_split(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Rows of CSV files with a header, by position, with `ordinal`, the place of a record from 0: files in order of their
    paths, records in order within. It does not depend on how files are split, or on how many files the same records are
    dealt to in order. Quotes are doubled within quoted fields, which may hold line feeds, CRLF and commas; a record may
    end in CRLF. Blank lines between records are skipped, as are empty files; a record with too few fields has nulls.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = text.mapInPandas(_ranges, _RANGES)
    # one row a range from here on
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("open", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    ranges = ranges.withColumn("begun", F.when(F.col("open"), F.col("inner")).otherwise(F.col("outer")))
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("begun").over(before), F.lit(0))).select("file", "block", "open", "skip")
    lines = text.mapInPandas(_lines, _LINES).join(ranges, ["file", "block"])
    number = F.col("skip") + F.when(F.col("open"), F.col("inner")).otherwise(F.col("outer"))
    parts = F.array_sort(F.collect_list(F.struct("block", "i", "value")))
    records = lines.groupBy("file", number.alias("record")).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))
    # the first record is the header; blank lines have numbers too, so that places are counted without them afterwards
    records = records.where("record > 1").withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
    fields = F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    return _placed(records.select("file", "record", fields.alias("r"))).select("ordinal", "r.*")


def _placed(records: DataFrame, size: int = 1 << 16) -> DataFrame:
    """records with `ordinal`, their number from 0 by file and record: counts by file and stretch of `size` records and
    their running sums, then ranks within each stretch."""
    stretch = F.floor(F.col("record") / size)
    counts = records.groupBy("file", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    whole = Window.orderBy("file", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(whole), F.lit(0))).drop("n")
    own = Window.partitionBy("file", "stretch").orderBy("record")
    return records.withColumn("stretch", stretch).join(counts, ["file", "stretch"]).withColumn("ordinal", F.col("first") + F.row_number().over(own) - 1)
