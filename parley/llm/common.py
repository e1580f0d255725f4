"""Shared helpers: scratch tables, Arrow text access, word and shingle hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text hashed at a time inside a task; one longer text is a chunk of its own.
CHUNK = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of text whose entries make a part on average, and parts of a task.
PART, PARTS = 2 << 20, 16


def deal(docs: DataFrame) -> tuple[int, int]:
    """How many tasks and parts the bytes of a column text ask for. Packed entries are dealt to parts,
    parts to tasks with repartition(tasks, "part").sortWithinPartitions("part"), and a task works on one
    part at a time, so that its memory does not depend on the input."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (PART * PARTS) + 1)
    return tasks, tasks * PARTS


def by_part(batches):
    """Of rows in the order of their first column, the part: the other columns of one part after the other."""
    part, held = None, []
    for b in batches:
        for p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != part:
                if held:
                    yield held
                part, held = p, []
            held.append(row)
    if held:
        yield held


def save(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder that the session names in spark.checkpoint.dir.
    Without one, a folder of this machine serves a local session; on a cluster it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    # shuffle files of a finished step are not needed again; the session's own setting comes back
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
    """Deletes scratch tables made by save() which no later step reads."""
    for df in tables:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


# --- text in Arrow batches -------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges of rows with about `size` bytes of text each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


# --- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to a few chunks' length."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    out = []
    with np.errstate(over="ignore"):
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    if n <= 4 * CHUNK:
        _powers["up"], _powers["down"] = out
    return out[0], out[1]


def byte_values(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold:
        values[65:91] = values[97:123]
    return values


_FOLDED, _PLAIN = byte_values(True), byte_values(False)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True):
    """Start, end, row and 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a chunk of texts."""
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _PLAIN)[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes


_ODD = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int):
    """Hash and row of each run of `width` words; a row with fewer words has them all as one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    m = len(hashes) - width + 1
    if m > 0:
        whole = rows[:m] == rows[width - 1 :]
        value = np.zeros(m, np.uint64)
        for j in range(width):
            value += hashes[j : j + m] * _ODD[j]
        value, at = mix(value[whole]), rows[:m][whole]
    else:
        value, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            extra[has] += hashes[first[short[has]] + j] * _ODD[j]
        extra = mix(extra + counts[short].astype(np.uint64))
        value, at = np.concatenate((value, extra)), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        value, at = value[order], at[order]
    return value, at


def shingle_sets(column: pa.Array, width: int):
    """For each text in turn, its sorted distinct shingle hashes."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        off = offsets[lo : hi + 1] - offsets[lo]
        _, _, rows, hashes = words(data[offsets[lo] : offsets[hi]], off)
        value, at = shingles(hashes, rows, hi - lo, width)
        cut = np.searchsorted(at, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield np.unique(value[a:b])


def set_hash(values: np.ndarray) -> int:
    """Signed 64-bit hash of a set of hashes (order does not matter)."""
    with np.errstate(over="ignore"):
        total = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
