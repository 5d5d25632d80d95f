"""Helpers that the operators of this subpackage share: working folders, Arrow text buffers, vectorised hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    folder of its own, removed at exit; on a cluster that is an error, since executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="weftlink-"))
            atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
        found = "file://" + _OWN_DIR[0]
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, on storage that
    outlives an executor. The folder's owner removes it when the job is over."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/weftlink-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """``run``, a function over Arrow batches, so that a task's freed memory goes back to the system when it ends: a
    Python worker lives through many stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), least)


def dealt(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` integers that hash partitioning to ``n`` partitions deals one to each: bucket names that leave no task with
    several buckets while others have none. At most a few thousand; a rule, not data."""
    tried = spark.range(0, n * (int(np.log(n + 1)) + 12), 1, 1).select(F.col("id").cast("int").alias("v"))
    rows = tried.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).orderBy("p").collect()
    spare = iter(range(-1, -n - 1, -1))  # a partition that no number tried falls into goes without a bucket of its own
    found = {r.p: r.v for r in rows}
    return np.array([found[k] if k in found else next(spare) for k in range(n)], np.int32)


def text_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) under internal names, null text as empty; other columns are left behind."""
    return docs.select(F.col(id_col).alias("wl_id"), F.coalesce(F.col(text_col), F.lit("")).alias("wl_text"))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values, without a copy."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20):
    """Row ranges of a batch with at most ``most`` bytes of text each (a longer text is a range of its own)."""
    _, off = buffers(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a rule: the finaliser over a counter."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each pair."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, sizes)
