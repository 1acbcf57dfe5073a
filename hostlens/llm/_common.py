"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 19
#: Bytes of a record batch on its way to a Python worker.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session, as in tests, may do without: it gets a temporary folder, set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    elif not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Drop all tables that operators save inside, on leaving. To be put round an operator and the writing of its result,
    which reads them."""
    _scopes.append([])
    try:
        yield
    finally:
        dropped(spark, _scopes.pop())


def saved(df: DataFrame, what: str = "table", into: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors.

    ``into`` gets the folder's name, for ``dropped``; else it goes at the end of the ``tables_dropped`` that it is in, if any.
    """
    folder = shared_dir(df.sparkSession)
    path = f"{folder}/{what}"
    df.write.parquet(path)
    if into is not None:
        into.append(path)
    elif _scopes:
        _scopes[-1].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Remove saved tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that are over and saved.

    It does so when the driver's garbage is collected, in Python and in the JVM, which by itself may take half an hour.
    """
    for _ in range(2):  # what the first round frees lets go of the rest
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Broadcast a saved table where it is counted to be small; else Spark joins it as it does any table."""
    return F.broadcast(rows) if rows.count() <= most else rows


def partitions(df: DataFrame, least: int = 8) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows with at most that many bytes in a string column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits (wraps around)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in small batches, giving freed memory back when a partition ends.

    Spark limits a batch by rows, and by 64 MB: with long texts several of these per task, in the JVM and in Python.
    The session's limit is lowered for that, unless it is set already.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(tidied(run), schema)


def tidied(run: Callable) -> Callable:
    """A function of record batches that gives freed memory back when its partition ends: idle workers keep it else."""

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return outer


def trim() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
