"""What every operator here needs of Spark: shipping the package, shared folders, whole batches in bounded pieces."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that numpy works on at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 19


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; keep batches to them small, unless the session says otherwise."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        spark.conf.set(BATCH_BYTES, "2097152b")
    if getattr(context, "_loomspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / "loomspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(path))
    context._loomspark_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below spark.checkpoint.dir, or what SparkContext.setCheckpointDir names. Without either a local master, whose
    tasks run where the driver does, gets a temporary folder; on a cluster that is an error, because executors would not see each other's files."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomspark-checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder: what follows starts from the files, not from df's lineage. They go when the driver ends."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver's collector to drop shuffle files that no plan refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy() -> None:
    """Give freed memory back to the system: workers live on after a task, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most limit bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tidy()
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(offsets(text)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    buffer = text.buffers()[1]
    if buffer is None or not len(text):
        return np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(buffer, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each starts, with the end; null is empty."""
    if text.null_count:
        text = text.fill_null("" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    at = offsets(text)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]
