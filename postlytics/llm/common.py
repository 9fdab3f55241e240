"""Helpers shared by the operators: the shared scratch folder, Arrow text
buffers and the held-out rule."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlytics.session import ensure_checkpoint_dir

# fixed value: the white space of the word rule, space and the controls 09-0D
WHITE = r"[\x20\x09-\x0D]"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder of ``spark.checkpoint.dir``, which driver
    and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back: the
    lineage is cut and later readers prune columns.  A lost executor loses
    nothing, as the files are shared.  The files stay until ``drop_scratch``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``store`` has written in this session; results that still
    read it must have been written elsewhere before."""
    root = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        if not status.getPath().getName().startswith("rdd-"):
            fs.delete(status.getPath(), True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def byte_rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the row bounds in it
    (n + 1 offsets).  No copy; a null is an empty row."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes of column ``name``; a
    longer row comes alone."""
    _, bounds = byte_rows(batch, name)
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


_kept: dict = {}


def worker_table(name: str, make: Callable[[], object]) -> object:
    """What ``make`` builds, kept by the Python worker for its next tasks.  A worker
    keeps one table: another operator's goes first, so that the stages of one
    application do not add up in reused workers."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def free_tables() -> None:
    """Drop the table that this Python worker keeps."""
    _kept.clear()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts
    stays within a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
