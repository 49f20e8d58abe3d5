"""What several corpus operators share: tables, the shared folder, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch sent to a Python worker, where the session has Spark's default.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: ASCII white space that separates words everywhere in this package.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        named = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept as a reliable checkpoint; for small rows that are read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as compressed Parquet in the shared folder; for wide rows, read again by column.

    The table lasts as long as the session; it is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        return


def _released() -> None:
    """Gives freed memory back, so that idle workers of one stage leave room for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes (texts vary widely in length) and memory given back after each task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) in (None, _BATCH_DEFAULT):
        conf.set(_BATCH, str(BATCH_BYTES))

    def lean(batches):
        yield from run(batches)
        _released()

    return df.mapInArrow(lean, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets into them; a null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[at[0] : at[-1]] if len(at) else everything[:0], at - at[0]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; a larger row stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[0] : starts[0] + lengths[0]], then the next such run, and so on, as one array."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return values[at]
