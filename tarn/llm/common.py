"""Shared pieces of the training-data operators: scratch tables, size-checked joins, exact selection."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column key table that may be broadcast (about 64 MB as a hash relation); above it, joins shuffle.
BROADCAST_ROWS = 2_000_000

#: Bytes of text that are cut into tokens at a time; the arrays for it are some 50 times as large.
SLICE = 500_000

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only where the session names none (tests, a notebook on one machine) a temporary folder is set up and named there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarn-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM is gone already
            pass

    atexit.register(drop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join on ``key``; ``small`` is broadcast only if a count shows at most ``limit`` rows, else both sides shuffle."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), key, how)
    return big.join(small.hint("shuffle_hash"), key, how)


def uniform(seed: int, *columns: str) -> Column:
    """A reproducible number in (0, 1) for each row, a function of ``seed`` and the given columns alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def kth_largest(df: DataFrame, score: str, k: int, bins: int = 4096) -> float | None:
    """The exact kth largest value of a double column (nulls and NaN left out); None if there are fewer than ``k``.

    Each pass counts rows per histogram bin and keeps the bin that holds the kth value, so only ``bins`` counts reach the
    driver; the lowest and highest values fall into different bins, so every pass narrows the range.
    """
    values = df.select(F.col(score).cast("double").alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
    if k < 1 or n < k:
        return None
    lo, hi, above = low, high, 0
    while lo < hi:
        place = F.floor((F.col("s") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
        rows = (
            values.where(F.col("s").between(lo, hi))
            .groupBy(F.least(place, F.lit(bins - 1)).alias("b"))
            .agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
            .collect()
        )
        for row in sorted(rows, key=lambda r: -r["b"]):
            if above + row["n"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
    return lo


#: glibc's mallopt: bytes from which a block is mapped by itself; free bytes at the heap's end that are kept; arenas.
_MALLOPT = ((-3, 32 << 20), (-1, 32 << 20), (-8, 1))
_lean = False


def lean() -> None:
    """Have this process give memory back as it frees it: large blocks are mapped one by one, and Arrow keeps no pool."""
    global _lean
    if not _lean:
        _lean = True
        pa.set_memory_pool(pa.system_memory_pool())
        if sys.platform == "linux":
            libc = ctypes.CDLL(None)
            for option, value in _MALLOPT:
                getattr(libc, "mallopt", lambda *_: None)(option, value)


def trim() -> None:
    """Give memory that this process no longer uses back to the system; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over a partition in a ``lean`` process, with ``trim`` after it."""

    def run(batches: Iterator) -> Iterator:
        lean()
        yield from task(batches)
        trim()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``budget`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        part = np.concatenate(([0], np.cumsum(sizes)[:-1])) // budget
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def blob(array: np.ndarray) -> bytes:
    """Bytes of a numeric array in little-endian order."""
    return np.ascontiguousarray(array).astype(array.dtype.newbyteorder("<"), copy=False).tobytes()


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number that each row has."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the next ``counts[i]`` items of ``values`` as bytes."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(np.asarray(counts, dtype=np.int64) * width, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob(values))])


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without its nulls' content, and row offsets from 0."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=width, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]
