"""Embedding columns as matrices, and blocks of vectors packed into one row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common
from tarn.llm.packing import BLOCKS_A_TASK

#: Scores are whole millionths, so that equal vectors score equally wherever they stand.
SCALE = 1_000_000


def usable(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of rows with an id and a vector of the prevailing length without nulls or NaN, and that length (0 if none)."""
    v = F.col(column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    common_size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = common_size["d"] if common_size else 0
    return rows.where(F.size("v") == size), size


def unit(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Vectors of a batch scaled to length 1; a zero vector stays zero."""
    flat = np.asarray(batch.column("v").flatten(), dtype=np.float64).reshape(-1, size)
    norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    return flat / np.where(norm > 0, norm, 1.0)[:, None]


def packed(rows: DataFrame, size: int, per_block: int, whole_ids: bool = False) -> DataFrame:
    """(block, ids, vectors): up to ``per_block`` unit vectors a row, in the order of each partition; ``whole_ids``: rows come
    sorted by id, and an id's vectors share a block unless there are more than ``per_block``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, held = TaskContext.get().partitionId() * BLOCKS_A_TASK, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([block]), pa.array([common.blob(np.concatenate(ids))]), pa.array([common.blob(np.concatenate(parts))])], ["block", "ids", "vectors"])

        last = None
        for batch in batches:
            n, at = batch.num_rows, 0
            new = np.asarray(batch.column("id"))
            starts = np.flatnonzero(np.concatenate((new[:1] != last, new[1:] != new[:-1])))
            while at < n:
                stop, full = min(n, at + per_block - held), n - at >= per_block - held
                if full and whole_ids:  # end the block where an id begins, unless one id fills it
                    fits = starts[(starts >= at + (not held)) & (starts <= stop)]
                    stop = int(fits[-1]) if len(fits) else stop
                if stop > at:
                    take = batch.slice(at, stop - at)
                    ids.append(np.asarray(take.column("id")))
                    parts.append(unit(take, size))
                    held += take.num_rows
                if full:
                    yield row()
                    block, ids, parts, held = block + 1, [], [], 0
                at = stop
            last = new[-1] if n else last
        if held:
            yield row()

    return rows.mapInArrow(emit, "block long, ids binary, vectors binary")


def opened(ids: bytes, vectors: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype="<i8"), np.frombuffer(vectors, dtype="<f8").reshape(-1, size)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all pairs in whole millionths."""
    return np.rint(a @ b.T * SCALE).astype(np.int32)
