"""Keeping a cache up to date from a stream of documents and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.cache import BuildCache


def apply_batch(cache: BuildCache, batch: DataFrame) -> dict | None:
    """Bring one batch into the cache: the last row of each path counts (by ``sequence``, if there), removals have ``removed``
    true. Returns the counts; None for an empty batch."""
    if batch.isEmpty():
        return None
    rows = batch.withColumn("removed", F.coalesce("removed", F.lit(False))) if "removed" in batch.columns else batch.withColumn("removed", F.lit(False))
    order = [F.desc("sequence")] if "sequence" in rows.columns else []
    last = F.row_number().over(Window.partitionBy("relative_path").orderBy(*order, F.desc(F.xxhash64(*[F.col(c).cast("string") for c in batch.columns]))))
    rows = rows.withColumn("_n", last).where("_n = 1").drop("_n")
    return cache.update(rows.where("NOT removed"), rows.where("removed").select("relative_path"))


def stream_updates(changes: DataFrame, cache: BuildCache, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a query that brings each micro-batch of ``changes`` into the cache. A batch that runs again changes nothing."""
    writer = changes.writeStream.foreachBatch(lambda batch, _: apply_batch(cache, batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
