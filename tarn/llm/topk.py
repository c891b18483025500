"""Exact top-k search by distributed histogram selection.

Rows whose id is divisible by ``every`` are queries, against all other rows. Scores are whole millionths of the cosine. A pass scores all pairs of blocks and
counts, for each query, how many scores fall into each of BINS bins of the range that is known to hold its kth score; the
counts, added up over blocks, name the one bin that holds it, and the next pass divides that bin. Passes end when every
query's candidates (the scores in its bin and above) are few, or its bin is one value wide. A last pass keeps the scores not
below the bin and ranks them, ties by id. Only histograms move, never scores, and no query is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import common
from tarn.llm.packing import pack, unpack
from tarn.llm.vectors import SCALE, opened, packed, scores, usable

K, BINS, BLOCK = 10, 128, 2048
#: Ids divisible by this are the queries.
EVERY = 20
#: Candidates beyond k with which a query needs no further pass (they are all ranked).
SLACK = 54
_LOW, _NONE = -SCALE, -SCALE - 1


def _pairs(batches: Iterator[pa.RecordBatch], size: int):
    """Each pair of blocks: query row, query ids, other ids, scores, one for each other id (its best); a row's score with
    its own id is set below all others."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, q = opened(row["ids"], row["vectors"], size)
            others, v = opened(row["other_ids"], row["other_vectors"], size)
            s = scores(q, v)
            lead = np.flatnonzero(np.concatenate(([True], others[1:] != others[:-1])))  # ids come sorted
            if len(lead) < len(others):
                others, s = others[lead], np.maximum.reduceat(s, lead, axis=1)
            at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
            own = np.flatnonzero(others[at] == ids)
            s[own, at[own]] = _NONE
            yield row, ids, others, s


def _histograms(size: int, width: int, span: int):
    """Counts by bins of ``width`` of the scores from a query's low to less than ``span`` above it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row, ids, _, s in _pairs(batches, size):
            low = np.frombuffer(row["low"], dtype="<i4")
            far = s - low[:, None]
            i, j = np.nonzero((far >= 0) & (far < span) & (s > _NONE))
            h = np.bincount(i * BINS + far[i, j] // width, minlength=len(ids) * BINS)
            sums[row["block"]] = sums[row["block"]] + h if row["block"] in sums else h
        for block, h in sums.items():
            yield pa.record_batch([pa.array([block]), pa.array([pack(h)])], ["block", "h"])

    return emit


def _narrow(k: int, width: int):
    def narrow(state: pa.Table, found: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        low, above = np.frombuffer(row["low"], dtype="<i4").copy(), np.frombuffer(row["above"], dtype="<i8").copy()
        h = sum((unpack(x).astype(np.int64) for x in found["h"].to_pylist()), np.zeros(len(low) * BINS, np.int64)).reshape(-1, BINS)
        down = np.cumsum(h[:, ::-1], axis=1) + above[:, None]
        reached = down >= k
        last = np.where(reached.any(axis=1), reached.argmax(axis=1), BINS - 1)  # fewer than k others: all are wanted
        rows = np.arange(len(low))
        candidates = down[rows, last]
        above = np.where(last > 0, down[rows, last - 1], above)
        low = low + (BINS - 1 - last) * width
        return pa.table({"block": pa.array([row["block"]]), "low": pa.array([common.blob(low.astype("<i4"))]), "above": pa.array([common.blob(above)]), "most": pa.array([int(candidates.max())])})

    return narrow


def _final(size: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, others, s in _pairs(batches, size):
            low = np.frombuffer(row["low"], dtype="<i4")
            i, j = np.nonzero((s >= low[:, None]) & (s > _NONE))
            if len(i):
                yield pa.record_batch([pa.array(ids[i]), pa.array(others[j]), pa.array(s[i, j])], ["query_id", "neighbor_id", "millionths"])

    return emit


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, score): for each row whose id is divisible by ``every`` its k nearest others of all
    rows by cosine, all of them if there are fewer.

    Rows of the same id are not each other's neighbours; of repeated rows each is a query's neighbour once (one id, best
    score). Ties go to the smaller id. Rows without id, with a null, empty, NaN or infinite vector or one of another length
    than most have are left out; a zero vector scores 0. Tables of no or one row give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_column, column)
    schema = "query_id long, rank int, neighbor_id long, score double"
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.distinct()
    # vectors of an id share a block, where the best counts, but for an id with more than fill one: then k times its blocks
    sorted_ = rows.repartition("id").sortWithinPartitions("id")
    every_block = common.staged(packed(sorted_, size, BLOCK, whole_ids=True), "vectors")
    blocks = common.staged(packed(sorted_.where(F.col("id") % every == 0), size, BLOCK), "queries")
    most = rows.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    deep = k * -(-most // BLOCK)
    others = every_block.select(F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column("ids").to_pylist()]
            low, above = [common.blob(np.full(m, _LOW, "<i4")) for m in sizes], [common.blob(np.zeros(m, "<i8")) for m in sizes]
            yield pa.record_batch([batch.column("block"), pa.array(low, pa.binary()), pa.array(above, pa.binary()), pa.array([0] * len(sizes), pa.int64())], ["block", "low", "above", "most"])

    state_schema = "block long, low binary, above binary, most long"
    state = blocks.select("block", "ids").mapInArrow(start, state_schema)
    span = 2 * SCALE + 1
    width = -(-span // BINS)
    while True:
        pairs = blocks.join(state.select("block", "low"), "block").crossJoin(others)
        found = pairs.mapInArrow(_histograms(size, width, span), "block long, h binary")
        state = common.staged(state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_narrow(deep, width), state_schema), "state")
        if width == 1 or (state.agg(F.max("most")).first()[0] or 0) <= deep + SLACK:
            break
        span, width = width, -(-width // BINS)
    kept = blocks.join(state.select("block", "low"), "block").crossJoin(others).mapInArrow(_final(size), "query_id long, neighbor_id long, millionths int")
    kept = kept.groupBy("query_id", "neighbor_id").agg(F.max("millionths").alias("millionths"))
    order = Window.partitionBy("query_id").orderBy(F.desc("millionths"), "neighbor_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbor_id", (F.col("millionths") / F.lit(float(SCALE))).alias("score"))


SQL = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v) * 1000000)::INT AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT query_id, neighbor_id, m, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, neighbor_id)::INT AS rank FROM s)
SELECT query_id, rank, neighbor_id, m / 1000000.0::DOUBLE AS score FROM r WHERE rank <= 10
"""
