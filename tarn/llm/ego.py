"""Embedding near-duplicates by epsilon grid order join.

Vectors are scaled to length 1 and turned onto their principal axes. In the leading ones, space is cut into cells as wide as
the distance epsilon that the least similarity allows; vectors are sorted by cell, one axis after another, and the sequence is
cut into blocks. Blocks meet if their cells on the first axis are no more than one apart and their bounding boxes no more than
epsilon; two blocks are joined by halving the longer interval, dropping halves that are provably too far apart, until
intervals are short enough to compare all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common, graph
from tarn.llm.packing import BLOCKS_A_TASK
from tarn.llm.vectors import SCALE, opened, packed, scores, unit, usable

LEAST, AXES, BLOCK, SHORT = 0.9, 4, 2048, 256
#: Blocks on a side of the squares in which blocks are joined; a power of two.
SQUARE = 8


def epsilon(least: float) -> float:
    """Largest distance of unit vectors whose cosine, rounded to millionths, is ``least`` or more."""
    return float(np.sqrt(max(0.0, 2 - 2 * (least - 0.6 / SCALE)))) + 1e-9


def principal_axes(rows: DataFrame, size: int) -> np.ndarray:
    """Principal axes as columns, widest first. One matrix of moments comes from each task, whatever the rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([unit(batch, size), np.ones((batch.num_rows, 1))])
                m += x.T @ x
        yield pa.record_batch([pa.array(np.arange(m.size)), pa.array(m.reshape(-1))], ["i", "m"])

    sums = rows.mapInArrow(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).orderBy("i").toPandas().m.to_numpy()
    m = sums.reshape(size + 1, size + 1)
    mean = m[-1, :-1] / max(m[-1, -1], 1.0)
    _, axes = np.linalg.eigh(m[:-1, :-1] / max(m[-1, -1], 1.0) - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1])


def _box_gap(a: np.ndarray, b: np.ndarray) -> float:
    """Least possible squared distance of points of two sets of vectors, from their bounding boxes."""
    gap = np.maximum(0.0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap)


def _interval_join(a: np.ndarray, b: np.ndarray, same: bool, far: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b, and scores, of all pairs of at least ``least``; pairs of one sequence with itself come once."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, n = stack.pop()
        if i >= j or k >= n or (same and k + 1 > j and n <= i) or (same and n <= i):
            continue
        if not (same and i == k and j == n) and _box_gap(a[i:j], b[k:n]) > far:
            continue
        if max(j - i, n - k) <= SHORT:
            s = scores(a[i:j], b[k:n])
            x, y = np.nonzero(s >= least)
            if same:
                ok = x + i < y + k
                x, y = x[ok], y[ok]
            if len(x):
                yield x + i, y + k, s[x, y]
        elif same and i == k and j == n:
            m = (i + j) // 2
            stack += [(i, m, i, m), (i, m, m, j), (m, j, m, j)]
        elif j - i >= n - k:
            m = (i + j) // 2
            stack += [(i, m, k, n), (m, j, k, n)]
        else:
            m = (k + n) // 2
            stack += [(i, j, k, m), (i, j, m, n)]


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and pairs (a, b, similarity), a < b: a node stands for a vector, its members are the ids that have
    it, and two nodes are a pair if their cosine, rounded to millionths, is ``least`` or more.

    Repeated rows count once. Rows
    without id, with a null, empty, NaN or infinite vector or one of another length than most have are left out; a zero
    vector is like nothing. ``least`` must be above 0. Tables of no or one row give no pairs; other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and no more than 1")
    spark = vectors.sparkSession
    rows, size = usable(vectors, id_column, column)
    if not size:
        return spark.createDataFrame([], "id long, node long"), spark.createDataFrame([], "a long, b long, similarity double")
    zero = F.when(F.forall("v", lambda x: x == 0), F.col("id"))  # zero vectors are not even like each other
    names = common.staged(rows.select("id", F.xxhash64("v", zero).alias("one"), F.xxhash64(F.lit(1), "v", zero).alias("two"), "v"), "names")
    member, nodes = graph.contents(names, "v")
    return member, common.staged(_pairs(nodes.select(F.col("node").alias("id"), "v"), size, least), "pairs")


def classes(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links) of each id with a usable vector (see ``near_duplicates``): a link is another id whose cosine
    is ``least`` or more, equal vectors included; class_id is the smallest id that links connect with it."""
    return graph.classes(*near_duplicates(vectors, least, id_column, column)).withColumnRenamed("id", "vec_id")


def _pairs(rows: DataFrame, size: int, least: float) -> DataFrame:
    axes = principal_axes(rows, size)
    eps = epsilon(least)
    lead = min(AXES, size)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch, size) @ axes
                cells = np.floor(x[:, :lead] / eps).astype(np.int32)
                v = common.list_array(x.reshape(-1), np.full(len(x), size), pa.float64())
                yield pa.record_batch([batch.column("id"), v, *[pa.array(cells[:, i]) for i in range(lead)]], ["id", "v", *names])

    names = [f"c{i}" for i in range(lead)]
    turned = common.staged(rows.mapInArrow(turn, "id long, v array<double>, " + ", ".join(f"{c} int" for c in names)), "turned")
    ordered = turned.repartitionByRange(*names, "id").sortWithinPartitions(*names, "id").select("id", "v")
    blocks = common.staged(packed(ordered, size, BLOCK), "sequence")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, v = opened(row["ids"], row["vectors"], size)
                low, high = v.min(0), v.max(0)
                first, last = int(np.floor(low[0] / eps)), int(np.floor(high[0] / eps))
                yield pa.record_batch([pa.array([row["block"]]), pa.array([first]), pa.array([last]), pa.array([low.tolist()]), pa.array([high.tolist()])], ["block", "first", "last", "low", "high"])

    # blocks get consecutive numbers in the order of the sequence; the driver sees one count for each partition
    counts = blocks.groupBy(F.expr(f"block div {BLOCKS_A_TASK}").alias("part")).count().orderBy("part").collect()
    before = rows.sparkSession.createDataFrame([(r.part, sum(x["count"] for x in counts[:i])) for i, r in enumerate(counts)] or [(0, 0)], "part long, before long")
    number = F.shiftright(F.col("before") + F.col("block") % BLOCKS_A_TASK, SQUARE.bit_length() - 1)
    place = common.staged(blocks.select("block", F.expr(f"block div {BLOCKS_A_TASK}").alias("part")).join(F.broadcast(before), "part").select("block", number.alias("place")), "numbers")

    box = common.staged(blocks.mapInArrow(boxes, "block long, first long, last long, low array<double>, high array<double>"), "boxes")
    left = box.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell"))
    right = box.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence("first", "last")).alias("cell"))
    gaps = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    gap = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)
    meet = left.join(right, "cell").where(F.col("a") <= F.col("b")).where(gap <= eps * eps).select("a", "b").distinct()
    floor = int(round(least * SCALE))

    def join(wanted: pa.Table, held: pa.Table) -> pa.Table:
        opened_ = {row["block"]: opened(row["ids"], row["vectors"], size) for row in held.to_pylist()}
        out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], ["a", "b", "m"])]
        for a, b in zip(wanted["a"].to_pylist(), wanted["b"].to_pylist()):
            (ids_a, va), (ids_b, vb) = opened_[a], opened_[b]
            for i, j, s in _interval_join(va, vb, a == b, eps * eps, floor):
                x, y = ids_a[i], ids_b[j]
                ok = x != y
                out.append(pa.table([pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok]), pa.array(s[ok])], ["a", "b", "m"]))
        return pa.concat_tables(out)

    # a square of SQUARE by SQUARE neighbouring blocks is one group: its blocks travel once, whatever pairs of them may meet
    meet = common.join_small(meet, place.withColumnsRenamed({"block": "a", "place": "row"}), "a")
    meet = common.staged(common.join_small(meet, place.withColumnsRenamed({"block": "b", "place": "column"}), "b").select("row", "column", "a", "b"), "meet")
    key = ["row", "column"]
    wanted = meet.select(*key, F.col("a").alias("block")).union(meet.select(*key, F.col("b").alias("block"))).distinct()
    held = common.staged(wanted, "wanted").join(blocks, "block").select(*key, "block", "ids", "vectors")
    found = meet.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(join, "a long, b long, m int").groupBy("a", "b").agg(F.max("m").alias("m"))
    return found.select("a", "b", (F.col("m") / F.lit(float(SCALE))).alias("similarity"))


SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.v, b.v) * 1000000) >= 900000),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, s.b FROM reach r JOIN s ON s.a = r.b),
class AS (SELECT a AS vec_id, min(b) AS class_id FROM reach GROUP BY a),
link AS (SELECT a AS vec_id, count(DISTINCT b) AS links FROM s GROUP BY a)
SELECT vec_id, class_id, coalesce(links, 0) AS links FROM class LEFT JOIN link USING (vec_id)
"""
