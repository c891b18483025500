"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents fall into shards, runs of consecutive ids as they arrived. Within a shard the documents of a source, in the order
of a seeded hash, are cut into blocks of ``block_tokens`` tokens (the last may be shorter). A budget of blocks is given to
sources one block at a time, each to the source with the highest quotient ``weight / (2 * blocks so far + 1)`` that still has
blocks; a source's blocks go to its shards in the same way, with the shard's number of blocks as its weight. In each shard a
source's blocks are then drawn by seeded hash until its quota is full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm import common

#: Tokens of a block; ids in a shard; share of all blocks that the mixture takes; power of a source's size that is its weight.
BLOCK_TOKENS, SHARD_DOCS, SHARE, TEMPERATURE, SEED = 2000, 50_000, 0.5, 0.5, 17


def token_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x{0B}]+")), F.lit(0)).cast("long")


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats of each party by highest quotients weight / (2k + 1), none above ``most``; ties go to the earlier party.

    Parties with a weight of 0, negative, null or infinite get none. Seats beyond the sum of ``most`` stay empty. The
    divisor is found by bisection and the last seats are dealt one by one, so time does not grow with the seats.
    """
    weights = np.where(np.isfinite(weights) & (weights > 0), weights, 0.0)
    most = np.where(weights > 0, np.asarray(most, dtype=np.int64), 0)
    seats = int(min(seats, most.sum()))
    won = np.zeros(len(weights), dtype=np.int64)
    if seats <= 0:
        return won

    def above(q: float) -> np.ndarray:
        """Quotients of each party that exceed q: 2k + 1 < weight / q."""
        return np.minimum(np.ceil(np.maximum(weights / q - 1, 0) / 2).astype(np.int64), most)

    low, high = weights[weights > 0].min() / (2.0 * most.max() + 3), float(weights.max())
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(middle).sum() > seats else (low, middle)
    won = np.maximum(above(high) - 1, 0)  # one back against rounding; the exact quotients deal the rest
    while won.sum() > seats:
        lowest = np.where(won > 0, weights / (2 * won - 1), np.inf)
        won[len(won) - 1 - int(np.argmin(lowest[::-1]))] -= 1
    while won.sum() < seats:
        won[int(np.argmax(np.where(won < most, weights / (2 * won + 1), -1.0)))] += 1
    return won


def _share_out(of_source: pd.DataFrame) -> pd.DataFrame:
    """Blocks that each shard of a source gives: a row a shard, however many blocks there are."""
    rows = of_source.sort_values("shard")
    n = rows.n.to_numpy(np.int64)
    return rows[["source", "shard"]].assign(take=sainte_lague(n.astype(float), int(rows.quota.iloc[0]), n))


def select(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    share: float = SHARE,
    block_tokens: int = BLOCK_TOKENS,
    shard_docs: int = SHARD_DOCS,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens) of each document in the mixture.

    ``weights`` names the target weight of each source (absent ones get nothing); by default a source weighs its tokens to
    the power ``temperature``. The budget is ``share`` of all blocks, rounded up. A null source is the source "". Null and
    empty texts have 0 tokens and go with the block they fall in. Rows without id are in no shard and never drawn. Repeated
    rows stand side by side in the order and count each. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    rows = rows.withColumn("shard", F.floor(F.col("doc_id") / shard_docs)).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), "doc_id").cast("binary")))
    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("block", F.floor(F.coalesce(F.sum("n_tokens").over(line), F.lit(0)) / block_tokens)).drop("order")
    cut = common.staged(cut, "blocks")
    blocks = cut.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("tokens"))
    cells = common.staged(blocks.groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")), "cells")
    parties = cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).orderBy("source").toPandas()  # a row a source
    own = parties.tokens.to_numpy(float) ** temperature if weights is None else np.array([weights.get(s, 0.0) for s in parties.source], float)
    seats = sainte_lague(own, int(np.ceil(share * parties.n.sum())), parties.n.to_numpy(np.int64))
    quotas = spark.createDataFrame(list(zip(parties.source.tolist(), seats.tolist())), "source string, quota long")
    asked = cells.join(F.broadcast(quotas), "source").select("source", "shard", "n", "quota")
    per_shard = asked.groupBy("source").applyInPandas(_share_out, "source string, shard long, take long").where("take > 0")
    draw = Window.partitionBy("source", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "source", "shard", "block").cast("binary")), "block")
    drawn = blocks.join(per_shard, ["source", "shard"]).withColumn("at", F.row_number().over(draw)).where("at <= take").select("source", "shard", "block")
    return cut.join(drawn, ["source", "shard", "block"]).select("doc_id", "source", "shard", "block", "n_tokens")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs`` whose id is in the mixture (see ``select``), columns untouched."""
    ids = common.staged(select(docs, **parameters).select("doc_id").distinct(), "mixture")
    return common.join_small(docs, ids, "doc_id", "left_semi")


SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x{{0B}}]+')), 0)::BIGINT AS n_tokens,
    floor(doc_id / {SHARD_DOCS}.0)::BIGINT AS shard, md5('{SEED}:' || doc_id) AS o FROM documents WHERE doc_id IS NOT NULL),
cut AS (
  SELECT doc_id, source, shard, n_tokens,
    floor(coalesce(sum(n_tokens) OVER (PARTITION BY source, shard ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK_TOKENS}.0)::BIGINT AS block FROM t),
blocks AS (SELECT source, shard, block, sum(n_tokens) AS tokens FROM cut GROUP BY ALL),
cells AS (SELECT source, shard, count(*) AS n FROM blocks GROUP BY ALL),
parties AS (SELECT source, sum(tokens)::DOUBLE ^ {TEMPERATURE} AS weight, count(*) AS n FROM blocks GROUP BY source),
seats AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, source) AS pos
    FROM (SELECT source, weight, unnest(range(n)) AS k FROM parties WHERE weight > 0))
  WHERE pos <= (SELECT ceil({SHARE} * count(*)) FROM blocks) GROUP BY source),
dealt AS (
  SELECT source, shard, count(*) AS take FROM (
    SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY n::DOUBLE / (2 * k + 1) DESC, shard) AS pos
    FROM (SELECT source, shard, n, unnest(range(n)) AS k FROM cells)) JOIN seats USING (source)
  WHERE pos <= quota GROUP BY ALL),
drawn AS (
  SELECT source, shard, block FROM (
    SELECT b.source, b.shard, b.block, take, row_number() OVER (PARTITION BY b.source, b.shard ORDER BY md5('{SEED}:' || b.source || ':' || b.shard || ':' || b.block), b.block) AS pos
    FROM blocks b JOIN dealt d ON b.source = d.source AND b.shard = d.shard)
  WHERE pos <= take)
SELECT doc_id, source, shard, block, n_tokens FROM cut JOIN drawn USING (source, shard, block)
"""
