"""Quality classifier by importance resampling: hashed n-gram generative models of target and raw text, Gumbel top-k.

Two bag-of-n-grams models share one hashed feature space. The target model is fitted on labelled rows of good quality that
are not toxic, the raw model on all documents. A document's log weight is the sum over its features of
``log p_target - log p_raw``; documents are drawn without replacement, with probability in proportion to the weight, by
adding seeded Gumbel noise to the log weight and keeping the k largest. k is not a constant: it is the number of documents
whose log weight reaches a cut calibrated on labelled rows that the model has not seen, where toxic ones are bad whatever
their quality.

Features of a text: words and symbols as they are written, pairs of neighbours (a word followed by itself counts as one
special pair, whatever the word), and pairs of their shapes (lower case, capitalised, upper case, number, or the symbol).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common, textvec

BUCKETS = 1 << 18
#: Counts added to each bucket of both models; large enough that a text's own rare words say nothing about it.
SMOOTHING = 100.0
#: Labelled rows used at most (those with the smallest hash of their id): half fit the target model, half calibrate the cut.
MAX_LABELS = 100_000
#: Cost of turning a good text away, against 1 for letting a bad one in, when the cut is calibrated.
CARE = 4.0
SEED = 20240607
_SLICE = 1 << 14
_REPEAT, _SHAPE = np.uint64(0x1234_5678_9ABC_DEF1), np.uint64(0x51AE_93D1_07B3_66C5)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of every text, and the row it belongs to. Null, empty and blank texts have none."""
    t = textvec.tokens(column, by="all")
    row = t.row_of()
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head, tail = t.raw[t.start], t.raw[t.end - 1]
    upper = (head >= 65) & (head <= 90)
    shape = np.where(upper, np.where((tail >= 65) & (tail <= 90) & (t.end - t.start > 1), 3, 2), 1).astype(np.uint64)
    shape[(head >= 48) & (head <= 57)] = 4
    shape = np.where(t.kind == 1, shape, t.hash)
    pair, at = textvec.ngrams(t.hash, t.rows, 2)
    pair[t.hash[at] == t.hash[at + 1]] = _REPEAT
    forms = textvec.mix((shape[at] * _SHAPE) ^ textvec.mix(shape[at + 1] + _SHAPE))
    every = np.concatenate([t.hash, pair, forms])
    return (every >> np.uint64(46)).astype(np.int64), np.concatenate([row, row[at], row[at]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in common.slices(batches, "text"):
        bucket, row = features(batch.column("text"))
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        good = np.asarray(batch.column("good").fill_null(False))
        if good.any():
            counts[1] += np.bincount(bucket[good[row]], minlength=BUCKETS)
    if counts[0].any():
        parts = range(0, BUCKETS, _SLICE)
        packed = [common.blob(counts[:, a : a + _SLICE]) for a in parts]
        yield pa.record_batch([pa.array([a // _SLICE for a in parts], pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            new = np.frombuffer(packed.as_buffer(), dtype="<i8")
            total[k] = total[k] + new if k in total else new
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([common.blob(x) for x in total.values()], pa.binary())], ["slice", "counts"])


def label_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, quality, toxic, fits): one row per labelled id, ``max_labels`` of them at most, by the hash of the id.

    Rows without an id or quality are left out; where labels of one id differ, the worst counts.
    """
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    return one.withColumn("_o", order).orderBy("_o", "doc_id").limit(max_labels).select("doc_id", "quality", "toxic", (F.col("_o") % 2 == 0).alias("fits"))


def fit(docs: DataFrame, sample: DataFrame, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of target to raw model for each bucket: raw counts over all documents, target counts over labelled ones."""
    good = sample.where("fits AND quality = 1 AND toxic = 0").select(F.col("doc_id"), F.lit(True).alias("good"))
    # at most MAX_LABELS rows by construction
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", "good")
    parts = marked.mapInArrow(common.trimmed(_count), "slice int, counts binary").repartition(BUCKETS // _SLICE, "slice").mapInArrow(_add, "slice int, counts binary").collect()
    counts = np.zeros((2, BUCKETS))
    for part in parts:
        counts[:, part["slice"] * _SLICE : (part["slice"] + 1) * _SLICE] = np.frombuffer(part["counts"], dtype="<i8").reshape(2, -1)
    raw, target = counts.sum(axis=1)
    if not raw or not target:
        return np.zeros(BUCKETS, dtype=np.float32)
    return np.log((counts[1] + smoothing) / (counts[0] * (target / raw) + smoothing)).astype(np.float32)


def log_weight(spark: SparkSession, ratios: np.ndarray) -> Column:
    """Column expression of the log weight of ``text``: 0 for null, empty and blank texts."""
    model = spark.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        common.lean()
        out = [np.zeros(0)]
        for batch in common.slices(iter([pa.record_batch([text], ["text"])]), "text"):
            bucket, row = features(batch.column("text"))
            out.append(np.bincount(row, weights=model.value[bucket], minlength=batch.num_rows))
        return pa.array(np.concatenate(out), pa.float64())

    return weigh.asNondeterministic()(F.col("text"))  # else the optimiser has it run once for each use of the column


def calibrate(good: np.ndarray, bad: np.ndarray, care: float = CARE) -> float:
    """The cut with the least ``care * share of good texts below + share of bad texts not below``; -inf without bad or good."""
    if not len(good) or not len(bad):
        return float("-inf")
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    cost = care * np.searchsorted(np.sort(good), cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(cuts[best[0]])


def select(docs: DataFrame, labels: DataFrame, seed: int = SEED, max_labels: int = MAX_LABELS) -> DataFrame:
    """The documents drawn, with their ``log_weight`` added (an input column of that name is replaced).

    Null, empty and blank texts weigh 0, as does everything where no labelled good text exists; without labelled bad texts
    nothing is turned away. Noise depends on the seed, doc_id and text, so repeated rows stay or go together, and rows that
    tie with the last one drawn all stay. Other columns pass through untouched; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sample = common.staged(label_sample(labels, max_labels), "labels")
    weight = log_weight(spark, fit(docs, sample))
    wanted = (F.col("quality") == 1) & (F.col("toxic") == 0)  # as for the target model
    held = docs.select("doc_id", "text").join(F.broadcast(sample.where("NOT fits").select("doc_id", wanted.alias("wanted"))), "doc_id").select("wanted", weight.alias("w"))
    rows = held.toPandas()
    cut = calibrate(rows.w[rows.wanted.astype(bool)].to_numpy(), rows.w[~rows.wanted.astype(bool)].to_numpy())
    noise = -F.log(-F.log(common.uniform(seed, "doc_id", "text")))
    weighed = docs.withColumn("log_weight", weight)
    scores = common.staged(weighed.select("log_weight", (F.col("log_weight") + noise).alias("key")), "weights")
    k = scores.where(F.col("log_weight") >= cut).count()
    least = common.kth_largest(scores, "key", k)
    if least is None:
        return weighed.limit(0)
    return weighed.where(F.col("log_weight") + noise >= F.lit(least))
