"""Language-model scoring by cross-entropy difference.

Two bigram models, interpolated with smoothed unigrams, share one vocabulary: all words that occur at least
twice, however large the corpus; all others are one unknown word. The background model counts all documents, the
target model those labelled good and not toxic. A text is ``<s> w1 ... wn </s>``; its losses are the mean of -ln p over the
n + 1 predicted tokens in either model, and its score is target loss less background loss: low for texts like the target.

    p(w | v) = L * c(v, w) / c(v) + (1 - L) * (c(w) + A) / (sum c + A * |V|),  with L = 0 where c(v) = 0

Counts are exact over the whole corpus and never gathered in one place: each block of texts sends its distinct words, and
then its distinct bigrams, packed by hash, to the partition that adds them up over all blocks, and gets the totals back in the
same order. Only sums over the vocabulary come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common, textvec
from tarn.llm.packing import BLOCKS_A_TASK, WIRE, WIRE_ARROW, pack, squeeze, unpack, wire_row

#: Weight of the bigram and pseudo-count of each word.
LAMBDA, ALPHA = 0.5, 0.1
#: Least count of a word of the vocabulary.
LEAST = 2
BLOCK = 8_000_000


def _codes_out(codes: np.ndarray) -> bytes:
    """Sorted 64-bit codes as compressed differences."""
    steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    return squeeze()[0].compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _codes_in(data: bytes) -> np.ndarray:
    planes = np.frombuffer(squeeze()[1].decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _by_bucket(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted codes, bucket by bucket and sorted within each, and where each bucket begins."""
    bucket = (textvec.mix(codes) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def _tally(codes: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their counts, and their counts where ``good``."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(codes) else np.zeros(0, np.int64)
    if not len(first):
        return ranked, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ranked[first], np.diff(np.append(first, len(ranked))), np.add.reduceat(good[order].astype(np.int64), first)


def _bucket_rows(block: int, codes: np.ndarray, every: np.ndarray, good: np.ndarray, buckets: int) -> list[dict]:
    by, cuts = _by_bucket(codes, buckets)
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        of = by[cuts[k] : cuts[k + 1]]
        rows.append(wire_row(-1 - int(k), block, int(k), _codes_out(codes[of]), pack(every[of]), pack(good[of])))
    return rows


def _words(buckets: int):
    """Blocks of texts to rows of their own (key = block: ids, counts and places of words; distinct words and which texts are
    good) and rows of distinct words for the buckets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * BLOCKS_A_TASK
        for block in common.slices(batches, "text", BLOCK):
            hashed, counts = [], []
            for batch in common.slices(iter([block]), "text"):
                t = textvec.tokens(batch.column("text"))
                hashed.append(t.hash)
                counts.append(t.counts)
            hashed, counts = np.concatenate(hashed), np.concatenate(counts)
            good = np.asarray(block.column("good").fill_null(False))
            own, place = np.unique(hashed, return_inverse=True)
            every = np.bincount(place, minlength=len(own))
            of_good = np.bincount(place[np.repeat(good, counts)], minlength=len(own))
            ids = common.blob(np.asarray(block.column("row_id")))
            rows = [wire_row(number, number, -1, ids, pack(counts), pack(place)), wire_row(number, number, -2, _codes_out(own), pack(good))]
            yield pa.RecordBatch.from_pylist(rows + _bucket_rows(number, own, every, of_good, buckets), WIRE_ARROW)
            number += 1

    return emit


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of (codes, counts, counts) over parts."""
    codes = np.concatenate([p[0] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    if not len(codes):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    sums = [np.add.reduceat(np.concatenate([p[i] for p in parts]).astype(np.int64)[order], first) for i in (1, 2)]
    return codes[first], sums[0], sums[1]


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket in turn, from rows that come sorted by key; rows of blocks (keys from 0) are passed over."""
    key, rows = None, []
    for batch in batches:
        for i in np.flatnonzero(np.asarray(batch.column("key")) < 0).tolist():
            row = {name: batch.column(name)[i].as_py() for name in ("key", "block", "bucket", "a", "b", "c")}
            if row["key"] != key and rows:
                yield key, rows
                rows = []
            key = row["key"]
            rows.append(row)
    if rows:
        yield key, rows


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _codes_in(row["a"]), unpack(row["b"]), unpack(row["c"])


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of each block's words, and the rank of each among the bucket's words of the vocabulary (from 1; 0: unknown).
    A row of sums a bucket, with no block: words, their counts, and the counts of all words."""
    for key, rows in _buckets_of(batches):
        codes, every, good = _merge([_opened(r) for r in rows])
        known = every >= LEAST
        rank = np.where(known, np.cumsum(known), 0)
        sums = [known.sum(), every[known].sum(), good[known].sum(), every.sum(), good.sum()]
        yield pa.RecordBatch.from_pylist([wire_row(key, -1, -3, common.blob(np.array(sums, dtype=np.int64)))], WIRE_ARROW)
        for r in rows:
            at = np.searchsorted(codes, _codes_in(r["a"]))
            yield pa.RecordBatch.from_pylist([wire_row(r["block"], r["block"], r["bucket"], pack(every[at]), pack(good[at]), pack(rank[at]))], WIRE_ARROW)


def _opened_block(rows: pa.Table, buckets: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a block's rows and the totals of its words: the row of ids, counts and places of words; which texts are good; numbers
    and totals of its distinct words. None if there is no block.

    A word's number is a function of its bucket and its rank there; 1 is the unknown word, 0 stands for both ends of a text.
    """
    if not rows.num_rows or rows["key"][0].as_py() < 0:
        return None
    held = {r["bucket"]: r for r in rows.to_pylist()}
    own = _codes_in(held[-2]["a"])
    number, sums = np.ones(len(own), dtype=np.int64), np.zeros((2, len(own)), dtype=np.int64)
    by, cuts = _by_bucket(own, buckets)
    for k, r in held.items():
        if k >= 0:
            of, rank = by[cuts[k] : cuts[k + 1]], unpack(r["c"]).astype(np.int64)
            sums[0, of], sums[1, of] = unpack(r["a"]), unpack(r["b"])
            number[of] = np.where(rank > 0, (rank - 1) * buckets + k + 2, 1)
    return held[-1], unpack(held[-2]["b"]).astype(bool), number, sums


def _bigrams(buckets: int):
    """A block's rows and the totals of its words to rows of distinct bigrams for the buckets. The block's own rows are not among
    them: the scores read them where they came from, so that they are moved once."""

    def one(rows: pa.Table) -> pa.Table:
        block = _opened_block(rows, buckets)
        if block is None:
            return WIRE_ARROW.empty_table()
        text, good, number, _ = block
        codes, at = _pairs(number[unpack(text["c"])], unpack(text["b"]).astype(np.int64))
        return pa.Table.from_pylist(_bucket_rows(text["block"], *_tally(codes, good[at]), buckets), WIRE_ARROW)

    return one


def _pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bigrams of texts that have words, ends included, and the text of each."""
    some = np.flatnonzero(counts)
    row = np.repeat(some, counts[some] + 1)
    first = np.cumsum(counts[some] + 1) - (counts[some] + 1)
    before, after = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    inner = np.ones(len(row), dtype=bool)
    inner[first] = False
    before[inner] = words
    inner[:] = True
    inner[first + counts[some]] = False
    after[inner] = words
    return before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), row


def _sum_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _buckets_of(batches):
        codes, every, good = _merge([_opened(r) for r in rows])
        for r in rows:
            at = np.searchsorted(codes, _codes_in(r["a"]))
            yield pa.RecordBatch.from_pylist([wire_row(r["block"], r["block"], r["bucket"], pack(every[at]), pack(good[at]))], WIRE_ARROW)


_OUT = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])


def _score(known: np.ndarray, ends: np.ndarray, buckets: int):
    """``known``: sums over the vocabulary (see ``_sum_words``); ``ends``: texts with words, and those of them that are good."""
    size = int(known[0]) + 2
    unknown, whole = known[3:5] - known[1:3], known[3:5] + ends

    def score(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        block = _opened_block(blocks, buckets)
        if block is None:
            return _OUT.empty_table()
        text, _, number, of_word = block
        ids, counts = np.frombuffer(text["a"], dtype="<i8"), unpack(text["b"]).astype(np.int64)
        codes, at = _pairs(number[unpack(text["c"])], counts)
        own, inverse = np.unique(codes, return_inverse=True)
        by, cuts = _by_bucket(own, buckets)
        sums = np.zeros((2, len(own)), dtype=np.int64)
        for k, a, b in zip(totals["bucket"].to_pylist(), totals["a"].to_pylist(), totals["b"].to_pylist()):
            sums[0, by[cuts[k] : cuts[k + 1]]] = unpack(a)
            sums[1, by[cuts[k] : cuts[k + 1]]] = unpack(b)
        words, first = np.unique(np.concatenate([[0, 1], number]), return_index=True)
        v, w = (np.searchsorted(words, half.astype(np.int64)) for half in (own >> np.uint64(32), own & np.uint64(0xFFFF_FFFF)))
        losses = [np.full(len(ids), np.nan), np.full(len(ids), np.nan)]
        some = np.flatnonzero(counts)
        for loss, i in ((losses[0], 1), (losses[1], 0)):
            alone = np.concatenate([[ends[i], unknown[i]], of_word[i]])[first]
            seen = alone[v] > 0
            weight = np.where(seen, LAMBDA, 0.0)
            p = weight * sums[i] / np.where(seen, alone[v], 1) + (1 - weight) * (alone[w] + ALPHA) / (whole[i] + ALPHA * size)
            if len(some):
                each = -np.log(p)[inverse]
                loss[some] = np.bincount(at, weights=each, minlength=len(ids))[some] / (counts[some] + 1)
        return pa.table([pa.array(ids), pa.array(counts), pa.array(losses[0], from_pandas=True), pa.array(losses[1], from_pandas=True)], schema=_OUT)

    return score


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs``, rounded to 6 places.

    ``target_ids`` (doc_id) names the target texts; nulls and repeats in it, and ids without a document, change nothing. A
    null, empty or wordless text has n_tokens 0 and null losses. Repeated rows count, and are scored, each; so are rows
    without id, which are never in the target. Without target texts the target model is uniform. Other columns are left out.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, missing = 4 * partitions, -(1 << 63)
    marks = target_ids.select(F.col("doc_id").cast("long").alias("row_id")).where("row_id IS NOT NULL").distinct().withColumn("good", F.lit(True))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(missing)).alias("row_id"), F.lower("text").alias("text"))
    texts = common.join_small(texts, common.staged(marks, "target"), "row_id", "left")

    some = texts.where(F.col("text").rlike("[0-9A-Za-z_\\x{80}-\\x{10FFFF}]")).agg(F.count("*").alias("n"), F.count("good").alias("t")).first()
    blocks = common.staged(texts.mapInArrow(common.trimmed(_words(buckets)), WIRE), "blocks")
    counted = blocks.where("key < 0").repartition(partitions, "key").sortWithinPartitions("key")
    words = common.staged(counted.mapInArrow(common.trimmed(_sum_words), WIRE), "words")
    known = np.zeros(5, dtype=np.int64)
    for row in words.where("bucket = -3").select("a").collect():  # a row a bucket
        known += np.frombuffer(row.a, dtype="<i8")

    # blocks and their words' totals are moved once, and read for the bigrams and again for the scores
    held = blocks.where("key >= 0").unionAll(words.where("key >= 0")).repartition(partitions, "key")
    wire = held.groupBy("key").applyInArrow(_bigrams(buckets), WIRE).repartition(partitions, "key")
    sums = wire.sortWithinPartitions("key").mapInArrow(common.trimmed(_sum_bigrams), WIRE).repartition(partitions, "key")
    scored = held.groupBy("key").cogroup(sums.groupBy("key")).applyInArrow(_score(known, np.array([some.n, some.t]), buckets), "row_id long, n_tokens long, target_loss double, background_loss double")
    return scored.select(
        F.when(F.col("row_id") != missing, F.col("row_id")).alias("doc_id"),
        "n_tokens",
        F.round("target_loss", 6).alias("target_loss"),
        F.round("background_loss", 6).alias("background_loss"),
        F.round(F.col("target_loss") - F.col("background_loss"), 6).alias("score"),
    )


def target_of(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic; where labels of one id differ, the worst counts."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return worst.where("q = 1 AND t = 0").select("doc_id")


SQL = r"""
WITH target AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+') AS w, (doc_id IN (SELECT doc_id FROM target))::INT AS good FROM documents),
long AS (SELECT doc_id, good, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM texts),
words AS (SELECT w, count(*) AS n, sum(good) AS t FROM long GROUP BY w),
known AS (SELECT w FROM words WHERE n >= 2),
named AS (SELECT doc_id, good, i, n, CASE WHEN k.w IS NULL THEN '<unk>' ELSE l.w END AS w FROM long l LEFT JOIN known k USING (w)),
uni AS (
  SELECT w, count(*) AS n, sum(good) AS t FROM named GROUP BY w
  UNION ALL SELECT '<end>', count(*), sum(good) FROM texts WHERE len(w) > 0
  UNION ALL SELECT '<unk>', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM named WHERE w = '<unk>')),
tot AS (SELECT sum(n) AS n, sum(t) AS t, count(*) AS v FROM uni),
events AS (
  SELECT doc_id, good, lag(w, 1, '<end>') OVER (PARTITION BY doc_id ORDER BY i) AS v, w FROM named
  UNION ALL SELECT doc_id, good, w, '<end>' FROM named WHERE i = n),
bi AS (SELECT v, w, count(*) AS n, sum(good) AS t FROM events GROUP BY v, w),
p AS (
  SELECT b.v, b.w,
    CASE WHEN c.n > 0 THEN 0.5::DOUBLE * b.n / c.n ELSE 0 END + CASE WHEN c.n > 0 THEN 0.5::DOUBLE ELSE 1 END * (u.n + 0.1::DOUBLE) / (tot.n + 0.1::DOUBLE * tot.v) AS pb,
    CASE WHEN c.t > 0 THEN 0.5::DOUBLE * b.t / c.t ELSE 0 END + CASE WHEN c.t > 0 THEN 0.5::DOUBLE ELSE 1 END * (u.t + 0.1::DOUBLE) / (tot.t + 0.1::DOUBLE * tot.v) AS pt
  FROM bi b JOIN uni c ON c.w = b.v JOIN uni u ON u.w = b.w, tot),
scored AS (SELECT doc_id, avg(-ln(pt)) AS lt, avg(-ln(pb)) AS lb FROM events JOIN p USING (v, w) GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(t.w), 0) AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS score
FROM texts t LEFT JOIN scored s USING (doc_id)
"""
