"""One query per operator over its whole table, with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, ego, jaccard, lm, mixing, quality, repeats, shards, topk, urls
from tarn.llm.common import scratch_path, table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources weigh the square root of their tokens."""
    return mixing.select(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives back its text."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, with their log weight."""
    kept = quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "lang", "source", "n_chars", "log_weight")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from a store that took them in arrivals and compacted after each."""
    return shards.checked(shards.ingest(table(spark, sf_dir, "documents"), scratch_path(spark, "store")).read())


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document, with texts labelled good and not toxic as the target."""
    return lm.score(table(spark, sf_dir, "documents"), lm.target_of(table(spark, sf_dir, "labels")))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document with similar sets of word trigrams, and how many documents it is linked with."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each vector by cosines of 0.9 or more, and how many vectors it is linked with."""
    return ego.classes(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template, its purity and the verdict for every page."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    return urls.judge(pages, urls.page_labels(pages, labels))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words that stand in more than one document; ``first`` marks the copies that stay."""
    return repeats.spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "stop", "first")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_lm_score": op2_lm_score,
    "op3_jaccard": op3_jaccard,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_bpe": op8_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {"op1_sharding": shards.SQL, "op2_lm_score": lm.SQL, "op4_mixing": mixing.SQL, "op5_topk": topk.SQL, "op6_embedding_dedup": ego.SQL}
