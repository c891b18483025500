"""A training-data pipeline: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, jaccard, mixing, quality, repeats
from tarn.llm.common import DOCUMENT_COLUMNS, staged, table
from tarn.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.select(docs, table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    ship(spark)
    return jaccard.deduplicate(docs).select(*DOCUMENT_COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one of them; documents of which nothing is left go."""
    ship(spark)
    return repeats.remove(docs).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of documents drawn so that sources come nearer to equal weight."""
    ship(spark)
    return mixing.mix(docs).select(*DOCUMENT_COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    ship(spark)
    return bpe.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("jaccard_dedup", jaccard_stage),
    ("suffix_dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Models, approximate search and tokenisers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
