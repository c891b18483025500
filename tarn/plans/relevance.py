"""Relevance: does each query find the document that it should find first?"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.search import Index


def evaluate(index: Index, queries: DataFrame, **options: Any) -> DataFrame:
    """(name, query, expected_top_hit, top_hit, passed) for each row of ``queries`` (name, query, expected_top_hit).

    All queries are one search. A query without hits has a null top hit and does not pass; names must not repeat.
    """
    hits = index.search_many(queries.select(F.col("name").alias("query_id"), "query"), **options).where("rank = 1").select(F.col("query_id").alias("name"), F.col("relative_path").alias("top_hit"))
    return queries.select("name", "query", "expected_top_hit").join(hits, "name", "left").withColumn("passed", F.coalesce(F.col("top_hit") == F.col("expected_top_hit"), F.lit(False)))


def summary(evaluated: DataFrame) -> dict:
    """Totals of an evaluation."""
    row = evaluated.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed")).first()
    return {"total": row["total"], "passed": row["passed"], "failed": row["total"] - row["passed"]}
