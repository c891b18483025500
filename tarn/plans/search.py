"""Opening an index and searching it: one plan for any number of queries.

A search finds the best chunks of each query by vector and by terms, adds them up by document, fuses the two lists by rank,
reranks the first hits if asked to, multiplies by a metadata field, cuts low scores and keeps the first ``top_k``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import embedding as E
from tarn.functions import text as T
from tarn.functions.embedding import backend_of
from tarn.operators import filters, rank
from tarn.operators.index import IndexFolder
from tarn.plans.conventions import Conventions

MODES = ("hybrid", "vector", "lexical")
RERANKERS = ("heuristic-v1", "embedding-v1")


@dataclass(frozen=True)
class Reranker:
    kind: str = "heuristic-v1"
    candidate_pool_size: int = 50

    def __post_init__(self):
        if self.kind not in RERANKERS:
            raise ValueError(f"unknown reranker {self.kind!r}; there are {', '.join(RERANKERS)}")


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    mode: str = "hybrid"
    min_score: float | None = None
    relative_path_prefix: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    reranker: Reranker | None = None
    numeric_multiplier: str | None = None
    candidate_multiplier: int = 8

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; there are {', '.join(MODES)}")

    @property
    def pool(self) -> int:
        return max(self.reranker.candidate_pool_size, self.top_k) if self.reranker else self.top_k

    @property
    def limit(self) -> int:
        """Documents that each list may hold."""
        return max(self.top_k * max(self.candidate_multiplier, 1), self.pool)

    @property
    def kept(self) -> int:
        """Hits that go on from reranking to the final scores."""
        return self.limit if self.numeric_multiplier else self.pool


def make_options(given: dict[str, Any]) -> SearchOptions:
    """Options from plain values; a reranker may be its name or a dict."""
    known = {f.name for f in fields(SearchOptions)}
    if wrong := set(given) - known:
        raise ValueError(f"unknown search options: {', '.join(sorted(wrong))}")
    given = {k: v for k, v in given.items() if v is not None}
    if isinstance(reranker := given.get("reranker"), str):
        given["reranker"] = Reranker(reranker)
    elif isinstance(reranker, dict):
        given["reranker"] = Reranker(**reranker)
    return SearchOptions(**given)


class Index:
    """An open index. ``mode_profile`` "lexical" reads no vectors, and refuses searches that would need them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], manifest: dict, mode_profile: str | None = None, conventions: Conventions | None = None):
        if mode_profile not in (None, "hybrid", "lexical"):
            raise ValueError(f"unknown mode profile {mode_profile!r}")
        self.spark, self.tables, self.manifest = spark, tables, manifest
        self.mode_profile, self.conventions = mode_profile, conventions
        stats = tables["corpus_stats"].first()
        self.n_chunks, self.average = stats["n_chunks"], stats["avg_chunk_length"]
        self.backend = backend_of(manifest["config"]["backend"])

    def info(self) -> dict:
        """Counts and the configuration that the index was built with."""
        config = self.manifest["config"]
        return {
            "schema_version": config["schema"],
            "built_at": self.manifest["built_at"],
            "embedding_backend": config["backend"],
            "chunking": config["chunking"],
            "tokenizer": config["tokenizer"],
            "source_root": config["root"],
            "document_count": self.tables["documents"].count(),
            "chunk_count": self.n_chunks,
        }

    def cache(self) -> Index:
        """Keep the tables in memory for many searches."""
        for name, df in self.tables.items():
            if name != "vectors" or self.mode_profile != "lexical":
                df.cache()
        return self

    def _check(self, options: SearchOptions) -> None:
        if self.mode_profile == "lexical" and options.mode != "lexical":
            raise ValueError(f'the index is open with mode profile "lexical" and does not support mode "{options.mode}"')
        if self.mode_profile == "lexical" and options.reranker and options.reranker.kind == "embedding-v1":
            raise ValueError('reranker "embedding-v1" needs embeddings, which the mode profile "lexical" does not load')

    def allowed(self, options: SearchOptions) -> DataFrame | None:
        """Ids of documents that pass the filters; None if there are no filters."""
        if not options.relative_path_prefix and not options.metadata:
            return None
        return self.tables["documents"].where(filters.path_prefix(options.relative_path_prefix) & filters.metadata_equals(options.metadata)).select("doc_id")

    def _restricted(self, name: str, allowed: DataFrame | None) -> DataFrame:
        df = self.tables[name]
        return df if allowed is None else df.join(rank.small(allowed), "doc_id", "left_semi")

    def vector_list(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None) -> DataFrame:
        embedded = queries.select("query_id", E.embedding(T.query_for_embedding(F.col("query")), self.backend).alias("embedding"))
        return rank.by_document(rank.vector_scores(embedded, self._restricted("vectors", allowed), 2 * options.limit), options.limit)

    def lexical_list(self, queries: DataFrame, options: SearchOptions, allowed: DataFrame | None) -> DataFrame:
        terms = rank.query_terms(queries)
        words = rank.vocabulary(terms)
        places = self.spark.createDataFrame(list(enumerate(words)), "place int, word string")
        wanted = lambda table: table.join(rank.small(places, len(words)), F.col("term") == F.col("word"))
        df = dict(wanted(self.tables["term_stats"]).select("place", "df").collect())  # a row a term of the queries
        # all of a chunk's terms come to one task, as a few numbers each
        posted = wanted(self._restricted("postings", allowed)).select("chunk_id", F.col("place").alias("term"), "tf", "chunk_len")
        counts = posted.repartition("chunk_id").sortWithinPartitions("chunk_id", "term")
        best = rank.bm25_best(terms, counts, words, df, self.n_chunks, self.average, 2 * options.limit, 12)
        scored = self.tables["chunks"].select("chunk_id", "doc_id").join(rank.small(best, queries.count() * 2 * options.limit), "chunk_id")
        return rank.by_document(scored, options.limit)

    def search_many(self, queries: DataFrame, options: SearchOptions | None = None, **given: Any) -> DataFrame:
        """Hits (query_id, rank, score, doc_id, ..., best_match) of each query of ``queries`` (query_id, query).

        Queries without id or text have no hits; ids must not repeat. Ties go to the smaller path.
        """
        options = options or make_options(given)
        self._check(options)
        queries = queries.select("query_id", "query").where("query_id IS NOT NULL AND query IS NOT NULL")
        allowed = self.allowed(options)
        lists = []
        if options.mode in ("hybrid", "vector"):
            lists.append(self.vector_list(queries, options, allowed))
        if options.mode in ("hybrid", "lexical"):
            lists.append(self.lexical_list(queries, options, allowed))
        return self.finish(queries, rank.fuse(lists, options.limit), options)

    def finish(self, queries: DataFrame, fused: DataFrame, options: SearchOptions) -> DataFrame:
        documents = self.tables["documents"].select("doc_id", "relative_path", "canonical_url", "title", "summary", "metadata_json")
        # documents and chunks are found by the fused hits, of which each query has ``limit`` at most
        most = queries.count() * options.limit
        hits = documents.join(rank.small(fused, most), "doc_id")
        chunks = self.tables["chunks"].select("chunk_id", "excerpt", "heading_path", "char_start", "char_end")
        hits = chunks.join(rank.small(hits, most), "chunk_id")
        if options.reranker:
            hits = self._reranked(rank.small(queries, most), hits, options)
        hits = rank.best_per_query(hits, options.kept, "relative_path")
        hits = rank.cut(rank.adjust(hits, options.numeric_multiplier), options.min_score)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "relative_path")
        best = F.struct("chunk_id", "excerpt", "heading_path", "char_start", "char_end", F.col("chunk_score").alias("score"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top_k)
        return ranked.select("query_id", "rank", "score", "doc_id", "relative_path", "canonical_url", "title", "summary", "metadata_json", best.alias("best_match"))

    def _reranked(self, queries: DataFrame, hits: DataFrame, options: SearchOptions) -> DataFrame:
        pool = max(options.reranker.candidate_pool_size, options.kept)
        hits = hits.join(queries, "query_id")
        heuristic = rank.heuristic_score(F.col("query"), F.col("title"), F.col("relative_path"), F.col("heading_path"), F.col("excerpt"))
        if options.reranker.kind == "heuristic-v1":
            return rank.rerank(hits, pool, F.col("score") * 0.35 + heuristic * 0.65)
        asked = E.embedding(T.query_for_embedding(F.col("query")), self.backend)
        told = E.embedding(T.document_for_reranking(F.col("relative_path"), F.col("title"), F.col("heading_path"), F.col("excerpt"), F.col("metadata_json")), self.backend)
        near = F.greatest(E.cosine(asked, told), F.lit(0.0))
        return rank.rerank(hits, pool, F.col("score") * 0.2 + (near * 0.8 + heuristic * 0.2) * 0.8)

    def search(self, query: str, **given: Any) -> list[dict]:
        """Hits of one query as plain values, best first; conventions rewrite the query and add their default profile."""
        if self.conventions:
            query, given = self.conventions.apply(query, given)
        one = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        rows = self.search_many(one, make_options(given)).orderBy("rank").collect()  # at most top_k rows
        return [row.asDict(recursive=True) for row in rows]


def open_index(spark: SparkSession, path: str, mode_profile: str | None = None, conventions: Conventions | None = None) -> Index:
    """Open the current version of an index folder."""
    folder = IndexFolder(spark, path)
    manifest = folder.manifest()
    names = ["documents", "chunks", "postings", "term_stats", "corpus_stats"] + ([] if mode_profile == "lexical" else ["vectors"])
    return Index(spark, {n: folder.table(n) for n in names}, manifest, mode_profile, conventions)


