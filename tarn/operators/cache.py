"""The incremental build: a versioned cache of documents, chunks and vectors that only re-embeds what has changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import hashing as H
from tarn.functions.embedding import backend_of
from tarn.operators import index as I
from tarn.operators.chunking import Chunking
from tarn.operators.index import BuildOptions, IndexFolder
from tarn.sources import files

_CHUNKS = "chunk_id long, doc_id string, ordinal int, heading_path array<string>, char_start int, char_end int, token_count int, chunk_text string, excerpt string"
_VECTORS = "chunk_id long, doc_id string, embedding array<float>"
_STORED = ["doc_id", "source_root_id", "source_path", "relative_path", "canonical_url", "title", "summary", "content_hash", "metadata_json", "fingerprint", "is_deleted"]


def change_status(incoming: DataFrame, cached: DataFrame) -> DataFrame:
    """(relative_path, fingerprint, old_fingerprint, is_deleted, status) of each path on either side.

    new: not in the cache; unchanged: same fingerprint and not deleted; changed: other rows in the cache; absent: in the cache
    only. ``cached`` has (relative_path, fingerprint, is_deleted).
    """
    old = cached.select("relative_path", F.col("fingerprint").alias("old_fingerprint"), "is_deleted")
    both = incoming.select("relative_path", "fingerprint").join(old, "relative_path", "full_outer")
    status = (
        F.when(F.col("fingerprint").isNull(), "absent")
        .when(F.col("old_fingerprint").isNull(), "new")
        .when((F.col("fingerprint") == F.col("old_fingerprint")) & ~F.col("is_deleted"), "unchanged")
        .otherwise("changed")
    )
    return both.withColumn("status", status)


class BuildCache:
    """A cache folder. ``update`` writes a new version and makes it current, so a failed update leaves the old one."""

    def __init__(self, spark: SparkSession, path: str, options: BuildOptions = BuildOptions()):
        self.spark, self.folder, self.options = spark, IndexFolder(spark, path), options

    def _config(self) -> str:
        return H.config_fingerprint(self.options.describe())

    def _load(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents (tombstones too), chunks and vectors; empty if there are none or the configuration is another."""
        try:
            same = self.folder.manifest().get("config_fingerprint") == self._config()
        except FileNotFoundError:
            same = False
        if same:
            return self.folder.table("documents"), self.folder.table("chunks"), self.folder.table("vectors")
        docs = self.spark.createDataFrame([], ", ".join(f"{c} {'boolean' if c == 'is_deleted' else 'string'}" for c in _STORED))
        return docs, self.spark.createDataFrame([], _CHUNKS), self.spark.createDataFrame([], _VECTORS)

    def update(self, documents: DataFrame, removed: DataFrame | None = None, replace_all: bool = False) -> dict:
        """Take in documents, then remove paths (``removed``: relative_path), or with ``replace_all`` all other paths.

        Returns counts: scanned, new, changed, unchanged, removed, active_documents, active_chunks. A path in both lists ends
        up removed. Two documents of one path are an error.
        """
        spark = self.spark
        work = f"{self.folder.path}/work-{uuid.uuid4().hex}"
        try:
            I.with_ids(I.as_input(documents), self.options.root).write.parquet(f"{work}/incoming")
            incoming = spark.read.parquet(f"{work}/incoming")
            twice = incoming.groupBy("relative_path").count().where("count > 1").head(1)
            if twice:
                raise ValueError(f"two documents have the path {twice[0][0]}")
            docs, chunks, vectors = self._load()
            change_status(incoming, docs).write.parquet(f"{work}/status")
            status = spark.read.parquet(f"{work}/status")
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # four rows

            fresh = incoming.join(status.where("status IN ('new', 'changed')").select("relative_path"), "relative_path", "left_semi")
            gone = removed.select("relative_path").distinct() if removed is not None else spark.createDataFrame([], "relative_path string")
            if replace_all:
                gone = gone.union(docs.select("relative_path").join(incoming.select("relative_path"), "relative_path", "left_anti")).distinct()
            kept = docs.join(fresh.select("relative_path"), "relative_path", "left_anti").select(*_STORED)
            stored = kept.unionByName(fresh.withColumn("is_deleted", F.lit(False)).select(*_STORED))
            stored = stored.join(gone.withColumn("_gone", F.lit(True)), "relative_path", "left")
            stored = stored.withColumn("_now", F.col("_gone").isNotNull() & ~F.col("is_deleted")).withColumn("is_deleted", F.col("is_deleted") | F.col("_gone").isNotNull())
            stored.select(*_STORED, "_now").write.parquet(f"{work}/stored")
            stored = spark.read.parquet(f"{work}/stored")
            n_removed = stored.where("_now").count()

            live = stored.where("NOT is_deleted").select("doc_id", "relative_path")
            added = fresh.join(live.select("relative_path"), "relative_path", "left_semi")
            I.chunk_rows(added, self.options).write.parquet(f"{work}/chunks")
            made = spark.read.parquet(f"{work}/chunks")
            still = live.join(fresh.select("relative_path"), "relative_path", "left_anti").select("doc_id")
            tables = {
                "documents": stored.select(*_STORED),
                "chunks": chunks.join(still, "doc_id", "left_semi").select(*I.CHUNK_COLUMNS).unionByName(made.select(*I.CHUNK_COLUMNS)),
                "vectors": vectors.join(still, "doc_id", "left_semi").select("chunk_id", "doc_id", "embedding").unionByName(I.vector_rows(made, self.options.backend)),
            }
            stats = {"scanned": incoming.count(), "new": counts.get("new", 0), "changed": counts.get("changed", 0), "unchanged": counts.get("unchanged", 0), "removed": n_removed}
            self.folder.write(tables, self.options, {"config_fingerprint": self._config()})
            return stats | self.counts()
        finally:
            files.delete(spark, work)

    def active_documents(self) -> DataFrame:
        """Documents that are not removed."""
        return self._load()[0].where("NOT is_deleted")

    def active_chunks(self) -> DataFrame:
        """Chunks of active documents with their path and vector."""
        docs, chunks, vectors = self._load()
        return chunks.join(docs.where("NOT is_deleted").select("doc_id", "relative_path"), "doc_id").join(vectors.select("chunk_id", "embedding"), "chunk_id")

    def counts(self) -> dict:
        return {"active_documents": self.active_documents().count(), "active_chunks": self._load()[1].count()}

    def info(self) -> dict:
        manifest = self.folder.manifest()
        return {"config": manifest["config"], "built_at": manifest["built_at"]} | self.counts()

    def export_index(self, path: str) -> dict:
        """Write the active documents as an index; nothing is embedded anew."""
        _, chunks, vectors = self._load()
        docs = self.active_documents()
        tables = I.index_tables(docs, chunks, vectors)
        counts = self.counts()
        return IndexFolder(self.spark, path).write(tables, self.options, {"document_count": counts["active_documents"], "chunk_count": counts["active_chunks"]})


def open_cache(spark: SparkSession, path: str) -> BuildCache:
    """A cache with the options that it was last written with."""
    config = IndexFolder(spark, path).manifest()["config"]
    return BuildCache(spark, path, BuildOptions(config["root"], backend_of(config["backend"]), Chunking(**config["chunking"])))

