"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet shards and numbered manifests. Arrivals are appended as small shards. Shards of
similar size form a tier (each tier ``fanout`` times the size of the one below); when a tier holds a run of ``fanout``, the
run is merged into files of up to the target size, without a shuffle: Spark's reader packs whole shards into partitions of
the target size and each partition is written as one file. A change becomes visible only when its manifest is committed: a
writer claims the next number by creating a file, which fails if another was first, and renames its finished manifest to
that number, which fails if one is there. A claim that outlives PATIENCE belongs to a dead writer and is taken over. A
manifest has the schema of its version, all columns that any arrival had; shards without a column give nulls. Readers of
one of the last ``keep`` versions find its shards; those that no kept manifest names are removed after a compaction.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarn.llm import common

TARGET, FANOUT = 128 << 20, 4
#: Seconds after which a claim without a manifest is a dead writer's; times that an append is tried over after a conflict.
PATIENCE, TRIES = 60.0, 20


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


def tier(size: int, target: int, fanout: int) -> int:
    """0 for shards near the target size (they are left alone), and one more for each power of ``fanout`` below it."""
    return max(0, math.floor(math.log(target / max(size, 1), fanout) + 0.5))


def runs(shards: list[Shard], target: int, fanout: int) -> list[Shard]:
    """The shards of the lowest run to merge: all of the smallest tier that holds ``fanout`` or more, with any that are
    smaller still; none if no tier does."""
    by: dict[int, list[Shard]] = {}
    for shard in shards:
        by.setdefault(tier(shard.size, target, fanout), []).append(shard)
    for level in sorted((t for t in by if t > 0), reverse=True):
        if len(by[level]) >= fanout:
            return [s for t in by if t >= level for s in by[t]]
    return []


def united(known: StructType | None, new: StructType) -> StructType:
    """The columns of both, those of ``known`` first, all nullable; a column whose types differ is an error."""
    fields = {f.name: f for f in known or []}
    for f in new:
        if f.name in fields and fields[f.name].dataType.jsonValue() != f.dataType.jsonValue():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True, f.metadata))
    return StructType(list(fields.values()))


class ShardStore:
    """A versioned set of shards under ``root``; every method that writes commits one new manifest."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, keep: int = 2, patience: float = PATIENCE):
        self.spark, self.root, self.target, self.fanout, self.keep, self.patience = spark, root, target, fanout, keep, patience
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        """Committed versions that are kept, oldest first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json"))

    def _read_manifest(self, version: int | None) -> dict | None:
        known = self.versions() if version is None else [version]
        if not known:
            return None
        stream = self._fs.open(self._path(self._manifest(known[-1])))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """Shards of a version (the last by default)."""
        found = self._read_manifest(version)
        return [Shard(f"{self.root}/{s['path']}", s["size"]) for s in found["shards"]] if found else []

    def schema(self, version: int | None = None) -> StructType | None:
        """Schema of a version (the last by default): all columns that arrivals had up to it. None in a new store."""
        found = self._read_manifest(version)
        return StructType.fromJson(json.loads(found["schema"])) if found else None

    def _claim(self, claim, version: int) -> None:
        for last in (False, True):
            try:
                self._fs.create(claim, False).close()
                return
            except Exception as error:
                if not last and not self._fs.exists(self._path(self._manifest(version))) and self._fs.exists(claim):
                    age = time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000
                    if age > self.patience:
                        self._fs.delete(claim, False)
                        continue
                raise CommitConflict(f"version {version} is taken") from error

    def _commit(self, shards: list[Shard], schema: str, after: int) -> int:
        version = after + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [{"path": s.path[len(self.root) + 1 :], "size": s.size} for s in shards]})
        target = self._path(self._manifest(version))
        partial = self._path(f"{self.root}/pending/{uuid.uuid4().hex}.json")
        stream = self._fs.create(partial)
        stream.write(bytearray(body.encode()))
        stream.close()
        self._fs.mkdirs(target.getParent())
        claim = self._path(f"{self.root}/claims/{version:010d}")
        try:
            self._claim(claim, version)
            # the claim is gone once the manifest is there, so a late writer of the same number must look for that
            if self._fs.exists(target) or not self._fs.rename(partial, target):
                raise CommitConflict(f"version {version} is taken")
            self._fs.delete(claim, False)
        finally:
            self._fs.delete(partial, False)
        return version

    def _write(self, df: DataFrame, kind: str, rows: int = 0) -> list[Shard]:
        """``rows``: most rows of a shard (0: as many as a task has)."""
        folder = f"{self.root}/data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(folder)
        files = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        return [Shard(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in files]

    def _drop(self, shards: list[Shard]) -> None:
        for shard in shards:
            self._fs.delete(self._path(shard.path), False)

    def append(self, df: DataFrame) -> int:
        """Add an arrival as small shards, one for each task; returns the version. An empty one commits a version too.

        A column that the store does not have yet is null in older rows, one that the arrival does not have in its own.
        """
        united(self.schema(), df.schema)
        return self.add(self._write(df, "arrival"), df.schema)

    def add(self, made: list[Shard], schema: StructType) -> int:
        """Commit shards that lie under the root already; tried again where another writer was first."""
        for left in range(TRIES, -1, -1):
            known = self.versions()
            try:
                at = known[-1] if known else 0
                return self._commit((self.shards(at) if at else []) + made, united(self.schema(at) if at else None, schema).json(), at)
            except CommitConflict:
                if not left:
                    self._drop(made)
                    raise
                time.sleep(0.05)

    def compact(self) -> int | None:
        """Merge runs, smallest tier first, until no tier holds one; returns the last version committed, or None."""
        done = None
        while chosen := runs(self.shards(), self.target, self.fanout):
            at = self.versions()[-1]
            merged = self._write(self._merged([s.path for s in chosen]), "merged")
            if len(merged) >= len(chosen):
                self._drop(merged)
                break
            paths = {s.path for s in chosen}
            try:
                done = self._commit([s for s in self.shards(at) if s.path not in paths] + merged, self.schema(at).json(), at)
            except CommitConflict:
                self._drop(merged)  # another writer was first: look again
                continue
            self.expire()
        return done

    def _merged(self, paths: list[str]) -> DataFrame:
        """The rows of shards, one partition for each target size; a session of its own, as packing is a session setting."""
        packing = self.spark.newSession()
        packing.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        packing.conf.set("spark.sql.files.openCostInBytes", "0")
        packing.conf.set("spark.sql.files.minPartitionNum", "1")
        packing.conf.set("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))
        return packing.read.schema(self.schema()).parquet(*paths)

    def expire(self) -> None:
        """Forget all but the last ``keep`` versions and remove shards that none of those name."""
        known = self.versions()
        kept, gone = known[-self.keep :], known[: -self.keep]
        named = {s.path for v in kept for s in self.shards(v)}
        dropped = {s.path for v in gone for s in self.shards(v)} - named
        for path in dropped:
            self._fs.delete(self._path(path), False)
        for v in gone:
            self._fs.delete(self._path(self._manifest(v)), False)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version (the last by default) with that version's columns."""
        shards = self.shards(version)
        if not shards:
            return self.spark.createDataFrame([], self.schema(version))
        return self.spark.read.schema(self.schema(version)).parquet(*[s.path for s in shards])


def ingest(df: DataFrame, root: str, arrivals: int = 8, target: int = TARGET, fanout: int = FANOUT) -> ShardStore:
    """Store a table under ``root``: it is written once as small shards, which arrive in ``arrivals`` appends, compacted
    after each.

    However few files the table has, each arrival has ``fanout`` shards or more if there are as many rows. Rows, repeated
    ones, nulls, long texts and columns of any name are kept as they are; an empty table is an empty store.
    """
    spark = df.sparkSession
    store = ShardStore(spark, root, target, fanout)
    each = max(1, -(-df.count() // (arrivals * fanout)))  # a limit of the shards' rows, so that there are enough shards
    made = sorted(store._write(df, "arrival", each), key=lambda s: s.path)
    step = max(1, math.ceil(len(made) / arrivals))
    for a in range(0, len(made), step):
        store.add(made[a : a + step], df.schema)
        store.compact()
    if not made:
        store.append(df)
    return store


def manifest(store: ShardStore) -> DataFrame:
    """(path, size, tier) of each shard of the last version."""
    rows = [(s.path, s.size, tier(s.size, store.target, store.fanout)) for s in store.shards()]
    return store.spark.createDataFrame(rows, "path string, size long, tier int")


SQL = "SELECT doc_id, text, lang, source, n_chars, md5(text) AS text_md5 FROM documents"


def checked(df: DataFrame) -> DataFrame:
    """``df`` with the MD5 of its text, so that a reader can prove each row whole."""
    return df.withColumn("text_md5", F.md5(F.col("text").cast("binary")))
