"""Documents of a folder of text files, and changes of one that git knows."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.cache import BuildCache
from tarn.sources.frontmatter import parsed
from tarn.sources.ignore import SUFFIXES, visible_files

PATHS_A_READ = 10_000


def _literal(path: Path) -> str:
    """A path as Spark takes it, without the meaning that some characters have in patterns."""
    return "file://" + re.sub(r"([\[\]{}*?\\])", r"\\\1", str(path))


def documents_at(spark: SparkSession, root: str | Path, paths: Iterable[str]) -> DataFrame:
    """Input documents of the files at relative paths under ``root``; the files are read by the executors."""
    root = Path(root).resolve()
    paths = sorted(paths)
    if not paths:
        return spark.createDataFrame([], "doc_id string, source_path string, relative_path string, title string, summary string, canonical_url string, content string, metadata_json string")
    out = None
    for a in range(0, len(paths), PATHS_A_READ):
        rows = spark.createDataFrame([(p, str(root / p)) for p in paths[a : a + PATHS_A_READ]], "relative_path string, source_path string")
        raw = spark.read.format("binaryFile").load([_literal(root / p) for p in paths[a : a + PATHS_A_READ]])
        raw = raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("source_path"), F.decode("content", "UTF-8").alias("source"))
        part = rows.join(raw, "source_path")
        out = part if out is None else out.union(part)
    return out.withColumn("f", parsed(F.col("source"), F.col("relative_path"))).select(F.lit(None).cast("string").alias("doc_id"), "source_path", "relative_path", "f.*")


def read_directory(spark: SparkSession, root: str | Path) -> DataFrame:
    """Input documents of all files under ``root`` that count (see ``ignore.visible_files``)."""
    return documents_at(spark, root, visible_files(root))


def read_bucket(spark: SparkSession, root: str) -> DataFrame:
    """Input documents under any path that Spark reads, listed by Spark itself; hidden and generated folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    relative = F.ltrim(F.regexp_replace(F.element_at(F.split("path", base, 2), 2), "^/+", ""))
    rows = raw.select(F.col("path").alias("source_path"), relative.alias("relative_path"), F.decode("content", "UTF-8").alias("source"))
    rows = rows.where(F.col("relative_path").rlike(r"\.(md|mdx|txt)$") & ~F.col("relative_path").rlike(r"(^|/)(\.[^/]*|(node_modules|target|dist|build)/.*)"))
    return rows.withColumn("f", parsed(F.col("source"), F.col("relative_path"))).select(F.lit(None).cast("string").alias("doc_id"), "source_path", "relative_path", "f.*")


def _git(root: Path, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def name_status(data: bytes) -> tuple[set[str], set[str]]:
    """(changed, removed) paths from NUL-separated status output. A copy's source stays; a rename's goes."""
    fields = [f.decode(errors="replace") for f in data.split(b"\0") if f]
    changed, removed, i = set(), set(), 0
    while i < len(fields):
        code = fields[i][0]
        if code in "RC":
            if code == "R":
                removed.add(fields[i + 1])
            changed.add(fields[i + 2])
            i += 3
        else:
            (removed if code == "D" else changed).add(fields[i + 1])
            i += 2
    return changed, removed


def git_changes(root: str | Path, base: str | None = None) -> tuple[list[str], list[str]]:
    """(changed, removed) relative paths under ``root``: of the work tree against HEAD, or since ``base`` was left."""
    root = Path(root).resolve()
    asked = [["diff", "--name-status", "-z", "--relative"], ["diff", "--name-status", "-z", "--relative", "--cached"]]
    if base:
        asked.append(["diff", "--name-status", "-z", "--relative", f"{base}...HEAD"])
    changed, removed = set(), set()
    for args in asked:
        c, r = name_status(_git(root, *args))
        changed |= c
        removed |= r
    changed |= {f.decode(errors="replace") for f in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split(b"\0") if f}
    there = {p for p in changed | removed if (root / p).is_file()}
    seen = set(visible_files(root))
    return sorted(p for p in there if p in seen), sorted(p for p in (changed | removed) - there if p.endswith(SUFFIXES))


def update_from_directory(cache: BuildCache, root: str | Path, git: bool = False, base: str | None = None, conventions=None) -> dict:
    """Bring a cache up to date with a folder: by git's changes if wanted and possible, else by reading all of it."""
    spark = cache.spark
    if git:
        try:
            changed, removed = git_changes(root, base)
        except (RuntimeError, OSError):
            git = False
    paths = changed if git else visible_files(root)
    docs = documents_at(spark, root, paths)
    gone = spark.createDataFrame([(p,) for p in removed], "relative_path string") if git else None
    if conventions is not None:
        kept = conventions.documents(docs)
        if git:
            gone = gone.union(docs.select("relative_path").join(kept.select("relative_path"), "relative_path", "left_anti"))
        docs = kept
    return cache.update(docs, gone, replace_all=not git)
