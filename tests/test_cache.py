import pytest
from corpus import documents
from pyspark.sql import functions as F

from tarn.operators.cache import BuildCache, open_cache
from tarn.operators.chunking import Chunking
from tarn.operators.index import BuildOptions, build
from tarn.plans.conventions import dropped_paths
from tarn.plans.search import open_index
from tarn.sources.directory import update_from_directory
from tarn.streaming.updates import stream_updates


def numbers(stats):
    return tuple(stats[k] for k in ("scanned", "new", "changed", "unchanged", "removed", "active_documents", "active_chunks"))


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "relative_path string")


def test_the_life_of_a_cache(spark, tmp_path):
    cache = BuildCache(spark, str(tmp_path / "cache"))
    docs = documents(spark)
    assert numbers(cache.update(docs)) == (3, 3, 0, 0, 0, 3, 6)
    assert numbers(cache.update(docs)) == (3, 0, 0, 3, 0, 3, 6)
    edited = docs.where("relative_path LIKE 'guides%'").withColumn("content", F.when(F.col("relative_path").contains("rust"), F.lit("one\n\ntwo\n\nthree")).otherwise(F.col("content")))
    assert numbers(cache.update(edited, paths(spark, "ops/network.md", "no/such.md"))) == (2, 0, 1, 1, 1, 2, 5)
    assert numbers(cache.update(docs.limit(0), paths(spark, "ops/network.md"))) == (0, 0, 0, 0, 0, 2, 5)
    assert numbers(cache.update(docs.where("relative_path LIKE 'ops%'"))) == (1, 0, 1, 0, 0, 3, 7)
    assert numbers(cache.update(docs.where("relative_path LIKE 'ops%'"), replace_all=True)) == (1, 0, 0, 1, 2, 1, 2)
    again = open_cache(spark, str(tmp_path / "cache"))
    assert again.info()["active_documents"] == 1 and [r.relative_path for r in again.active_chunks().select("relative_path").distinct().collect()] == ["ops/network.md"]


def test_a_path_in_both_lists_ends_up_removed(spark, tmp_path):
    cache = BuildCache(spark, str(tmp_path))
    assert numbers(cache.update(documents(spark), paths(spark, "guides/rust.md"))) == (3, 3, 0, 0, 1, 2, 4)


def test_another_configuration_starts_anew(spark, tmp_path):
    BuildCache(spark, str(tmp_path)).update(documents(spark))
    other = BuildCache(spark, str(tmp_path), BuildOptions(chunking=Chunking(100, 10)))
    assert numbers(other.update(documents(spark).limit(1)))[:6] == (1, 1, 0, 0, 0, 1)


def test_two_documents_of_one_path_are_an_error_and_change_nothing(spark, tmp_path):
    cache = BuildCache(spark, str(tmp_path))
    cache.update(documents(spark))
    with pytest.raises(ValueError, match="path"):
        cache.update(documents(spark).union(documents(spark)))
    assert cache.counts()["active_documents"] == 3


def test_an_export_equals_a_build(spark, tmp_path):
    cache = BuildCache(spark, str(tmp_path / "c"))
    cache.update(documents(spark))
    cache.export_index(str(tmp_path / "a"))
    build(spark, documents(spark), str(tmp_path / "b"))
    a, b = (open_index(spark, str(tmp_path / n)) for n in "ab")
    for name in a.tables:
        assert sorted(map(str, a.tables[name].collect())) == sorted(map(str, b.tables[name].collect())), name


def test_dropped_paths(spark):
    docs = documents(spark)
    assert [r[0] for r in dropped_paths(docs, docs.where("relative_path NOT LIKE 'ops%'")).collect()] == ["ops/network.md"]


def test_update_from_directory(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.md").write_text("one")
    (root / "b.md").write_text("two")
    cache = BuildCache(spark, str(tmp_path / "c"))
    assert numbers(update_from_directory(cache, root, git=True)) == (2, 2, 0, 0, 0, 2, 2)  # no work tree: all is read
    (root / "b.md").unlink()
    assert numbers(update_from_directory(cache, root)) == (1, 0, 0, 1, 1, 1, 1)


def test_a_stream_of_changes(spark, tmp_path):
    cache = BuildCache(spark, str(tmp_path / "cache"))
    source = tmp_path / "in"
    schema = "relative_path string, content string, removed boolean, sequence long"
    rows = [("a.md", "one", False, 1), ("a.md", "two", False, 2), ("b.md", "x", None, 3)]
    spark.createDataFrame(rows, schema).write.parquet(str(source / "1"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    stream_updates(read(), cache, str(tmp_path / "check")).awaitTermination()
    assert cache.counts()["active_documents"] == 2
    spark.createDataFrame([("b.md", None, True, 4), ("c.md", "y", False, 5)], schema).write.parquet(str(source / "2"))
    stream_updates(read(), cache, str(tmp_path / "check")).awaitTermination()
    assert {r.relative_path for r in cache.active_documents().collect()} == {"a.md", "c.md"}
    assert cache.active_chunks().where("relative_path = 'a.md'").first().chunk_text == "two"
