import random

import pytest
from fixtures import empty, odd

from tarn.llm import shards
from tarn.llm.shards import CommitConflict, Shard, ShardStore


def numbers(spark, a, b):
    return spark.range(a, b).selectExpr("id", "repeat(md5(cast(id as string)), 20) AS pad")


def sizes(store):
    return sorted(s.size for s in store.shards())


def test_tiers():
    assert [shards.tier(s, 1024, 4) for s in (4096, 1024, 600, 256, 64, 16, 0)] == [0, 0, 0, 1, 2, 3, 5]


def test_runs_are_of_similar_size():
    made = [Shard(str(i), s) for i, s in enumerate([1000, 60, 64, 70, 250])]
    assert shards.runs(made, 1024, 4) == []
    made.append(Shard("5", 65))
    assert sorted(s.size for s in shards.runs(made, 1024, 4)) == [60, 64, 65, 70]
    made.append(Shard("6", 5))
    assert sorted(s.size for s in shards.runs(made, 1024, 4)) == [5, 60, 64, 65, 70]


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), target=200_000)
    for i in range(12):
        store.append(numbers(spark, 500 * i, 500 * (i + 1)).coalesce(1))
        store.compact()
        assert store.read().count() == 500 * (i + 1)
    assert len(store.shards()) <= 8
    assert sorted(r.id for r in store.read().collect()) == list(range(6000))
    named = {s.path for v in store.versions() for s in store.shards(v)}
    assert len(store.versions()) <= 2 + 1 and {str(p) for p in tmp_path.rglob("part-*.parquet")} == {p.removeprefix("file://") for p in named}


def test_readers_keep_their_version(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), keep=3)
    first = store.append(numbers(spark, 0, 10))
    store.append(numbers(spark, 10, 30))
    assert store.read(first).count() == 10 and store.read().count() == 30 and store.versions() == [1, 2]


def test_two_writers_of_one_version(spark, tmp_path):
    store, other = ShardStore(spark, str(tmp_path)), ShardStore(spark, str(tmp_path))
    store.append(numbers(spark, 0, 5))
    with pytest.raises(CommitConflict):
        other._commit([], numbers(spark, 0, 1).schema.json(), 0)
    assert store.read().count() == 5


def test_ingest_of_odd_documents(spark, tmp_path):
    odd(spark).repartition(5).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    store = shards.ingest(df, str(tmp_path / "store"), arrivals=3, target=1 << 20)
    assert store.read().columns == df.columns
    assert sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert shards.manifest(store).count() == len(store.shards())


def test_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "in"))
    store = shards.ingest(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "store"))
    assert store.read().count() == 0 and store.read().columns == empty(spark).columns
    assert ShardStore(spark, str(tmp_path / "none")).versions() == []


def test_random_arrivals(spark, tmp_path):
    rng, store, total = random.Random(1), ShardStore(spark, str(tmp_path), target=60_000, fanout=3), 0
    for _ in range(8):
        n = rng.choice([1, 50, 400, 1500])
        store.append(numbers(spark, total, total + n).repartition(rng.choice([1, 3])))
        total += n
        store.compact()
    assert store.read().distinct().count() == total
    assert shards.runs(store.shards(), store.target, store.fanout) == [] or len(store.shards()) < 30


def test_columns_come_and_go(spark, tmp_path):
    """Arrivals of differing columns: none is lost by compaction, and an old version is read with its own."""
    store = ShardStore(spark, str(tmp_path), keep=20)
    one = store.append(spark.range(3).selectExpr("id", "id * 2 AS extra").coalesce(1))
    for a in (3, 6, 9):
        store.append(spark.range(a, a + 3).coalesce(1))
    last = store.append(spark.range(12, 13).selectExpr("id", "'x' AS name"))
    assert store.compact() > last and len(store.shards()) < 5
    assert store.read().columns == ["id", "extra", "name"] and store.read(one).columns == ["id", "extra"]
    got = {r.id: (r.extra, r.name) for r in store.read().collect()}
    assert got == {i: (2 * i if i < 3 else None, "x" if i == 12 else None) for i in range(13)}
    with pytest.raises(ValueError):
        store.append(spark.range(1).selectExpr("cast(id AS string) AS id"))
    assert store.read().count() == 13


def test_a_dead_writers_claim_is_taken_over(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), patience=0.0)
    store.append(numbers(spark, 0, 5))
    (tmp_path / "claims").mkdir(exist_ok=True)
    (tmp_path / "claims" / f"{2:010d}").touch()
    assert store.append(numbers(spark, 5, 7)) == 2 and store.read().count() == 7
    patient = ShardStore(spark, str(tmp_path), patience=3600.0)
    (tmp_path / "claims" / f"{3:010d}").touch()
    with pytest.raises(CommitConflict):
        patient._commit([], numbers(spark, 0, 1).schema.json(), 2)
    assert not list((tmp_path / "pending").glob("*.json"))


def test_conflicts_leave_no_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "TRIES", 1)
    store = ShardStore(spark, str(tmp_path), patience=3600.0)
    store.append(numbers(spark, 0, 5))
    before = sorted(tmp_path.rglob("part-*.parquet"))
    (tmp_path / "claims" / f"{2:010d}").touch()
    with pytest.raises(CommitConflict):
        store.append(numbers(spark, 5, 7))
    assert sorted(tmp_path.rglob("part-*.parquet")) == before and store.read().count() == 5


def test_one_file_arrives_in_several_appends(spark, tmp_path):
    numbers(spark, 0, 4000).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = shards.ingest(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "store"), target=1 << 20)
    assert store.versions()[-1] > 8 and len(store.shards()) < 32
    assert sorted(r.id for r in store.read().collect()) == list(range(4000))
