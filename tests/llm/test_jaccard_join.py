import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from fixtures import empty, odd, odd_rows, prose, word_sets

from tarn.llm import jaccard
from tarn.llm.graph import components


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
    return " ".join(w)


def pairs_by_hand(docs, threshold=jaccard.THRESHOLD):
    sets = {}
    for d, t in docs:
        if d is not None and t is not None:
            sets.setdefault(d, []).append(word_sets(t))
    ids = sorted(sets)
    score = lambda a, b: max(len(x & y) / len(x | y) if x | y else 0 for x in sets[a] for y in sets[b])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if score(a, b) >= threshold}


def expanded(found):
    """Pairs of documents that members and pairs of ``near`` stand for."""
    member, pairs = found
    groups = {}
    for row in member.collect():
        groups.setdefault(row.node, set()).add(row.id)
    out = {(x, y) for ids in groups.values() for x in ids for y in ids if x < y}
    for row in pairs.collect():
        assert row.a < row.b
        out |= {tuple(sorted((x, y))) for x in groups[row.a] for y in groups[row.b] if x != y}
    return out


def classes_by_hand(ids, pairs):
    """Class and number of links of each id."""
    name, links = {d: d for d in ids}, dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        low, high = sorted((name[a], name[b]))
        name = {d: low if c == high else c for d, c in name.items()}
    return {d: (name[d], links[d]) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs, d = [], 0
    for _ in range(120):
        base = prose(rng, rng.randint(5, 150))
        for k in range(rng.choice([1, 1, 2, 4])):
            docs.append((d, base if k == 3 else near(rng, base, rng.choice([0, 1, 2, 4, 6]) * k)))
            d += 1
    want = pairs_by_hand(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = expanded(jaccard.near(df))
    assert got <= want and len(got) >= jaccard.RECALL * len(want) > 30
    found = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()}
    assert found == classes_by_hand([d for d, _ in docs], got)


def test_a_large_group_needs_many_squares(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 7)
    rng = random.Random(3)
    base = prose(rng, 100)
    docs = [(i, near(rng, base, 2)) for i in range(40)]
    want = pairs_by_hand(docs)
    got = expanded(jaccard.near(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got <= want and len(got) >= jaccard.RECALL * len(want)


@pytest.mark.parametrize("hot, small", [(40, 24), (100_000, 2)])
def test_hot_nodes_are_dealt_out_and_large_buckets_split(spark, monkeypatch, hot, small):
    """Texts that share a long passage, so that many unlike sets meet in its nodes, with near copies among them."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng = random.Random(6)
    shared = prose(rng, 40, 5000)
    bases = [shared + " " + prose(rng, 80, 5000) for _ in range(150)]
    docs = list(enumerate(bases + [near(rng, b, 4) for b in bases[:40]]))
    want = pairs_by_hand(docs)
    got = expanded(jaccard.near(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got <= want and len(got) >= jaccard.RECALL * len(want) > 30


@pytest.mark.parametrize("n, before", [(300, 0), (300, 3)])
def test_a_hot_node_may_come_first(monkeypatch, n, before):
    """A node of more sets than a task holds is dealt out to its children, whether or not rows of other nodes come before it."""
    monkeypatch.setattr(jaccard, "HOT", 40)
    rng = np.random.default_rng(2)
    node, child = np.array([5] * before + [77] * n), rng.integers(100, 110, before + n)
    sketch = rng.integers(0, 2**63, (before + n, jaccard.COORDINATES // 16), dtype=np.uint64)
    links = np.stack([node, child], axis=1).astype(np.uint64)
    columns = [pa.array(node), pa.array(np.arange(before + n)), pa.array(np.arange(before + n)), pa.array(np.full(before + n, 300))]
    columns += [jaccard.common.binary_rows(x.reshape(-1), np.full(before + n, x.shape[1])) for x in (sketch, links)]
    batch = pa.record_batch(columns, ["node", "doc_id", "whole", "size", "sketch", "more"])
    out = pa.Table.from_batches(jaccard._split(jaccard.THRESHOLD)(iter([batch.slice(a, 50) for a in range(0, before + n, 50)])))
    dealt = [(r["node"], r["doc_id"]) for r in out.to_pylist() if r["a"] is None]
    assert sorted(dealt) == sorted(zip(child[before:].tolist(), range(before, before + n)))


def test_a_large_group_of_near_copies_takes_bounded_rows():
    """A bucket's rows follow its sets, not its pairs, which are all alike here, and its pairs take no memory."""
    rng = np.random.default_rng(1)
    n = 6000
    sketch = np.repeat(rng.integers(0, 2**63, (1, jaccard.COORDINATES // 16), dtype=np.uint64), n, axis=0)
    node = np.full(n, 77)
    no = pa.array([b""] * n, pa.binary())
    columns = [node, np.arange(n), np.arange(n), np.full(n, 300), jaccard.common.binary_rows(sketch.reshape(-1), np.full(n, sketch.shape[1])), no]
    batch = pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["node", "doc_id", "whole", "size", "sketch", "more"])
    tracemalloc.start()
    out = pa.Table.from_batches(jaccard._split(jaccard.THRESHOLD)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows < n and peak < 150e6
    edges = list(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    assert all(a < b for a, b in edges) and len({b for _, b in edges} | {0}) == n


def test_classes_of_a_large_group_count_every_link(spark, monkeypatch):
    """Links and classes come from sums over squares; no table has a row a pair."""
    monkeypatch.setattr(jaccard, "SIDE", 9)
    rng = random.Random(8)
    base, other = prose(rng, 100), prose(rng, 60)
    docs = [(i, near(rng, base, 3)) for i in range(60)] + [(100 + i, near(rng, other, 9)) for i in range(30)]
    docs += [(200 + i, docs[i][1]) for i in range(0, 60, 7)]
    want = classes_by_hand([d for d, _ in docs], pairs_by_hand(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    staged, rows = jaccard.common.staged, {}

    def counted(df, name):
        df = staged(df, name)
        rows[name] = df.count()
        return df

    monkeypatch.setattr(jaccard.common, "staged", counted)
    found = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df).collect()}
    assert found == want
    assert rows["candidates"] < 20 * len(docs) and rows["pairs"] < 12 * len(docs)


def test_odd_documents(spark):
    docs = [(r[0], r[1]) for r in odd_rows() if r[0] != 0]
    df = odd(spark).where("doc_id IS NULL OR doc_id <> 0")
    assert expanded(jaccard.near(df)) == pairs_by_hand(docs) == {(1, 20), (8, 9), (10, 11), (11, 12)}
    found = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(df, threshold=0.7).collect()}
    assert found == classes_by_hand({d for d, _ in docs if d is not None}, pairs_by_hand(docs, 0.7))
    every = {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(odd(spark)).collect()}
    assert every[0] == every[1] == every[20] == (0, 2)  # 0 has one text that equals 1's
    assert every[2] == (2, 0) and every[3] == (3, 0) and None not in every


def test_deduplication_keeps_one_of_each_group(spark):
    df = odd(spark).where("doc_id IS NULL OR doc_id <> 0")
    kept = jaccard.deduplicate(df, threshold=0.7)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 8, 10, 11, 12, 13, 14, 15]
    assert kept.where("doc_id IS NULL").count() == 2


def test_deduplication_of_a_large_group_writes_no_row_a_pair(spark, monkeypatch):
    """The pipeline's second stage: one document of a group stays, and its tables follow the documents."""
    rng = random.Random(12)
    base = prose(rng, 80)
    docs = [(i, near(rng, base, 1)) for i in range(150)] + [(1000, prose(rng, 80))]
    staged, rows = jaccard.common.staged, {}

    def counted(df, name):
        df = staged(df, name)
        rows[name] = df.count()
        return df

    monkeypatch.setattr(jaccard.common, "staged", counted)
    kept = jaccard.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1000]
    assert "keyed" not in rows and rows["pairs"] < 2 * len(docs)


def test_empty(spark):
    assert jaccard.classes(empty(spark)).count() == 0 and jaccard.deduplicate(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs_needed(0.9) < jaccard.runs_needed(0.99) < 20
    with pytest.raises(ValueError):
        jaccard.runs_needed(1 - 1e-9)
