import numpy as np
import pytest

from tarn.llm import ego, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, block string"


def vectors(n=300, size=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x[50:80] = x[20:50] + 0.08 * rng.normal(size=(30, size))
    x[80:90] = x[10]  # ties
    return [(i, [float(f) for f in np.float32(r)], 0, "x", "y", "z") for i, r in enumerate(x)]


def odd(rows):
    size = len(rows[0][1])
    bad = [None, [], [1.0] * (size + 1), [float("nan")] * size, [float("inf")] * size, [None] * size]
    return rows + rows[:3] + [(5000 + i, v, None, None, None, None) for i, v in enumerate(bad)] + [(None, rows[0][1], 0, "", "", ""), (6000, [0.0] * size, 0, "", "", ""), (7, rows[8][1], 0, "", "", "")]


def millionths(rows):
    """Best cosine of each ordered pair of ids, in millionths."""
    good = [(r[0], np.array(r[1], dtype=float)) for r in rows if r[0] is not None and r[1] and len(r[1]) == len(rows[0][1]) and None not in r[1] and np.isfinite(r[1]).all()]
    ids, m = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    norm = np.linalg.norm(m, axis=1)
    m = m / np.where(norm > 0, norm, 1)[:, None]
    s = np.rint(m @ m.T * 1e6).astype(int)
    best = {}
    for i, a in enumerate(ids.tolist()):
        for j, b in enumerate(ids.tolist()):
            if a != b:
                best[a, b] = max(best.get((a, b), -(10**9)), s[i, j])
    return best


def close(a, b):
    """Equal but for the last digit, where a product is rounded differently."""
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1 for k in a)


@pytest.mark.parametrize("k, block, slack", [(10, 64, 54), (3, 50, 0), (1000, 128, 54)])
def test_search_equals_brute_force(spark, monkeypatch, k, block, slack):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLACK", slack)
    rows = odd(vectors())
    best = millionths(rows)
    got = {}
    for r in topk.search(spark.createDataFrame(rows, SCHEMA), k, 1 if k == 3 else topk.EVERY).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.neighbor_id, round(r.score * 1e6))
    queries = {a for a, _ in best if k == 3 or a % topk.EVERY == 0}
    assert set(got) == queries
    for q in queries:
        want = sorted(((-s, b) for (a, b), s in best.items() if a == q))[:k]
        assert len(got[q]) == len(want)
        for rank, (s, b) in enumerate(want, 1):
            assert abs(got[q][rank][1] + s) <= 1 and (got[q][rank][0] == b or abs(best[q, got[q][rank][0]] + s) <= 1)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0], 0, "", "", "") for i in (9, 4, 2, 7)]
    got = sorted((r.query_id, r["rank"], r.neighbor_id) for r in topk.search(spark.createDataFrame(rows, SCHEMA), 2, 1).collect())
    assert got == [(2, 1, 4), (2, 2, 7), (4, 1, 2), (4, 2, 7), (7, 1, 2), (7, 2, 4), (9, 1, 2), (9, 2, 4)]


@pytest.mark.parametrize("least, block", [(0.9, 32), (0.5, 64), (0.99, 16), (1.0, 2048)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, least, block):
    monkeypatch.setattr(ego, "BLOCK", block)
    monkeypatch.setattr(ego, "SHORT", 8)
    rows = odd(vectors(seed=1))
    want = {(a, b): s for (a, b), s in millionths(rows).items() if a < b and s >= round(least * 1e6)}
    df = spark.createDataFrame(rows, SCHEMA)
    member, pairs = ego.near_duplicates(df, least)
    groups = {}
    for r in member.collect():
        groups.setdefault(r.node, set()).add(r.id)
    got = {(x, y): 1_000_000 for ids in groups.values() for x in ids for y in ids if x < y}
    for r in pairs.collect():
        for x in groups[r.a]:
            for y in groups[r.b]:
                got[min(x, y), max(x, y)] = max(got.get((min(x, y), max(x, y)), 0), round(r.similarity * 1e6))
    got = {pair: s for pair, s in got.items() if pair[0] != pair[1]}
    assert want
    close(got, want)


def test_classes_of_vectors(spark):
    rows = [r for r in vectors(seed=1)]
    pairs = [(a, b) for (a, b), s in millionths(rows).items() if a < b and s >= 900_000]
    name, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        low, high = sorted((name[a], name[b]))
        name = {d: low if c == high else c for d, c in name.items()}
    got = {r.vec_id: (r.class_id, r.links) for r in ego.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: (name[d], links[d]) for d in name} and max(links.values()) >= 10


def test_many_vectors_of_one_id(spark, monkeypatch):
    """An id whose vectors fill blocks counts once, by its best, and leaves room for the others."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(f) for f in rng.normal(size=6)], 0, "", "", "") for i in range(60)] + [(7, [float(f) for f in rng.normal(size=6)], 0, "", "", "") for _ in range(50)]
    best = millionths(rows)
    for q in (0, 20, 40):
        want = sorted(((-s, b) for (a, b), s in best.items() if a == q))[:5]
        got = [(r.neighbor_id, round(r.score * 1e6)) for r in topk.search(spark.createDataFrame(rows, SCHEMA), 5).where(f"query_id = {q}").orderBy("rank").collect()]
        assert [b for b, _ in got] == [b for _, b in want]


def test_empty_and_single(spark):
    one = spark.createDataFrame(vectors(1 + 90)[:1], SCHEMA)
    nothing = spark.createDataFrame([(1, None, 0, "", "", ""), (2, [], 0, "", "", "")], SCHEMA)
    for table in (one.limit(0), one, nothing):
        assert topk.search(table).count() == 0 and ego.near_duplicates(table)[1].count() == 0
    assert [tuple(r) for r in ego.classes(one).collect()] == [(0, 0, 0)] and ego.classes(nothing).count() == 0


def test_least_is_checked(spark):
    with pytest.raises(ValueError):
        ego.near_duplicates(spark.createDataFrame([], SCHEMA), 0)
