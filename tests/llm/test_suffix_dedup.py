import collections
import random

import numpy as np
import pytest
from fixtures import SCHEMA, empty, odd, odd_rows, words

from tarn.llm import repeats
from tarn.llm.suffix import BlockQueue, Scratch, _doubled, suffix_array


def by_hand(x):
    x = list(map(int, x))
    order = sorted(range(len(x)), key=lambda i: x[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        shared.append(k)
    return order, shared[: len(x)]


@pytest.mark.parametrize("in_memory", [0, 1 << 20])
@pytest.mark.parametrize("kinds", [1, 2, 3, 40, 300, 70_000])
def test_suffix_array(kinds, in_memory, tmp_path):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 3, 17, 90, 200):
        x = rng.integers(0, kinds, n)
        x = np.concatenate([x, x[: n // 2], x, x[n // 3 :]])
        want = by_hand(x) if len(x) else ([], [])
        scratch = Scratch(str(tmp_path), 64, in_memory)  # nearly all arrays in files
        got = suffix_array(x, scratch)
        scratch.close()
        assert got[0].tolist() == want[0] and got[1].tolist() == want[1]
        if n:
            assert _doubled(x)[1].tolist() == want[1]
    assert not list(tmp_path.iterdir())


def test_queue_is_first_come_first_served(tmp_path):
    rng, queue, want = np.random.default_rng(1), BlockQueue(Scratch(str(tmp_path), 32)), collections.defaultdict(list)
    for n in range(300):
        keys = np.sort(rng.integers(0, 20, 9))
        places = np.arange(9, dtype=np.int32) + 9 * n
        queue.push(keys, places, places)
        for k, p in zip(keys.tolist(), places.tolist()):
            want[k].append(p)
    assert all(queue.pop(k)[0].tolist() == want[k] for k in range(20))


def spans_by_hand(docs, least):
    seen = collections.defaultdict(set)
    for d, t in docs:
        if d is not None and t is not None:
            w = words(t)
            for i in range(len(w) - least + 1):
                seen[tuple(w[i : i + least])].add((d, i))
    marks = collections.defaultdict(set)
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                marks[d, (d, i) == min(places)].update(range(i, i + least))
    return dict(marks)


def marks_of(df):
    got = collections.defaultdict(set)
    for r in df.collect():
        got[r.doc_id, r["first"]].update(range(r.start, r.stop))
    return dict(got)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(rng.choice([8, 20, 35, 90])) for _ in range(6)]
    docs = []
    for d in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += draw(rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        docs.append((d, " ".join(parts)))
    return docs + [(100 + i, docs[3][1]) for i in range(30)]


@pytest.mark.parametrize("least, gram", [(10, 4), (12, 12), (50, 10)])
def test_spans_equal_brute_force(spark, least, gram):
    docs = planted(least)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert marks_of(repeats.spans(df, least, gram, shard_words=1500, memory=1000)) == spans_by_hand(docs, least)


def test_repeats_inside_one_document_do_not_count(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 40), (1, "a b c d e f g h " * 40), (2, "x y z")], "doc_id long, text string")
    assert repeats.spans(df).count() == 0


def test_odd_documents(spark):
    # rows of one id count as one document: only the rest is compared with brute force
    rows = [r for r in odd_rows() if r[0] != 0]
    df = spark.createDataFrame(rows, SCHEMA)
    assert marks_of(repeats.spans(df)) == spans_by_hand({(r[0], r[1]) for r in rows}, 50)
    assert {1, 20} <= {r.doc_id for r in repeats.spans(odd(spark)).collect()}


def test_removal(spark):
    df = odd(spark)
    kept = repeats.remove(df)
    assert kept.columns == df.columns
    rows = {r.doc_id: r.text for r in kept.where("doc_id > 1").collect()}
    assert rows[2] is None and rows[3] == "" and rows[5] == "§ — …"
    assert rows[8].startswith("word") and words(rows[9])[-1] == "tail" and len(words(rows[9])) <= 50
    assert 11 not in rows and 20 not in rows  # of which no word stays
    assert len(words(rows[12])) == 70 and kept.where("doc_id IS NULL").count() == 2
    left = [(r.doc_id, r.text) for r in kept.where("doc_id <> 0").dropDuplicates(["doc_id"]).collect()]
    assert spans_by_hand(left, 50) == {}
    assert all(r.n_chars == len(r.text) for r in kept.where("doc_id IN (9, 12)").collect())


def test_empty(spark):
    assert repeats.spans(empty(spark)).count() == 0 and repeats.remove(empty(spark)).count() == 0


def test_cut_words():
    assert repeats.cut_words("é one, two. Three!", [1], [3]) == "é Three!"
    assert repeats.cut_words("one two", [0], [2]) == ""
    with pytest.raises(ValueError):
        repeats.spans(None, least=5, gram=6)
