import collections

import pytest
import tiktoken
from fixtures import empty, odd, words

import __spark_entry__
import corpus_pipeline
from tarn.llm import bpe, jaccard, mixing, queries, quality
from tarn.llm.common import DOCUMENT_COLUMNS, staged, table

SF = "/root/testdata/sf0.001"


def test_registry():
    assert [int(q[2:].split("_")[0]) for q in sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage on a small corpus."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(stages):
    assert all(after.columns == DOCUMENT_COLUMNS for _, after in stages[:-1])


def test_quality_stage(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    kept = set(ids(after))
    good = [d in kept for d, r in labels.items() if r.quality == 1 and not r.toxic]
    bad = [d in kept for d, r in labels.items() if r.quality == 0]
    assert sum(good) / len(good) >= 0.9 and sum(bad) / len(bad) <= 0.5
    assert kept == set(ids(quality.select(before, table(spark, SF, "labels"))))


def test_jaccard_stage(stages):
    before, after = stages[1]
    sets = {}
    for r in before.collect():
        w = words(r.text or "")
        sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= jaccard.THRESHOLD * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted(d for d in order if find(d) == d)
    got = sorted(ids(after))
    assert set(want) <= set(got) and len(got) - len(want) <= 0.1 * max(1, len(order) - len(want))


@pytest.mark.parametrize("whole", [True, False])
def test_suffix_stage(spark, stages, whole):
    before, after = stages[2]
    if whole:  # all documents: what the stages before leave of this small corpus has no repeats
        before = table(spark, SF, "documents")
        after = staged(corpus_pipeline.repeats_stage(spark, before, SF), "whole")

    def repeated(df):
        seen = collections.defaultdict(set)
        for r in df.collect():
            w = words(r.text or "")
            for i in range(len(w) - 49):
                seen[tuple(w[i : i + 50])].add(r.doc_id)
        return {d for s in seen.values() if len(s) > 1 for d in s}

    assert (repeated(before) or not whole) and repeated(after) == set()
    touched = repeated(before)
    clean = {r.doc_id: r.text for r in before.collect() if r.doc_id not in touched}
    assert {r.doc_id: r.text for r in after.collect() if r.doc_id in clean} == clean


def test_mixing_stage(stages):
    before, after = stages[3]
    assert sorted(ids(after)) == sorted(ids(mixing.select(before)))
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_bpe_stage(stages):
    before, after = stages[4]
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    assert {r.doc_id: r.tokens for r in after.collect()} == {r.doc_id: coder.encode_ordinary(r.text) for r in before.collect()}


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1][1].collect()))


@pytest.mark.parametrize("made", [odd, empty])
def test_stages_on_odd_documents(spark, made):
    docs = made(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, SF), name)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == DOCUMENT_COLUMNS
    assert (docs.count() == 0) == (made is empty)
