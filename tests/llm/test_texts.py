"""Language-model scores, the quality classifier, byte-level BPE and mixing."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from fixtures import SCHEMA, empty, labels, odd, odd_rows, prose, words
from pyspark.sql import functions as F

from tarn.llm import bpe, common, lm, mixing, quality, textvec


def parquet(df, tmp_path, name):
    path = str(tmp_path / f"{name}.parquet")
    df.write.parquet(path)
    return f"'{path}/*.parquet'"


def in_duckdb(tmp_path, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({parquet(df, tmp_path, name)})")
    return con.execute(sql).df()


def same(spark_df, frame):
    got = spark_df.toPandas()
    order = sorted(frame.columns)
    assert sorted(got.columns) == order
    key = lambda f: sorted(map(repr, f[order].astype(object).where(f[order].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(frame)


# language models


def losses_by_hand(rows, good_ids):
    """n_tokens, target and background loss of each row, from counts in dictionaries."""
    texts = [(d, words(t or "")) for d, t in rows]
    counts = Counter(w for _, ws in texts for w in ws)
    least = lm.LEAST
    names = [(d, [w if counts[w] >= least else None for w in ws]) for d, ws in texts]
    size = len({w for w in counts if counts[w] >= least}) + 2
    out = []
    models = []
    for only in (True, False):
        uni, bi = Counter(), Counter()
        for d, ws in names:
            if ws and (not only or d in good_ids):
                uni.update(["</s>", *ws])
                bi.update(zip(["</s>", *ws], [*ws, "</s>"]))
        models.append((uni, bi, sum(uni.values())))
    for d, ws in names:
        row = []
        for uni, bi, total in models:
            loss = 0.0
            for v, w in zip(["</s>", *ws], [*ws, "</s>"]):
                weight = lm.LAMBDA if uni[v] else 0
                p = (weight * bi[v, w] / uni[v] if uni[v] else 0) + (1 - weight) * (uni[w] + lm.ALPHA) / (total + lm.ALPHA * size)
                loss -= math.log(p)
            row.append(round(loss / (len(ws) + 1), 6) if ws else None)
        out.append((d, len(ws), *row))
    return out


@pytest.mark.parametrize("good", [[0, 1, 10, None, 10, 999], [], [999]])
def test_scores_equal_counts_by_hand(spark, good):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = lm.score(odd(spark), spark.createDataFrame([(g,) for g in good], "doc_id long")).collect()
    want = losses_by_hand(rows, {g for g in good if g is not None})
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[3] or 0)
    for g, w in zip(sorted([tuple(r) for r in got], key=order), sorted(want, key=order), strict=True):
        assert g[:2] == w[:2]
        if w[2] is None:
            assert g[2:] == (None, None, None)
        else:
            assert g[2:4] == pytest.approx(w[2:], abs=2e-6) and g[4] == pytest.approx(w[2] - w[3], abs=2e-6)


def test_scores_of_an_empty_table(spark):
    assert lm.score(empty(spark), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_vocabulary_does_not_shrink_as_the_corpus_grows(spark):
    rows = [(0, "the " * 2_500_000), (1, "rare the"), (2, "the rare"), (3, "once the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    total, ends, known = 2_500_006, 4, 4  # words; texts; words of the vocabulary with both special ones
    uniform = lambda n: 0.5 * (n + lm.ALPHA) / (total + ends + lm.ALPHA * known)
    want = [0.5 / ends + uniform(2), 0.5 / 2 + uniform(2_500_003), 0.5 * 3 / 2_500_003 + uniform(ends)]
    assert got[1].background_loss == pytest.approx(-sum(map(math.log, want)) / 3, abs=2e-6)
    assert got[1].background_loss != got[3].background_loss


def moved(spark):
    """Bytes that each stage has written to shuffles, by the stage's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_a_text_is_moved_once_for_its_scores(spark):
    """A block's places of words, and the totals of its words, are not sent on with its bigrams."""
    rng = random.Random(21)
    rows = [(d, " ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(400))) for d in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    good = spark.createDataFrame([(d,) for d in range(0, 2000, 9)], "doc_id long")
    before = moved(spark)
    assert lm.score(docs, good).agg(F.count("score")).first()[0] == 2000
    after = moved(spark)
    assert sum(after[k] for k in after.keys() - before.keys()) < 0.6 * sum(len(t) for _, t in rows)


def test_target_of(spark):
    assert {r.doc_id for r in lm.target_of(labels(spark)).collect()} == {0, 1, 10, 999}


# quality classifier


def graded(spark, n=600):
    rng = random.Random(9)
    rows, marks = [], []
    for d in range(n):
        bad = d % 4 == 0
        text = " ".join(rng.choice(["$$$", "###", "%%%", "***"]) + rng.choice("xyz") for _ in range(60)) if bad else prose(rng, 60, 3000)
        rows.append((d, text))
        if d % 2 == 0:
            marks.append((d, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, marks = graded(spark)
    kept = {r.doc_id for r in quality.select(docs, marks).collect()}
    held = [d for d in range(600) if d % 2]
    good = [d in kept for d in held if d % 4]
    assert sum(good) / len(good) > 0.95
    assert sum(d in kept for d in range(0, 600, 4)) / 150 < 0.1


def test_toxic_documents_of_good_quality_go(spark):
    docs, marks = graded(spark)
    toxic = marks.select("doc_id", F.lit(1).alias("quality"), (F.col("quality") == 0).cast("int").alias("toxic"))
    kept = {r.doc_id for r in quality.select(docs, toxic).collect()}
    assert sum(d in kept for d in range(0, 600, 4)) / 150 < 0.1
    assert sum(d in kept for d in range(600) if d % 4) / 450 > 0.95


def test_draws_by_seed_and_whole_ties(spark):
    docs, marks = graded(spark, 200)
    draw = lambda df: sorted(r.doc_id for r in quality.select(df, marks).collect())
    assert draw(docs) == draw(docs.repartition(3))
    twice = draw(docs.union(docs))
    assert Counter(twice).values() and set(Counter(twice).values()) == {2}


def test_quality_of_odd_documents(spark):
    kept = quality.select(odd(spark).withColumn("log_weight", F.lit(5.0)), labels(spark))
    assert kept.columns == [*odd(spark).columns, "log_weight"]
    assert all(r.log_weight == 0 for r in kept.where("text IS NULL OR trim(text) = ''").collect())
    assert quality.select(empty(spark), labels(spark)).count() == 0
    assert quality.select(odd(spark), labels(spark, [])).count() == len(odd_rows())


def test_weights_are_sums_of_log_ratios(spark):
    import pyarrow as pa

    docs, marks = graded(spark, 200)
    sample = quality.label_sample(marks)
    ratios = quality.fit(docs, sample)
    counts = np.zeros((2, quality.BUCKETS))
    good = {r.doc_id for r in sample.where("fits AND quality = 1 AND toxic = 0").collect()}
    for r in docs.collect():
        bucket, _ = quality.features(pa.array([r.text]))
        np.add.at(counts[0], bucket, 1)
        if r.doc_id in good:
            np.add.at(counts[1], bucket, 1)
    share = counts[1].sum() / counts[0].sum()
    assert np.allclose(ratios, np.log((counts[1] + quality.SMOOTHING) / (counts[0] * share + quality.SMOOTHING)), atol=1e-5)


def test_calibration():
    assert quality.calibrate(np.array([3.0, 4, 5]), np.array([0.0, 1, 2])) == 2.5
    assert quality.calibrate(np.array([1.0]), np.array([])) == float("-inf")


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [float(v) for v in np.concatenate([rng.normal(size=500) ** 5 * 1e6, [1.0] * 50])] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    ranked = sorted((v for v in values if v is not None and v == v), reverse=True)
    for k in (1, 7, 250, 300, 550):
        assert common.kth_largest(df, "s", k, bins=8) == ranked[k - 1]
    assert common.kth_largest(df, "s", 551) is None and common.kth_largest(df, "s", 0) is None


# byte-level BPE


def test_tokens_equal_the_library_s_and_decode_to_the_text(spark):
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = bpe.encode(odd(spark))
    assert got.columns == ["doc_id", "tokens", "n_tokens", "exact"]
    want = sorted((r[0] is None, r[0] or 0, None if r[1] is None else coder.encode_ordinary(r[1])) if r[1] is not None else (r[0] is None, r[0] or 0, []) for r in odd_rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.tokens or []) for r in got.collect()) == want
    assert got.where("NOT exact").count() == 0
    assert got.where("tokens IS NULL").count() == sum(r[1] is None for r in odd_rows())
    texts = {r.doc_id: r.text for r in bpe.decode(got).where("doc_id > 1").collect()}
    assert texts == {r[0]: r[1] for r in odd_rows() if r[0] is not None and r[0] > 1}


def test_decoding_of_odd_tokens(spark):
    rows = [(1, None), (2, []), (3, [50_000_000, -1, None]), (4, [447])]
    texts = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>")).collect()}
    assert (texts[1], texts[2], texts[3]) == (None, "", "") and "�" in texts[4]


def test_encoding_of_an_empty_table(spark):
    assert bpe.encode(empty(spark)).count() == 0


# mixing


def by_quotients(weights, seats, most):
    won = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and won[i] < most[i]]
        if not open_:
            break
        won[max(open_, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    return won


def test_sainte_lague():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 8)
        weights = [rng.choice([0, 1, 1, 2, 3, 10, 0.5, 1000]) for _ in range(n)]
        most, seats = [rng.randint(0, 30) for _ in range(n)], rng.randint(0, 90)
        assert mixing.sainte_lague(np.array(weights, float), seats, np.array(most)).tolist() == by_quotients(weights, seats, most)
    assert mixing.sainte_lague(np.array([np.nan, np.inf, -1.0]), 3, np.array([5, 5, 5])).tolist() == [0, 0, 0]
    assert mixing.sainte_lague(np.array([53000.0, 24000, 23000]), 7, np.array([9, 9, 9])).tolist() == [3, 2, 2]


def test_mixture_equals_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 37, prose(rng, rng.randint(0, 900)), "en", rng.choice(["big"] * 8 + ["small", None]), 0) for i in range(4000)]
    rows += rows[:5] + [(None, "x y z", "en", "big", 0), (3, None, "en", "big", 0), (4, "", "en", "small", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(mixing.select(docs), in_duckdb(tmp_path, mixing.SQL, documents=docs))


def test_mixture_of_odd_documents(spark):
    drawn = mixing.mix(odd(spark), block_tokens=50)
    assert drawn.columns == odd(spark).columns and 0 < drawn.count() < len(odd_rows())
    assert drawn.where("doc_id IS NULL").count() == 0
    only = mixing.select(odd(spark), weights={"src1": 1.0}, share=1.0, block_tokens=50)
    assert {r.source for r in only.collect()} == {"src1"}
    assert mixing.select(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_lm_sql(spark, tmp_path):
    rows = [r for r in {r[0]: r for r in odd_rows() if r[0] is not None}.values()]
    docs, marks = spark.createDataFrame(rows, SCHEMA), labels(spark)
    same(lm.score(docs, lm.target_of(marks)), in_duckdb(tmp_path, lm.SQL, documents=docs, labels=marks))


# drawn rows, and texts in pieces


def test_drawn_rows_equal_brute_force(spark):
    rng = random.Random(12)
    docs = [(i, prose(rng, rng.randint(20, 60), 60) if i % 3 else " ".join(rng.choice(["buy", "now", "!!!", "CHEAP", "win"]) for _ in range(40))) for i in range(240)] + [(500, None), (501, "")]
    marks = [(i, int(i % 3 > 0), int(i % 17 == 0)) for i in range(160)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    fits = {r.doc_id: r.fits for r in quality.label_sample(known).collect()}
    counts = {d: Counter(quality.features(pa.array([t], pa.string()))[0].tolist()) for d, t in docs}
    fine = {d for d, q, t in marks if q == 1 and t == 0}
    raw, target = sum(counts.values(), Counter()), sum((counts[d] for d in fine if fits[d]), Counter())
    scale, s = sum(target.values()) / sum(raw.values()), quality.SMOOTHING
    weight = {d: sum(n * float(np.float32(math.log((target[b] + s) / (raw[b] * scale + s)))) for b, n in c.items()) for d, c in counts.items()}
    good, bad = [weight[d] for d in fine if not fits[d]], [weight[d] for d, _, _ in marks if d not in fine and not fits[d]]
    values = sorted({*good, *bad})
    cuts = [values[0] - 1, *((a + b) / 2 for a, b in zip(values, values[1:])), values[-1] + 1]
    cut = min(cuts, key=lambda c: (round(quality.CARE * sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad), 9), c))
    noise = {r.doc_id: r.z for r in df.select("doc_id", (-F.log(-F.log(common.uniform(quality.SEED, "doc_id", "text")))).alias("z")).collect()}
    keys = {d: weight[d] + noise[d] for d in weight}
    k = sum(w >= cut for w in weight.values())
    want = set(sorted(keys, key=lambda d: -keys[d])[:k])
    assert {r.doc_id for r in quality.select(df, known).collect()} == want and 20 < len(want) < 220


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(13)
    column = pa.array([prose(rng, 200), "x" * 5000 + " y", None, "", "é" * 700, prose(rng, 3)], pa.string())
    whole, rows = textvec.tokens(column), textvec.hash_rows(column)
    for piece in (64, 100, 4096):
        monkeypatch.setattr(textvec, "PIECE", piece)
        cut = textvec.tokens(column)
        assert (cut.hash == whole.hash).all() and (cut.start == whole.start).all() and (cut.rows == whole.rows).all()
        assert (textvec.hash_rows(column) == rows).all()
