import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.functions import blake3
from tarn.functions import embedding as E
from tarn.functions import text as T


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).first()[0]


def test_blake3_known_values():
    assert blake3.hexdigests([b"", b"abc"]) == [
        "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85",
    ]
    pattern = lambda n: bytes(i % 251 for i in range(n))
    assert blake3.hexdigests([pattern(1024), pattern(1025)]) == [
        "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    ]


def test_blake3_does_not_depend_on_the_batch():
    inputs = [bytes(i % 251 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 2048, 3072, 3073, 7000)]
    assert blake3.hexdigests(inputs) == [blake3.hexdigests([x])[0] for x in inputs]


@pytest.mark.parametrize(
    "text, tokens",
    [("比特币 Layer2", ["比特", "特币", "layer2"]), ("调用层", ["调用", "用层"]), ("链", ["链"]), ("L2", ["l2"]), ("模块化区块链", ["模块", "块化", "化区", "区块", "块链"]), ("x_y Über-naïve", ["x", "y", "über", "naïve"]), ("", []), ("--", [])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=text) == tokens == T.py_tokens(text)
    assert one(spark, T.token_count(F.col("t")), t=text) == max(1, len(tokens)) == T.py_token_count(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9_ -比特币é\n"), max_size=30))
def test_token_count_counts_tokens(text):
    assert T.py_token_count(text) == max(1, len(T.py_tokens(text)))


def test_normal_form(spark):
    assert one(spark, T.normal_form(F.col("t")), t="比特币 Layer2 / 调用层") == "比特币 layer2 调用层"
    assert one(spark, T.normal_form(F.lit(None).cast("string"))) == ""


def test_formats(spark):
    assert one(spark, T.query_for_embedding(F.col("t")), t="  rust   retrieval ") == "query: rust retrieval"
    full = T.chunk_for_embedding(F.lit("a/b.md"), F.lit(" T "), F.array(F.lit("x"), F.lit("y")), F.lit("one\n two"))
    assert one(spark, full) == "path: a/b.md\ntitle: T\nheadings: x > y\ntext: one two"
    bare = T.chunk_for_embedding(F.lit("a"), F.lit("  "), F.array().cast("array<string>"), F.lit("t"))
    assert one(spark, bare) == "path: a\ntext: t"
    hit = T.document_for_reranking(F.lit("a"), F.lit(None).cast("string"), F.array(F.lit("h")), F.lit("e"), F.lit('{"b":true,"a":"x","n":1,"l":[1,2]}'))
    assert one(spark, hit) == "path: a\nheadings: h\nmetadata: a=x, b=true, l=[1,2], n=1\nexcerpt: e"


def test_excerpt_counts_characters(spark):
    assert one(spark, T.excerpt(F.col("t")), t="é" * 300) == "é" * 280


def test_coverage_and_phrase(spark):
    tokens = F.array(F.lit("rust"), F.lit("go"), F.lit("rust"))
    assert one(spark, T.coverage(tokens, F.lit("trusty"))) == pytest.approx(2 / 3)
    assert one(spark, T.coverage(F.array().cast("array<string>"), F.lit("x"))) == 0
    assert one(spark, T.phrase_bonus(F.lit("a b c"), F.lit("b c"), 0.3)) == 0.3
    assert one(spark, T.phrase_bonus(F.lit("a b c"), F.lit(""), 0.3)) == 0


def test_hashing_embedding_is_a_signed_count():
    words = ["alpha", "beta", "alpha"]
    heads = blake3.digests([w.encode() for w in words])
    want = np.zeros(64)
    for h in heads:
        want[h[0] % 64] += 1 if h[1] % 2 == 0 else -1
    got = E.hashed([" ".join(words), "", None], 64)
    assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1:].any()


def test_cosine(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0)]
    rows = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double").select(E.cosine(F.col("a"), F.col("b")).alias("got"), "want").collect()
    for row in rows:
        assert row.got == pytest.approx(row.want)


def test_vector_bytes():
    assert E.from_bytes(E.to_bytes([1.5, -2.0])).tolist() == [1.5, -2.0]
    with pytest.raises(ValueError):
        E.from_bytes(b"abc")


def test_static_model(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    np.save(tmp_path / "vectors.npy", np.array([[1, 0], [0, 1], [0, 0]], dtype=np.float32))
    got = E.embed(["a b", "a a", "", None], E.StaticModel(str(tmp_path)))
    assert np.allclose(got, [[2**-0.5, 2**-0.5], [1, 0], [0, 0], [0, 0]])
