import pytest
from corpus import CHUNKS_OF_PYTHON, ID_OF_PYTHON, QUERIES, documents
from pyspark.sql import functions as F

from tarn.functions import embedding as E
from tarn.operators.index import build, first_chunk_index
from tarn.plans.conventions import Conventions, merge_options
from tarn.plans.relevance import evaluate, summary
from tarn.plans.search import open_index
from tarn.sources.bundle import export_bundle, open_bundle


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("index"))
    docs = documents(spark).withColumn("metadata_json", F.when(F.col("relative_path").contains("rust"), '{"lang":"rust","weight":2.5,"flag":true,"tags":["a","b"]}').otherwise('{"lang":"other","weight":"3"}'))
    build(spark, docs, where)
    return where


@pytest.fixture(scope="module")
def index(spark, path):
    return open_index(spark, path).cache()


def test_tables(index):
    assert index.info()["document_count"] == 3 and index.info()["chunk_count"] == 6
    chunks = index.tables["chunks"].where(F.col("doc_id") == ID_OF_PYTHON).orderBy("ordinal").collect()
    assert [(c.chunk_id, c.char_start, c.char_end, c.token_count) for c in chunks] == CHUNKS_OF_PYTHON
    assert index.average == pytest.approx(14.666667, abs=1e-6)
    df = {r.term: r.df for r in index.tables["term_stats"].collect()}
    assert len(df) == 35 and df["setup"] == 5 and df["document"] == 6 and df["rust"] == 2
    assert [(r.relative_path, r.first_chunk_index) for r in first_chunk_index(index.tables["documents"]).orderBy("relative_path").collect()] == [("guides/python.md", 0), ("guides/rust.md", 2), ("ops/network.md", 4)]


def test_hybrid_scores(index):
    hits = index.search("rust toolchain setup")
    assert [(h["relative_path"], round(h["score"], 6)) for h in hits] == [("guides/rust.md", 0.032787), ("guides/python.md", 0.032002), ("ops/network.md", 0.016129)]


@pytest.mark.parametrize("mode", ["hybrid", "lexical"])
@pytest.mark.parametrize("reranker", [None, "heuristic-v1"])
def test_top_hits(spark, index, mode, reranker):
    queries = spark.createDataFrame(QUERIES, "name string, query string, expected_top_hit string")
    assert summary(evaluate(index, queries, mode=mode, reranker=reranker)) == {"total": 3, "passed": 3, "failed": 0}


def test_embedding_reranker(index):
    query = "rust toolchain setup"
    fused = {h["doc_id"]: h for h in index.search(query)}
    heuristic = {h["doc_id"]: (h["score"] - 0.35 * fused[h["doc_id"]]["score"]) / 0.65 for h in index.search(query, reranker="heuristic-v1")}
    for h in index.search(query, reranker="embedding-v1"):
        lines = [f"path: {h['relative_path']}", f"title: {h['title']}", f"headings: {h['title']}", "metadata: " + ("flag=true, lang=rust, tags=[\"a\",\"b\"], weight=2.5" if "rust" in h["relative_path"] else "lang=other, weight=3")]
        q, d = E.embed([f"query: {query}", "\n".join([*lines, "excerpt: " + " ".join(h["best_match"]["excerpt"].split())])], E.Hashing()).astype(float)
        assert h["score"] == pytest.approx(fused[h["doc_id"]]["score"] * 0.2 + (max(q @ d, 0) * 0.8 + heuristic[h["doc_id"]] * 0.2) * 0.8, abs=1e-6)


def test_filters(index):
    paths = lambda **o: {h["relative_path"] for h in index.search("document setup", **o)}
    assert paths(relative_path_prefix="guides/") == {"guides/python.md", "guides/rust.md"}
    assert paths(relative_path_prefix="guides/", metadata={"lang": "rust"}) == {"guides/rust.md"}
    assert paths(metadata={"weight": 2.5}) == paths(metadata={"flag": True}) == paths(metadata={"tags": ["a", "b"]}) == {"guides/rust.md"}
    assert paths(metadata={"weight": 3}) == paths(metadata={"flag": "true"}) == paths(metadata={"missing": None}) == paths(relative_path_prefix="zzz") == set()


def test_multiplier_promotes_beyond_top_k(index):
    plain = index.search("package installation", top_k=1)
    assert plain[0]["relative_path"] == "guides/python.md"
    raised = index.search("package installation", top_k=1, numeric_multiplier="weight")
    assert raised[0]["relative_path"] == "guides/rust.md"


def test_min_score_comes_after_the_multiplier(index):
    low = index.search("rust toolchain setup", min_score=0.05)
    high = index.search("rust toolchain setup", min_score=0.05, numeric_multiplier="weight")
    assert low == [] and [h["relative_path"] for h in high] == ["guides/rust.md"]
    assert len(index.search("rust toolchain setup", min_score=float("nan"))) == 3


def test_lexical_profile(spark, path):
    index = open_index(spark, path, "lexical")
    assert "vectors" not in index.tables
    assert index.search("latency", mode="lexical")[0]["relative_path"] == "ops/network.md"
    with pytest.raises(ValueError, match="lexical"):
        index.search("latency", mode="vector")
    with pytest.raises(ValueError, match="embedding-v1"):
        index.search("latency", mode="lexical", reranker="embedding-v1")


def test_options_are_checked(index):
    with pytest.raises(ValueError, match="mode"):
        index.search("x", mode="fuzzy")
    with pytest.raises(ValueError, match="options"):
        index.search("x", hybrid=True)
    with pytest.raises(ValueError, match="reranker"):
        index.search("x", reranker="none-v0")


def test_empty_queries(spark, index):
    assert index.search("---", mode="lexical") == [] and index.search("", mode="lexical") == []
    many = spark.createDataFrame([(1, None), (None, "rust"), (2, "rust")], "query_id long, query string")
    assert {r.query_id for r in index.search_many(many).collect()} == {2}


def test_batch_equals_single(spark, index):
    many = index.search_many(spark.createDataFrame([(n, q) for n, q, _ in QUERIES], "query_id string, query string"))
    got = {}
    for r in many.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.relative_path, round(r.score, 9)))
    assert got == {n: [(h["relative_path"], round(h["score"], 9)) for h in index.search(q)] for n, q, _ in QUERIES}


def test_conventions(spark, tmp_path):
    docs = documents(spark)
    rules = Conventions(
        include=lambda p: not p.startswith("ops/"),
        transform=lambda df: df.withColumn("metadata_json", F.lit('{"open":"yes"}')),
        rewrite=lambda q: q.replace("crab", "rust"),
        profile={"metadata": {"open": "yes"}, "top_k": 1},
    )
    build(spark, rules.documents(docs), str(tmp_path))
    index = open_index(spark, str(tmp_path), conventions=rules)
    assert [h["relative_path"] for h in index.search("crab toolchain")] == ["guides/rust.md"]
    assert index.search("crab toolchain", metadata={"open": "no"}) == []
    with pytest.raises(ValueError, match="relative_path"):
        Conventions(transform=lambda df: df.withColumn("relative_path", F.lit("x"))).documents(docs)


def test_merged_options():
    merged = merge_options({"top_k": 3, "metadata": {"a": 1, "b": 2}, "reranker": "heuristic-v1"}, {"metadata": {"b": 3}, "reranker": {"candidate_pool_size": 9}, "mode": None})
    assert merged == {"top_k": 3, "metadata": {"a": 1, "b": 3}, "reranker": {"kind": "heuristic-v1", "candidate_pool_size": 9}}


def test_bundle_round_trip(spark, index, path, tmp_path):
    manifest = export_bundle(spark, path, tmp_path)
    assert (manifest["documentCount"], manifest["chunkCount"], manifest["vectorDimensions"]) == (3, 6, 256)
    again = open_bundle(spark, str(tmp_path))
    for query in ("rust toolchain setup", "latency packet traces"):
        assert [(h["doc_id"], round(h["score"], 9), h["best_match"]["chunk_id"]) for h in again.search(query)] == [(h["doc_id"], round(h["score"], 9), h["best_match"]["chunk_id"]) for h in index.search(query)]
    (tmp_path / "vectors.bin").write_bytes(b"\0" * 8)
    with pytest.raises(ValueError, match="vectors"):
        open_bundle(spark, str(tmp_path))
    assert open_bundle(spark, str(tmp_path), "lexical").search("latency", mode="lexical")[0]["relative_path"] == "ops/network.md"


def test_two_documents_of_one_id_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="two documents"):
        build(spark, documents(spark).union(documents(spark)), str(tmp_path))


def test_a_document_without_text_is_stored(spark, tmp_path):
    build(spark, spark.createDataFrame([("a.md", None), ("b.md", "x")], "relative_path string, content string"), str(tmp_path))
    assert open_index(spark, str(tmp_path)).info()["document_count"] == 2


def test_a_new_version_replaces_the_old(spark, tmp_path):
    build(spark, documents(spark), str(tmp_path))
    build(spark, documents(spark).limit(1), str(tmp_path))
    assert open_index(spark, str(tmp_path)).info()["document_count"] == 1
