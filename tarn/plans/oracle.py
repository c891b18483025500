"""DuckDB SQL for the queries of ``queries`` that SQL can express (chunks of paragraphs and BLAKE3 are beyond it)."""

from __future__ import annotations

from tarn.plans.queries import ASKED, POOL, TOP

_T = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"

_CORPUS = """corpus AS (
  SELECT doc_id::VARCHAR AS doc_id, doc_id AS id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id || '.md') AS relative_path,
    'Document ' || doc_id AS title, text AS content, source, lang, '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata_json FROM documents)"""

_FORMATTED = f"'path: ' || relative_path || chr(10) || 'title: ' || title || chr(10) || 'text: ' || {_SQUEEZED.format('content')}"


def _bm25(queries: str, where: str = "true") -> str:
    """CTEs up to ``bm25`` (query_id, id, score) for queries (query_id, query)."""
    return f"""
asked AS ({queries}),
terms AS (SELECT DISTINCT query_id, unnest({_T.format('query')}) AS term FROM asked),
{_CORPUS},
tokens AS (SELECT id, doc_id, relative_path, lang, {_T.format('content')} AS w FROM corpus WHERE content IS NOT NULL),
stats AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS average FROM tokens),
tf AS (SELECT id, doc_id, relative_path, lang, l, term, count(*) AS tf FROM (SELECT id, doc_id, relative_path, lang, greatest(len(w), 1) AS l, unnest(w) AS term FROM tokens) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (
  SELECT query_id, id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / average))) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term), stats WHERE {where} GROUP BY query_id, id, doc_id)"""


_ONE = f"SELECT 0 AS query_id, '{ASKED}' AS query"
_MANY = "SELECT item_id AS query_id, text AS query FROM benchmark"


def _ranked(limit: int, digits: int = 6) -> str:
    """CTEs up to ``ranked``: chunks are cut off at 16 * limit by score and number, then documents are ranked by score and id as text."""
    return f"""
chunked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, id) AS r FROM bm25) WHERE r <= {16 * limit}),
ranked AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, doc_id)::INT AS position FROM chunked)"""


_RANKED = _ranked(TOP)

_NEAREST = f"""
SELECT query_id, position, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS position FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE {{}} AND list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) > 0))
WHERE position <= {TOP}"""


def _hashed(source: str, key: str, text: str, name: str) -> str:
    """CTEs up to ``name`` (key, bucket, value): the SHA-256 hashing embedding as single-precision cells."""
    return f"""
{name}_w AS (SELECT {key}, sha256(unnest(regexp_extract_all({text}, '\\S+'))) AS h FROM {source}),
{name}_c AS (SELECT {key}, ('0x' || substr(h, 1, 2))::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 3, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {key}, bucket, (v / sqrt(sum(v * v) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value FROM {name}_c)"""


def _coverage(field: str, share: float, extra: float) -> str:
    normal = _NORMAL.format(field)
    return f"(len(list_filter(tokens, lambda t: contains({normal}, t)))::DOUBLE / len(tokens) * {share} + CASE WHEN contains({normal}, phrase) THEN {extra} ELSE 0 END)"


_HEURISTIC = " + ".join(_coverage(*f) for f in (("title", 0.45, 0.30), ("''", 0.20, 0.20), ("substr(trim(content), 1, 280)", 0.25, 0.15), ("relative_path", 0.10, 0.05)))

_ADJUSTED = "SELECT doc_id, round((doc_id % 97) / 97.0::DOUBLE * CASE WHEN quality * 2.5 > 0 THEN quality * 2.5::DOUBLE ELSE 1 END, 6) AS score FROM labels"

_PART = "length({0}) || ':' || {0}"
_STATUS = """status AS (
  SELECT relative_path, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN quality = 0 OR toxic = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM corpus c LEFT JOIN labels l ON l.doc_id = c.id
  UNION ALL SELECT 'gone/' || item_id || '.md', 'absent' FROM benchmark)"""

_STORED = "SELECT query_id, position AS rank, doc_id, round(1 / (60.0::DOUBLE + position), 6) AS score FROM ranked WHERE position <= "
_HITS = f"""
hits AS (
  SELECT query_id, doc_id, 1 / (60.0::DOUBLE + position) AS s, title, relative_path, content, {_T.format("query")} AS tokens, {_NORMAL.format("query")} AS phrase
  FROM ranked JOIN corpus USING (doc_id) JOIN asked USING (query_id) WHERE position <= {POOL})"""

SQL: dict[str, str] = {
    "tokenize_documents": f"SELECT doc_id, greatest(len(w), 1) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_T.format('text')} AS w FROM documents)",
    "normalize_heuristic": f"SELECT doc_id, md5({_NORMAL.format('text')}) AS normal_md5 FROM documents",
    "format_chunk_text": f"WITH {_CORPUS} SELECT id AS chunk_id, md5({_FORMATTED}) AS formatted_md5 FROM corpus WHERE content IS NOT NULL",
    "excerpt_280": "SELECT doc_id, substr(text, 1, 280) AS excerpt FROM documents",
    "postings_tf": f"SELECT term, chunk_id, count(*)::INT AS tf, chunk_len FROM (SELECT doc_id AS chunk_id, unnest(w) AS term, greatest(len(w), 1)::INT AS chunk_len FROM (SELECT doc_id, {_T.format('text')} AS w FROM documents)) GROUP BY ALL",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_T.format('text')}) AS term FROM documents) GROUP BY term",
    "corpus_avg_len": f"SELECT count(*) AS n_chunks, round(avg(len({_T.format('text')})), 6) AS avg_chunk_length FROM documents WHERE text IS NOT NULL",
    "bm25_chunks": f"WITH {_bm25(_ONE)} SELECT id AS chunk_id, round(score, 6) AS score FROM bm25",
    "lexical_search_topk": f"WITH {_bm25(_ONE)}, {_RANKED} SELECT position, doc_id, score FROM ranked WHERE position <= {TOP}",
    "lexical_filtered_by_lang": f"WITH {_bm25(_ONE, "lang = 'en'")}, {_RANKED} SELECT position, doc_id, score FROM ranked WHERE position <= {TOP}",
    "lexical_search_batch": f"WITH {_bm25(_MANY)}, {_RANKED} SELECT query_id, position, doc_id, score FROM ranked WHERE position <= {TOP}",
    "path_prefix_filter": f"WITH {_CORPUS} SELECT doc_id, relative_path FROM corpus WHERE starts_with(relative_path, 'src1/')",
    "cosine_scores": "SELECT v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0",
    "vector_search_topk": _NEAREST.format("q.vec_id = 7"),
    "vector_search_batch": _NEAREST.format("true"),
    "chunk_to_doc_aggregate": """
SELECT doc_id, round(sum(CASE WHEN p = 1 THEN s ELSE 0 END) + 0.1::DOUBLE * sum(CASE WHEN p > 1 THEN s ELSE 0 END), 6) AS score, min(CASE WHEN p = 1 THEN turn END) AS chunk_id FROM (
  SELECT conv_id AS doc_id, turn, length(text) / 100.0::DOUBLE AS s, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS p FROM conversations)
WHERE p <= 3 GROUP BY doc_id""",
    "rrf_fuse": """
WITH a AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier),
b AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5(s_name) DESC, s_suppkey) AS r FROM supplier)
SELECT coalesce(a.id, b.id) AS doc_id, round(coalesce(1 / (60.0::DOUBLE + a.r), 0) + coalesce(1 / (60.0::DOUBLE + b.r), 0), 9) AS score, CASE WHEN a.id IS NULL THEN 2 ELSE 1 END AS from_list FROM a FULL JOIN b ON a.id = b.id""",
    "hashing_embedding": f"WITH {_hashed('benchmark', 'item_id', 'text', 'v')} SELECT item_id, bucket, round(value, 5) AS value FROM v WHERE value <> 0",
    "hybrid_search": f"""
WITH {_bm25(_MANY)},
texts AS (SELECT id, {_FORMATTED} AS f FROM corpus WHERE content IS NOT NULL), {_hashed('texts', 'id', 'f', 'd')},
questions AS (SELECT query_id, 'query: ' || {_SQUEEZED.format('query')} AS f FROM asked), {_hashed('questions', 'query_id', 'f', 'q')},
near AS (
  SELECT query_id, id, round(sum(q.value * d.value) / (any_value(qn) * any_value(dn)), 12) AS score
  FROM q JOIN d USING (bucket) JOIN (SELECT query_id, sqrt(sum(value * value)) AS qn FROM q GROUP BY ALL) USING (query_id) JOIN (SELECT id, sqrt(sum(value * value)) AS dn FROM d GROUP BY ALL) USING (id) GROUP BY query_id, id),
lists AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS r
    FROM (SELECT * FROM near WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {16 * TOP}) QUALIFY r <= {8 * TOP}
  UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r
    FROM (SELECT query_id, id, doc_id, round(score, 9) AS score FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {16 * TOP}) QUALIFY r <= {8 * TOP}),
fused AS (SELECT query_id, id::VARCHAR AS doc_id, sum(1 / (60.0::DOUBLE + r)) AS s FROM lists GROUP BY query_id, id)
SELECT query_id, doc_id, round(s, 6) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= {TOP}""",
    "heuristic_rerank": f"""
WITH {_bm25(_MANY)}, {_ranked(POOL)}, {_HITS}
SELECT query_id, doc_id, round(0.35::DOUBLE * s + 0.65::DOUBLE * ({_HEURISTIC}), 6) AS score FROM hits""",
    "stored_lexical": f"WITH {_bm25(_MANY)}, {_ranked(TOP, 12)} {_STORED} {TOP}",
    "stored_filtered": f"WITH {_bm25(_MANY, "lang = 'en' AND starts_with(relative_path, 'src1/')")}, {_ranked(TOP, 12)} {_STORED} {TOP}",
    "stored_reranked": f"""
WITH {_bm25(_MANY)}, {_ranked(TOP, 12)}, {_HITS},
scored AS (SELECT query_id, doc_id, relative_path, 0.35::DOUBLE * s + 0.65::DOUBLE * ({_HEURISTIC}) AS score FROM hits)
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relative_path)::INT AS rank FROM scored) WHERE rank <= {TOP}""",
    "metadata_multiplier": _ADJUSTED,
    "min_score_cut": f"SELECT * FROM ({_ADJUSTED}) WHERE score >= 0.9",
    "json_metadata_filter": "SELECT event_id FROM events WHERE json_extract(props, '$.k')::DOUBLE = 1",
    "doc_fingerprint": f"""
WITH {_CORPUS}
SELECT doc_id, sha256(concat_ws('|', {_PART.format('relative_path')}, '-', {_PART.format('title')}, '-', {_PART.format("coalesce(content, '')")}, {_PART.format('metadata_json')})) AS fingerprint, sha256(coalesce(content, '')) AS content_hash FROM corpus""",
    "incremental_status": f"WITH {_CORPUS}, {_STATUS} SELECT relative_path, status FROM status",
    "incremental_stats": f"WITH {_CORPUS}, {_STATUS} SELECT status, count(*) AS n FROM status GROUP BY status",
    "removed_paths": "SELECT 'gone/' || item_id || '.md' AS relative_path FROM benchmark WHERE item_id % 2 = 0",
    "benchmark_eval": f"""
WITH {_bm25(_MANY)}, {_RANKED}
SELECT a.query_id, r.doc_id, coalesce(contains(c.content, a.query), false) AS passed FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE position = 1) r USING (query_id) LEFT JOIN corpus c USING (doc_id)""",
}
