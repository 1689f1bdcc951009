"""Queries of full-text, vector and hybrid search over ``documents`` and ``embeddings``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical, retrieve, vector_index
from ..sources.tables import fingerprint, read_spread, read_table, shared_folder

QUERY = "thanedble heitkeit mentre the_of"
PREFIXES = ["q", "th", "ent", "erin", "zzzz", "heitl"]
TERMS = ["thanedble", "erinan", "heitlich", "queda", "onthe"]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as chunks: source stands for symbol and file, language for language."""
    tier = F.when(F.col("source").isin("src1", "src2"), "dependency").when(F.col("source") == "src3", "stdlib").when(F.col("source") == "src4", "vendored").when(F.col("source") == "src5", None).otherwise("project")
    return read_spread(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("symbol"), F.col("text").alias("code"), F.col("source").alias("file_path"), F.col("lang").alias("language"), tier.alias("tier")
    )


_saved: dict[tuple, str] = {}  # where the index of a table is, by application, table and its files


def saved_index(spark: SparkSession, sf_dir: str) -> lexical.TextIndex:
    """The index of ``documents``, built once for as long as the table's files stay the same, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _saved:
        path = f"{shared_folder(spark)}/tarn-text-index-{uuid.uuid4().hex}"
        lexical.build_index(chunks(spark, sf_dir)).save(path)
        _saved[key] = path
    return lexical.TextIndex.load(spark, _saved[key])


def _lexical(spark: SparkSession, sf_dir: str, query: str, k: int) -> DataFrame:
    return lexical.search_one(saved_index(spark, sf_dir), query, k)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")


#: A query vector with a closed form, so that SQL can state it too.
VECTOR = [((i * 37 + 11) % 64) / 64.0 - 0.5 for i in range(64)]


def lexical_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, QUERY, 20).select("chunk_id", F.round("score", 9).alias("score"))


def lexical_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten by terms, ending early by blocks."""
    return lexical.search_top(saved_index(spark, sf_dir), " ".join(TERMS[:3]), 10).select("chunk_id", F.round("score", 9).alias("score"))


def lexical_top_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_top(saved_index(spark, sf_dir), QUERY, 20).select("chunk_id", F.round("score", 9).alias("score"))


def lexical_prefix_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, term, n_chunks``: dictionary terms that start with each of some prefixes, and how many chunks hold them."""
    return lexical.prefix_counts(saved_index(spark, sf_dir), PREFIXES)


def lexical_phrase_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "of_the_a and_the", 25).select("chunk_id", F.round("score", 9).alias("score"))


def lexical_batch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(TERMS)), "query_id int, query string")
    hits = lexical.search_lexical(saved_index(spark, sf_dir), queries, 3)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def semantic_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search_semantic(_vectors(spark, sf_dir), VECTOR, 20).select("chunk_id", F.round("score", 6).alias("score"))


def semantic_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.search_semantic(_vectors(spark, sf_dir), VECTOR, 20, metric="l2").select("chunk_id", F.round("score", 6).alias("score"))


def semantic_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = vectors.filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieve.search_semantic_batch(vectors, queries, 3).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def saved_vectors(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The inverted file of ``embeddings``, built once for as long as the table's files stay the same."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _saved:
        path = f"{shared_folder(spark)}/tarn-vector-index-{uuid.uuid4().hex}"
        vector_index.build(_vectors(spark, sf_dir), path)
        _saved[key] = path
    return vector_index.VectorIndex.load(spark, _saved[key])


def semantic_ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact: lists whose bound is behind the k-th are not read."""
    return vector_index.search(saved_vectors(spark, sf_dir), VECTOR, 20).select("chunk_id", F.round("score", 6).alias("score"))


def _batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter(F.col("chunk_id") % 50 == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))


def semantic_ivf_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list is probed, so rows are those of the exact search."""
    hits = vector_index.search_batch(saved_vectors(spark, sf_dir), _batch_queries(spark, sf_dir), 5, vector_index.MOST_LISTS)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def semantic_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, n_exact, n_found``: of the exact ten nearest of each query, those found by as many lists as a sample needs."""
    index, queries = saved_vectors(spark, sf_dir), _batch_queries(spark, sf_dir)
    near = vector_index.search_batch(index, queries, 10, vector_index.probe_for(index, 0.97)).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    exact = retrieve.search_semantic_batch(_vectors(spark, sf_dir), queries, 10).select("query_id", "chunk_id")
    return exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    semantic = retrieve.search_semantic(_vectors(spark, sf_dir), VECTOR, 3 * k)
    return retrieve.fuse(semantic, _lexical(spark, sf_dir, QUERY, 3 * k), k)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 10).select("chunk_id", F.coalesce("sem_rank", F.lit(-1)).alias("sem_rank"), F.coalesce("lex_rank", F.lit(-1)).alias("lex_rank"), F.round("score", 9).alias("score"))


def _all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rows.select("chunk_id", "file_path", "tier").join(lexical.search_one(saved_index(spark, sf_dir), QUERY, None), "chunk_id")


def file_agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_file(_all_scores(spark, sf_dir), 10, "sum").select("file_path", F.round("score", 9).alias("score"))


def file_agg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_file(_all_scores(spark, sf_dir), 10, "max").select("file_path", F.round("score", 9).alias("score"))


def tier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.weigh_tiers(_all_scores(spark, sf_dir), 20).select("chunk_id", "tier", F.round("score", 9).alias("score"))


def tier_filter_no_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.weigh_tiers(_all_scores(spark, sf_dir), 20, include_deps=False).select("chunk_id", F.round("score", 9).alias("score"))


def deps_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieve.weigh_tiers(_all_scores(spark, sf_dir), 300)
    return retrieve.dependencies_only(top).select("chunk_id", F.round("score", 9).alias("score"))


def memory_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    return lexical.memory_like(rows, "lich_n%Keit", ["text", "source"], [F.desc("doc_id")], 25).select("doc_id", "score")


_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_BASE = f"""
    d AS (SELECT doc_id, {_TOKENS.format('source')} AS s, {_TOKENS.format('text')} AS t FROM documents),
    len_ AS (SELECT doc_id, len(s) + len(t) AS dl FROM d),
    post AS (SELECT doc_id, 'symbol' AS f, unnest(s) AS term, generate_subscripts(s, 1) AS pos FROM d
             UNION ALL SELECT doc_id, 'code', unnest(t), generate_subscripts(t, 1) FROM d),
    c AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len_),
    hit AS (SELECT q.query_id, q.phrase, q.m, p.doc_id, p.f, p.pos - q.i AS start FROM post p
            JOIN q ON CASE WHEN q.prefix THEN starts_with(p.term, q.token) ELSE p.term = q.token END
            GROUP BY ALL HAVING count(*) = q.m),
    f AS (SELECT query_id, phrase, doc_id, count(*) AS f FROM hit GROUP BY ALL),
    df AS (SELECT query_id, phrase, CASE WHEN (n_docs - count(*) + 0.5) <= (count(*) + 0.5) THEN 1e-6 ELSE ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) END AS idf, avgdl
           FROM f, c GROUP BY query_id, phrase, n_docs, avgdl),
    sc AS (SELECT query_id, doc_id, sum(idf * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * dl / avgdl))) / 100 AS score
           FROM f JOIN df USING (query_id, phrase) JOIN len_ USING (doc_id) GROUP BY query_id, doc_id)
"""


def _phrases(*queries: str) -> str:
    rows = []
    for n, q in enumerate(queries):
        for p, term in enumerate(q.split()):
            parts = [x for x in term.lower().replace("ó", "o").split("_") if x]
            rows += [f"({n}, {p}, {i}, {len(parts)}, '{t}', {str(i == len(parts) - 1).lower()})" for i, t in enumerate(parts)]
    return f"WITH q(query_id, phrase, i, m, token, prefix) AS (VALUES {', '.join(rows)}), {_BASE}"


_TIER = "CASE WHEN source IN ('src1', 'src2') THEN 'dependency' WHEN source = 'src3' THEN 'stdlib' WHEN source = 'src4' THEN 'vendored' WHEN source = 'src5' THEN NULL ELSE 'project' END"
_BOOSTED = f"""{_phrases(QUERY)}, b AS (
    SELECT doc_id AS chunk_id, {_TIER} AS tier, score * CASE coalesce({_TIER}, 'project') WHEN 'project' THEN 1.0 WHEN 'dependency' THEN 0.7 WHEN 'stdlib' THEN 0.5 ELSE 1.0 END AS score
    FROM sc JOIN documents USING (doc_id))"""
_Q = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q})"
_L2 = f"1 - list_distance(embedding::DOUBLE[], {_Q})"

ORACLES = {
    "lexical_bm25_topk": f"{_phrases(QUERY)} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 20",
    "lexical_phrase_prefix": f"{_phrases('of_the_a and_the')} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 25",
    "lexical_top_terms": f"{_phrases(' '.join(TERMS[:3]))} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 10",
    "lexical_top_phrases": f"{_phrases(QUERY)} SELECT doc_id AS chunk_id, round(score, 9) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT 20",
    "lexical_prefix_terms": f"""{_phrases(QUERY)} SELECT token, term, count(DISTINCT doc_id) AS n_chunks
        FROM post JOIN (SELECT unnest({PREFIXES!r}) AS token) ON starts_with(term, token) GROUP BY token, term""",
    "lexical_batch_terms": f"""{_phrases(*TERMS)} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM
        (SELECT query_id, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 3""",
    "semantic_knn_topk": f"SELECT vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20",
    "semantic_knn_l2": f"SELECT vec_id AS chunk_id, round({_L2}, 6) AS score FROM embeddings ORDER BY {_L2} DESC, vec_id LIMIT 20",
    "semantic_knn_batch": """
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
                   FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p) WHERE rank <= 3""",
    "semantic_ivf_topk": f"SELECT vec_id AS chunk_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 20",
    "semantic_ivf_batch": """
        WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
                   FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p) WHERE rank <= 5""",
    "hybrid_rrf": f"""{_phrases(QUERY)},
        sem AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) - 1 AS sem_rank FROM embeddings ORDER BY sem_rank LIMIT 30),
        lex AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS lex_rank FROM sc ORDER BY lex_rank LIMIT 30),
        j AS (SELECT chunk_id, sem_rank, lex_rank, coalesce(0.7 / (60 + sem_rank), 0) + coalesce((1 - 0.7::DOUBLE) / (60 + lex_rank), 0) AS score FROM sem FULL JOIN lex USING (chunk_id))
        SELECT chunk_id, CAST(coalesce(sem_rank, -1) AS INTEGER) AS sem_rank, CAST(coalesce(lex_rank, -1) AS INTEGER) AS lex_rank, round(score, 9) AS score FROM j
        ORDER BY j.score DESC, j.sem_rank NULLS LAST, j.lex_rank NULLS LAST, chunk_id LIMIT 10""",
    "file_agg_sum": f"{_phrases(QUERY)} SELECT source AS file_path, round(sum(score), 9) AS score FROM sc JOIN documents USING (doc_id) GROUP BY source ORDER BY sum(sc.score) DESC, source LIMIT 10",
    "file_agg_max": f"{_phrases(QUERY)} SELECT source AS file_path, round(max(score), 9) AS score FROM sc JOIN documents USING (doc_id) GROUP BY source ORDER BY max(sc.score) DESC, source LIMIT 10",
    "tier_boost": f"{_BOOSTED} SELECT chunk_id, tier, round(score, 9) AS score FROM b ORDER BY b.score DESC, chunk_id LIMIT 20",
    "tier_filter_no_deps": f"{_BOOSTED} SELECT chunk_id, round(score, 9) AS score FROM b WHERE coalesce(tier, 'project') = 'project' ORDER BY b.score DESC, chunk_id LIMIT 20",
    "deps_only": f"{_BOOSTED}, t AS (SELECT * FROM b ORDER BY score DESC, chunk_id LIMIT 300) SELECT chunk_id, round(score, 9) AS score FROM t WHERE tier = 'dependency'",
    "memory_like": "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE text ILIKE '%lich_n%Keit%' OR source ILIKE '%lich_n%Keit%' ORDER BY doc_id DESC LIMIT 25",
}
QUERIES = {f.__name__: f for f in (
    lexical_bm25_topk, lexical_top_terms, lexical_top_phrases, lexical_prefix_terms, lexical_phrase_prefix, lexical_batch_terms, semantic_knn_topk, semantic_knn_l2, semantic_knn_batch, semantic_ivf_topk, semantic_ivf_batch, semantic_ivf_recall, hybrid_rrf, file_agg_sum, file_agg_max, tier_boost, tier_filter_no_deps, deps_only, memory_like,
)}
