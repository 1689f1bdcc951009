"""Queries of chunking, text functions and index upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages, text
from ..operators import chunking, maintain
from ..sources.tables import read_spread, read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "documents")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file_path"), "text")


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("code", F.md5("code"))


def fixed_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(chunking.fixed_lines(_files(spark, sf_dir), 3)).select("file_path", "symbol", "start_line", "end_line", "code")


def fixed_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(chunking.fixed_chars(_files(spark, sf_dir), 1200)).select("file_path", "start_line", "end_line", "code")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    lines = chunking.fixed_lines(files, 3).select(F.lit("lines").alias("strategy"), "code")
    chars = chunking.fixed_chars(files, 1200).select(F.lit("chars").alias("strategy"), "code")
    return chunking.chunk_stats(lines.unionAll(chars))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks of one line each."""
    rows = read_spread(spark, sf_dir, "conversations")
    line = F.col("turn").cast("int") + 1
    return rows.select(
        F.col("conv_id").cast("string").alias("file_path"), F.concat(F.lit("t"), "turn").alias("symbol"), F.col("role").alias("chunk_type"), F.lit("text").alias("language"),
        F.lit(None).cast("string").alias("parent_header"), line.alias("start_line"), line.alias("end_line"), "text",
    ).withColumnRenamed("text", "code")


def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _documents(spark, sf_dir)
    whole = files.select(
        F.col("doc_id").cast("string").alias("file_path"), F.col("source").alias("symbol"), F.lit("unknown").alias("chunk_type"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("parent_header"),
        F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), F.col("text").alias("code"),
    )
    return _digest(chunking.split_oversized(whole, 1200)).select("file_path", "symbol", "start_line", "end_line", "code")


def greedy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(chunking.greedy_merge(_turns(spark, sf_dir), 300)).select("file_path", "symbol", "start_line", "end_line", "code")


def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.fixed_lines(_files(spark, sf_dir), 1)
    return _digest(chunking.deduplicate(chunks)).select("file_path", "start_line", "code")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    spans = chunking.fixed_lines(files, 1).filter((F.col("start_line") % 4 == 2) & (F.col("file_path").cast("int") % 7 > 0)).select("file_path", "start_line", "end_line")
    return _digest(chunking.coverage_gaps(spans, files)).select("file_path", "symbol", "start_line", "end_line", "code")


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a user's events that overlap ranges of the same customer's orders."""
    events, orders = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "orders")
    line = lambda c: (F.col(c) % 1000).cast("int")
    a = events.select(F.col("user_id").alias("file_path"), F.col("event_id").alias("id"), line("event_id").alias("start_line"), (line("event_id") + F.floor(F.col("value") % 150)).cast("int").alias("end_line"))
    b = orders.select(F.col("o_custkey").alias("file_path"), F.col("o_orderkey").alias("id"), line("o_orderkey").alias("start_line"), (line("o_orderkey") + F.floor(F.col("o_totalprice") % 150)).cast("int").alias("end_line"))
    return chunking.overlapping(a, b, "file_path")


def sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.sanitize_query(F.col("text")).alias("fts"))


def preprocess_code_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "pages").select("page_id", text.code_query(F.col("html")).alias("terms"))


def nl_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.keywords(F.col("text")).alias("words"))


def grep_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.array_join(text.grep_keywords(F.col("text")), " ").alias("words"))


def doc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.regexp_replace("text", r"([A-Za-z]+)[.,]\s", "`$1.x` `the` ")
    return _documents(spark, sf_dir).select("doc_id", F.array_join(text.doc_symbols(quoted), " ").alias("symbols"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.col("source").alias("file_path"), F.col("n_chars").alias("created_at"))
    return maintain.index_stats(rows)


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.language_counts(_documents(spark, sf_dir).withColumnRenamed("lang", "language"))


def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.char_count(F.col("text")).alias("chars"), text.preview(F.col("text")).alias("preview"))


def extension_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*[F.lit(e) for e in ("py", "JS", "h", "kts", "weird", "tf")])
    path = F.concat(F.lit("src/"), "p_name", F.lit("."), F.element_at(exts, (F.col("p_partkey") % 6 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(languages.language_of(path).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents: 3 chunks each, one of them stale for every fifth."""
    d = _documents(spark, sf_dir)
    chunk = lambda i: F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}"))
    fifth = F.col("doc_id") % 5 == 0
    none = F.array().cast("array<string>")
    return d.select(
        F.col("doc_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("hash"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"),
        F.when(fifth, F.array(chunk(1), chunk(2))).otherwise(F.array(chunk(1), chunk(2), chunk(3))).alias("valid_chunks"), F.when(fifth, F.array(chunk(3))).otherwise(none).alias("stale_chunks"),
    )


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).filter("doc_id % 11 <> 3")
    body = F.when(F.col("doc_id") % 6 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    late = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 0.5).otherwise(F.col("doc_id").cast("double"))
    listing = d.select(F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("n"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("file_path"), F.sha2(body, 256).alias("hash"), late.alias("mtime"), F.length(body).cast("long").alias("size"))
    return maintain.changed_files(_manifest(spark, sf_dir), listing)


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.staleness(_manifest(spark, sf_dir))


def update_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    key = F.col("file_path").cast("int")
    fresh = m.filter(key % 4 == 0).select("file_path", "hash", (F.col("mtime") + 1).alias("mtime"), "size", F.array(F.concat("file_path", F.lit(":2")), F.concat("file_path", F.lit(":9"))).alias("valid_chunks"))
    out = maintain.update_manifest(m, fresh)
    return out.select("file_path", "mtime", F.array_join("valid_chunks", " ").alias("valid"), F.array_join(F.array_sort("stale_chunks"), " ").alias("stale"))


def compact_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    chunks = m.select(F.explode(F.concat("valid_chunks", "stale_chunks")).alias("uri"), "size")
    kept, _ = maintain.compact(chunks, m, threshold=0.0)
    return kept


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.cache_stats(_manifest(spark, sf_dir))


def upsert_by_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    uri = F.concat(F.lit("u"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    old = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), uri.alias("uri"), F.col("n_chars").alias("n"))
    new = d.filter("doc_id % 3 = 0").select(F.lit(None).cast("long").alias("chunk_id"), uri.alias("uri"), (-F.col("n_chars")).alias("n"))
    return maintain.upsert(old, new)


_LINES = "SELECT doc_id, CAST(doc_id AS VARCHAR) AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"
_FIXED3 = f"""SELECT file_path, min(i) AS start_line, max(i) AS end_line, string_agg(line, chr(10) ORDER BY i) AS code FROM ({_LINES}) GROUP BY file_path, (i - 1) // 3"""


def _fold(weight: str, most: int, source: str) -> str:
    """Lines to parts by a running size: a recursive query that walks each file line by line."""
    return f"""
        RECURSIVE l AS MATERIALIZED (SELECT file_path, i, line, {weight} AS w FROM ({source})),
        r AS (SELECT file_path, i, w AS size, 0 AS part FROM l WHERE i = 1
              UNION ALL
              SELECT l.file_path, l.i, CASE WHEN r.size + l.w > {most} THEN l.w ELSE r.size + l.w END, r.part + CASE WHEN r.size + l.w > {most} THEN 1 ELSE 0 END
              FROM r JOIN l ON l.file_path = r.file_path AND l.i = r.i + 1),
        parts AS (SELECT r.file_path, part, min(r.i) AS start_line, max(r.i) AS end_line, string_agg(line, chr(10) ORDER BY r.i) AS code FROM r JOIN l ON l.file_path = r.file_path AND l.i = r.i GROUP BY r.file_path, part)"""


_CHARS = _fold("length(line) + 1", 1200, _LINES)
_SOLID_LINE = r"length(translate(line, ' ' || chr(9), ''))"
_MANIFEST = """m AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, doc_id, text, CAST(doc_id AS DOUBLE) AS mtime, n_chars AS size,
    CASE WHEN doc_id % 5 = 0 THEN [doc_id || ':1', doc_id || ':2'] ELSE [doc_id || ':1', doc_id || ':2', doc_id || ':3'] END AS valid_chunks,
    CASE WHEN doc_id % 5 = 0 THEN [doc_id || ':3'] ELSE []::VARCHAR[] END AS stale_chunks FROM documents)"""

ORACLES = {
    "fixed_line_chunks": f"SELECT file_path, file_path || ':L' || start_line || '-' || end_line AS symbol, start_line, end_line, md5(code) AS code FROM ({_FIXED3})",
    "fixed_token_chunks": f"WITH {_CHARS} SELECT file_path, start_line, end_line, md5(code) AS code FROM parts",
    "chunk_stats": f"""WITH {_CHARS}, u AS (SELECT 'chars' AS strategy, code FROM parts UNION ALL SELECT 'lines', code FROM ({_FIXED3}))
        SELECT strategy, count(*) AS n_chunks, avg(length(code)) AS avg_size, min(length(code)) AS min_size, max(length(code)) AS max_size FROM u GROUP BY strategy""",
    "split_oversized": f"""WITH {_fold(_SOLID_LINE, 1200, _LINES)},
        d AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, source, text, len(string_split(text, chr(10))) AS n, length(translate(text, ' ' || chr(9) || chr(10), '')) AS solid FROM documents)
        SELECT file_path, source AS symbol, 1 AS start_line, CAST(n AS INTEGER) AS end_line, md5(text) AS code FROM d WHERE solid <= 1200
        UNION ALL SELECT p.file_path, source || '_part' || (part + 1), CAST(start_line AS INTEGER), CAST(end_line AS INTEGER), md5(code) FROM parts p JOIN d USING (file_path) WHERE solid > 1200""",
    "greedy_merge": """WITH RECURSIVE t AS MATERIALIZED (SELECT CAST(conv_id AS VARCHAR) AS file_path, 't' || turn AS symbol, CAST(turn + 1 AS INTEGER) AS s, text AS code, length(translate(text, ' ' || chr(9) || chr(10), '')) AS n,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
        r AS (SELECT file_path, k, 1 AS g, s AS e, n, n AS last FROM t WHERE k = 1
              UNION ALL
              SELECT t.file_path, t.k, CASE WHEN r.e + 1 >= t.s AND r.n < 300 * 0.8 AND t.n < 300 * 0.8 THEN r.g ELSE r.g + 1 END, t.s,
                     CASE WHEN r.e + 1 >= t.s AND r.n < 300 * 0.8 AND t.n < 300 * 0.8 THEN r.n + t.n ELSE t.n END, t.n
              FROM r JOIN t ON t.file_path = r.file_path AND t.k = r.k + 1)
        SELECT r.file_path, string_agg(t.symbol, '+' ORDER BY r.k) AS symbol, min(t.s) AS start_line, max(t.s) AS end_line, md5(string_agg(t.code, chr(10) ORDER BY r.k)) AS code
        FROM r JOIN t ON t.file_path = r.file_path AND t.k = r.k GROUP BY r.file_path, r.g""",
    "dedup_chunks": f"""SELECT file_path, CAST(i AS INTEGER) AS start_line, md5(line) AS code FROM
        (SELECT *, row_number() OVER (PARTITION BY file_path, trim(line, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY i) AS r FROM ({_LINES})) WHERE r = 1""",
    "coverage_gaps": f"""WITH l AS ({_LINES}), c AS (SELECT *, NOT (i % 4 = 2 AND doc_id % 7 > 0) AS open, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, open ORDER BY i) AS run FROM c),
        k AS (SELECT doc_id, file_path, min(i) AS a, max(i) AS b, max(n) AS n, string_agg(line, chr(10) ORDER BY i) AS code FROM g WHERE open GROUP BY doc_id, file_path, run)
        SELECT file_path, CASE WHEN doc_id % 7 = 0 OR n < 2 THEN 'module_content' ELSE 'module_gap_' || a || '_' || b END AS symbol, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, md5(code) AS code
        FROM k WHERE regexp_matches(code, '[^\\s]')""",
    "overlap_join": """WITH a AS (SELECT user_id AS file_path, event_id AS id, event_id % 1000 AS s, event_id % 1000 + CAST(floor(value % 150) AS BIGINT) AS e FROM events),
        b AS (SELECT o_custkey AS file_path, o_orderkey AS id, o_orderkey % 1000 AS s, o_orderkey % 1000 + CAST(floor(o_totalprice % 150) AS BIGINT) AS e FROM orders)
        SELECT a.file_path, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.file_path = b.file_path AND a.s <= b.e AND b.s <= a.e""",
    "sanitize_query": r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[\w\p{L}]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\w\p{L}]+'), 1) AS i FROM benchmark),
        u AS (SELECT item_id, w, i, row_number() OVER (PARTITION BY item_id, lower(w) ORDER BY i) AS r FROM t WHERE regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{2,}')),
        k AS (SELECT item_id, w, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u WHERE r = 1)
        SELECT b.item_id, coalesce(string_agg(w || '*', ' OR ' ORDER BY i), '""') AS fts FROM benchmark b LEFT JOIN k ON b.item_id = k.item_id AND n <= 20 GROUP BY b.item_id""",
    # camel-case parts without looking ahead: a blank goes before a capital that starts a word after other capitals
    "preprocess_code_query": r"""WITH t AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '[\w\p{L}\p{N}]+'),
            lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{2,}') AND NOT list_contains(string_split('""" + " ".join(text.CODE_KEYWORDS) + r"""', ' '), lower(w))) AS names,
            regexp_extract_all(coalesce(html, ''), '[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_]*') AS calls FROM pages),
        n AS (SELECT page_id, 0 AS part, unnest(names) AS w, generate_subscripts(names, 1) AS i FROM t),
        c AS (SELECT *, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+\b') AS camel FROM n),
        s AS (SELECT page_id, part, i, CASE WHEN len(camel) > 1 THEN camel ELSE [] END || CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda x: length(x) > 1) ELSE [] END || [w] AS ws FROM c
            UNION ALL SELECT page_id, 1, i, [replace(w, '.', ' '), split_part(w, '.', 2)] FROM (SELECT page_id, unnest(calls) AS w, generate_subscripts(calls, 1) AS i FROM t)),
        u AS (SELECT page_id, part, i, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM s),
        d AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(w) ORDER BY part, i, j) AS r FROM u WHERE length(w) > 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, i, j) AS m FROM d WHERE r = 1)
        SELECT p.page_id, coalesce(string_agg(w, ' ' ORDER BY m), '') AS terms FROM pages p LEFT JOIN k ON p.page_id = k.page_id AND m <= 30 GROUP BY p.page_id""",
    "nl_keywords": r"""WITH t AS (SELECT item_id, unnest(string_split_regex(trim(regexp_replace(text, '[^\w\s]', ' ', 'g')), '\s+')) AS w, generate_subscripts(string_split_regex(trim(regexp_replace(text, '[^\w\s]', ' ', 'g')), '\s+'), 1) AS i FROM benchmark),
        k AS (SELECT *, NOT list_contains(string_split('""" + " ".join(text.STOP_WORDS) + r"""', ' '), lower(w)) AS plain,
              contains(w, '_') OR (regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]')) OR (regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AND length(w) > 1) AS code FROM t WHERE w <> '')
        SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM benchmark b LEFT JOIN (SELECT * FROM k WHERE plain OR (code AND NOT regexp_full_match(w, '[A-Z][a-z]*'))) k USING (item_id) GROUP BY b.item_id""",
    "grep_keywords": r"""WITH t AS (SELECT item_id, unnest(string_split_regex(trim(lower(text)), '\s+')) AS w, generate_subscripts(string_split_regex(trim(lower(text)), '\s+'), 1) AS i FROM benchmark)
        SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM benchmark b LEFT JOIN (SELECT * FROM t WHERE length(w) > 2 AND NOT list_contains(string_split('""" + " ".join(text.GREP_STOP_WORDS) + r"""', ' '), w)) k USING (item_id) GROUP BY b.item_id""",
    "doc_symbols": r"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '([A-Za-z]+)[.,]\s', '`\1.x` `the` ', 'g'), '`([a-zA-Z_][a-zA-Z0-9_.\-/]*)`', 1), lambda x: contains(x, '.')))), ' '), '') AS symbols FROM documents""",
    "index_stats": "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_files, max(n_chars) AS last_update FROM documents",
    "language_counts": "SELECT lang AS language, count(*) AS n_chunks FROM documents GROUP BY lang",
    "char_counts": "SELECT doc_id, CAST(length(translate(text, ' ' || chr(10) || chr(9), '')) AS INTEGER) AS chars, replace(text[1:100], chr(10), ' ') AS preview FROM documents",
    "extension_languages": "SELECT CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'c' WHEN 3 THEN 'kotlin' WHEN 4 THEN 'unknown' ELSE 'hcl' END AS language, count(*) AS n_files FROM part GROUP BY 1",
    "changed_files": f"""WITH {_MANIFEST}, l AS (SELECT CASE WHEN doc_id % 13 = 5 THEN 'n' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS file_path, CASE WHEN doc_id % 6 = 1 THEN text || '!' ELSE text END AS body,
            CASE WHEN doc_id % 3 = 1 THEN doc_id + 0.5 ELSE doc_id END AS mtime FROM documents WHERE doc_id % 11 <> 3)
        SELECT coalesce(m.file_path, l.file_path) AS file_path, CASE WHEN m.file_path IS NULL THEN 'new' WHEN l.file_path IS NULL THEN 'deleted' WHEN m.mtime = l.mtime AND m.size = length(l.body) THEN 'same'
            WHEN sha256(m.text) = sha256(l.body) THEN 'same' ELSE 'changed' END AS change FROM m FULL JOIN l ON m.file_path = l.file_path""",
    "staleness": f"""WITH {_MANIFEST}, v AS (SELECT count(DISTINCT c) AS n_valid FROM (SELECT unnest(valid_chunks) AS c FROM m)), s AS (SELECT count(DISTINCT c) AS n_stale FROM (SELECT unnest(stale_chunks) AS c FROM m)),
        f AS (SELECT count(*) AS n_files, count(*) FILTER (len(stale_chunks) > 0) AS n_files_stale FROM m)
        SELECT *, n_stale / (n_valid + n_stale) AS ratio, CASE WHEN ratio < 0.1 THEN 'healthy' WHEN ratio < 0.2 THEN 'acceptable' WHEN ratio < 0.4 THEN 'degraded' ELSE 'critical' END AS status FROM v, s, f""",
    "update_manifest": f"""WITH {_MANIFEST} SELECT file_path, CASE WHEN doc_id % 4 = 0 THEN mtime + 1 ELSE mtime END AS mtime,
        CASE WHEN doc_id % 4 = 0 THEN file_path || ':2 ' || file_path || ':9' ELSE array_to_string(valid_chunks, ' ') END AS valid,
        CASE WHEN doc_id % 4 = 0 THEN file_path || ':1 ' || file_path || ':3' ELSE array_to_string(stale_chunks, ' ') END AS stale FROM m""",
    "compact_valid": f"WITH {_MANIFEST} SELECT unnest(valid_chunks) AS uri, size FROM m",
    "cache_stats": f"WITH {_MANIFEST} SELECT count(*) AS n_files, CAST(sum(len(valid_chunks)) AS BIGINT) AS n_chunks, CAST(sum(size) AS BIGINT) AS n_bytes FROM m",
    "upsert_by_uri": """WITH d AS (SELECT doc_id, 'u' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS uri, n_chars FROM documents), top AS (SELECT max(doc_id) AS t FROM d WHERE doc_id % 2 = 0)
        SELECT doc_id AS chunk_id, uri, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS n FROM d WHERE doc_id % 2 = 0
        UNION ALL SELECT t + row_number() OVER (ORDER BY uri), uri, -n_chars FROM d, top WHERE doc_id % 3 = 0 AND doc_id % 2 = 1""",
}
QUERIES = {f.__name__: f for f in (
    fixed_line_chunks, fixed_token_chunks, chunk_stats, split_oversized, greedy_merge, dedup_chunks, coverage_gaps, overlap_join, sanitize_query, preprocess_code_query, nl_keywords, grep_keywords,
    doc_symbols, index_stats, language_counts, char_counts, extension_languages, changed_files, staleness, update_manifest, compact_valid, cache_stats, upsert_by_uri,
)}
