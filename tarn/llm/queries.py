"""Registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_spread, read_table
from . import decontaminate, divergence, html_text, media, mixing, near_dup, pii, quality, repeats, spelling, token_store, url_rules, warc
from .sql import OP11, OP12, OP13

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, sf_dir, name) if name in ("documents", "pages") else read_table(spark, sf_dir, name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents")).drop("base")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.store_and_describe(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"])), ",")
    feature = F.format_string("frames=%d tensor=%s segments=%s", F.col("n_frames"), F.sha2("tensor", 256), spans)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_index(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read_table(spark, sf_dir, "pages")).drop("via")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_media, op3_near_dup, op4_html, op5_repeats, op6_decontaminate, op7_mix, op8_tokens, op9_quality, op10_warc, op11_urls, op12_divergence, op13_spelling)
}

ORACLE_SQL = {
    "op11_urls": OP11,
    "op12_divergence": OP12,
    "op13_spelling": OP13,
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN g.last IS NOT NULL AND g.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
    """,
}
