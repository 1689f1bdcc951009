"""Index upkeep: manifests, change detection, staleness, upserts and compaction.

A manifest row is ``file_path, hash, mtime, size, valid_chunks, stale_chunks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def changed_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """``file_path, change``: ``new``, ``same``, ``changed`` or ``deleted``.  Equal time and size mean
    the same; otherwise the hash decides (read lazily from ``listing.hash``)."""
    m = manifest.select("file_path", F.col("hash").alias("_h"), F.col("mtime").alias("_t"), F.col("size").alias("_s"))
    both = m.join(listing.select("file_path", "hash", "mtime", "size"), "file_path", "full_outer")
    kind = (
        F.when(F.col("_h").isNull(), "new").when(F.col("hash").isNull() & F.col("mtime").isNull(), "deleted")
        .when((F.col("_t") == F.col("mtime")) & (F.col("_s") == F.col("size")), "same").when(F.col("_h") == F.col("hash"), "same").otherwise("changed")
    )
    return both.select("file_path", kind.alias("change"))


def update_manifest(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Next manifest: files of ``fresh`` (same columns without stale_chunks) get their new chunks, and valid
    chunks that are gone become stale; other files stay."""
    old = manifest.select("file_path", *[F.col(c).alias(f"_{c}") for c in ("hash", "mtime", "size", "valid_chunks", "stale_chunks")])
    both = old.join(fresh, "file_path", "full_outer")
    none = F.array().cast("array<string>")
    stale = F.array_distinct(F.concat(F.coalesce("_stale_chunks", none), F.coalesce("_valid_chunks", none)))
    seen = F.col("valid_chunks").isNotNull()
    return both.select(
        "file_path", *[F.when(seen, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("hash", "mtime", "size", "valid_chunks")],
        F.when(seen, F.array_except(stale, F.coalesce("valid_chunks", none))).otherwise(F.col("_stale_chunks")).alias("stale_chunks"),
    )


def drop_deleted(manifest: DataFrame, present: DataFrame) -> DataFrame:
    return manifest.join(present.select("file_path").distinct(), "file_path", "left_semi")


def clear_stale(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("stale_chunks", F.array().cast("array<string>"))


def health(ratio: Column) -> Column:
    return F.when(ratio < 0.1, "healthy").when(ratio < 0.2, "acceptable").when(ratio < 0.4, "degraded").otherwise("critical")


def advice(ratio: Column) -> Column:
    """What to do about a share of stale chunks."""
    return F.when(ratio < 0.1, "No action needed").when(ratio < 0.2, "Compact soon").when(ratio < 0.4, "Compact now").otherwise("Rebuild the index")


def staleness(manifest: DataFrame) -> DataFrame:
    """One row: distinct valid and stale chunks, their ratio, files, files with stale chunks, status."""
    sides = None
    for side in ("valid", "stale"):
        part = manifest.select(F.explode(f"{side}_chunks").alias("c")).distinct().agg(F.count(F.lit(1)).alias(f"n_{side}"))
        sides = part if sides is None else sides.crossJoin(part)
    files = manifest.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(F.when(F.size("stale_chunks") > 0, 1).otherwise(0)), F.lit(0)).alias("n_files_stale"))
    n = F.col("n_valid") + F.col("n_stale")
    rows = sides.crossJoin(files).withColumn("ratio", F.when(n > 0, F.col("n_stale") / n).otherwise(0.0))
    return rows.withColumn("status", health(F.col("ratio")))


def duplicate_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that more than one row has."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def relative_paths(manifest: DataFrame) -> DataFrame:
    """Paths that are not absolute."""
    return manifest.filter(~F.col("file_path").startswith("/")).select("file_path")


def cache_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(F.size("valid_chunks")), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))


def upsert(chunks: DataFrame, new: DataFrame, key: str = "uri", id_column: str = "chunk_id", ids: DataFrame | None = None) -> DataFrame:
    """Next snapshot of ``chunks``: rows of ``new`` replace those of the same ``key`` and keep their id;
    others get ids after the largest (of ``ids``, where ``chunks`` is a part of the table).

    New ids are numbered without one global sort: rows are range-partitioned by key, counted by
    partition, and numbered from the sum of the counts before."""
    last = Window.partitionBy(key).orderBy(F.desc("_order"))
    fresh = new.withColumn("_order", F.monotonically_increasing_id()) if "_order" not in new.columns else new
    fresh = fresh.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_order")
    known = fresh.join(chunks.select(key, F.col(id_column).alias("_id")), key, "left")
    kept = known.filter("_id is not null").withColumn(id_column, F.col("_id")).drop("_id")
    added = known.filter("_id is null").drop("_id").repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    before = added.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    top = (chunks if ids is None else ids).agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    added = added.withColumn("_i", inner).join(F.broadcast(before), "_part").crossJoin(F.broadcast(top))
    added = added.withColumn(id_column, F.col("_top") + F.col("_before") + F.col("_i")).drop("_part", "_i", "_before", "_top")
    names = chunks.columns
    untouched = chunks.join(fresh.select(key), key, "left_anti")
    return untouched.select(*names).unionByName(kept.select(*names)).unionByName(added.select(*names))


def compact(chunks: DataFrame, manifest: DataFrame, key: str = "uri", threshold: float = 0.2) -> tuple[DataFrame, DataFrame] | None:
    """Chunks that are still valid and a manifest without stale ones; None while the ratio is under ``threshold``."""
    if staleness(manifest).first()["ratio"] < threshold:
        return None
    valid = manifest.select(F.explode("valid_chunks").alias(key)).distinct()
    return chunks.join(valid, key, "left_semi"), clear_stale(manifest)


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.max("created_at").alias("last_update"))


def language_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n_chunks"))


def skipped(files: DataFrame, examples: int = 3) -> DataFrame:
    """Skipped files by reason: how many, and the first few paths."""
    first = Window.partitionBy("skip_reason").orderBy("file_path")
    rows = files.filter("skip_reason is not null").withColumn("_r", F.row_number().over(first))
    return rows.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col("file_path")))).alias("examples"))


def throughput(files: Column, chunks: Column, size: Column, seconds: Column) -> list[Column]:
    per = lambda x: F.round(F.when(seconds > 0, x / seconds).otherwise(0.0), 2)
    return [per(files).alias("files_per_s"), per(chunks).alias("chunks_per_s"), per(size / 1e6).alias("mb_per_s")]
