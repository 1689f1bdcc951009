"""Retrieval quality: recall, precision, nDCG, MRR, hits, averages and comparisons.

``run``: ``system, query_id, item, rank`` (from 1); ``relevant``: ``query_id, item``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _judged(run: DataFrame, relevant: DataFrame) -> DataFrame:
    marks = relevant.select("query_id", "item").distinct().withColumn("_rel", F.lit(1))
    return run.join(marks, ["query_id", "item"], "left").withColumn("_rel", F.coalesce("_rel", F.lit(0)))


def metrics(run: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per system, query and k: recall, precision, ndcg, hit; and mrr (without a cut-off)."""
    judged = _judged(run, relevant)
    # set semantics for recall and precision: an item counts at its best rank
    best = judged.groupBy("system", "query_id", "item").agg(F.min("rank").alias("rank"), F.max("_rel").alias("_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.col("k"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    sizes = relevant.select("query_id", "item").distinct().groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_rel"))
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = best.select("system", "query_id", "rank", "_rel", cuts).groupBy("system", "query_id", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), F.col("_rel")).otherwise(0)).alias("n_hit"), F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first")
    )
    gains = judged.select("system", "query_id", "rank", "_rel", cuts).groupBy("system", "query_id", "k").agg(
        F.sum(F.when((F.col("rank") <= F.col("k")) & (F.col("_rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    rows = hits.join(gains, ["system", "query_id", "k"]).join(sizes, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        "system", "query_id", "k", share(F.col("n_hit"), F.col("n_rel")).alias("recall"), (F.col("n_hit") / F.col("k")).alias("precision"),
        F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("n_hit") > 0).alias("hit"),
    )


def averages(measured: DataFrame) -> DataFrame:
    """Means over queries per system and k."""
    names = ("recall", "precision", "ndcg", "mrr")
    return measured.groupBy("system", "k").agg(*[F.avg(n).alias(n) for n in names], F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def deltas(means: DataFrame, base: str, measure: str = "recall") -> DataFrame:
    """Each system's measure beside the base system's, and the difference, per k."""
    first = means.filter(F.col("system") == base).select("k", F.col(measure).alias("base"))
    return means.join(first, "k").select("system", "k", F.col(measure).alias("value"), "base", (F.col(measure) - F.col("base")).alias("delta"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def latency(rows: DataFrame, value: str, by: str, cuts: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Element int(n * q) of the sorted values (from 0, not interpolated).

    Values are range-partitioned, so a group of any size is ranked by many tasks: within a partition, after the
    counts of the partitions before (one row for each group and partition)."""
    dealt = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("_v")).repartitionByRange(by, "_v").withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_c").over(group).alias("_n"))
    inner = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_v")) - 1
    ranked = dealt.withColumn("_i", inner).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).withColumn("_i", F.col("_i") + F.col("_before"))
    at = [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * q), F.col("_v"))).alias(f"p{round(q * 100)}") for q in cuts]
    return ranked.groupBy(by).agg(*at)


def select_queries(queries: DataFrame, difficulty: str | None = None, category: str | None = None) -> DataFrame:
    """Queries of a difficulty and a category."""
    for column, wanted in (("difficulty", difficulty), ("category", category)):
        if wanted:
            queries = queries.filter(F.col(column) == wanted)
    return queries


def match_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """MRR and hit at k where a result counts if an expected text is part of its symbol or path, whatever the case.

    ``results``: ``query_id, rank, symbol, file_path``; ``expected``: ``query_id, expected`` (array)."""
    has = lambda c: F.exists("expected", lambda e: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(e)))
    rows = results.join(expected, "query_id").withColumn("_ok", has("symbol") | has("file_path"))
    first = F.min(F.when(F.col("_ok"), F.col("rank")))
    return rows.groupBy("query_id").agg(F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), F.coalesce(first <= k, F.lit(False)).alias("hit"))


def set_statistics(queries: DataFrame) -> DataFrame:
    """Queries by difficulty and category, and the mean number of relevant files."""
    return queries.groupBy("difficulty", "category").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.size("relevant_files")).alias("avg_relevant"))
