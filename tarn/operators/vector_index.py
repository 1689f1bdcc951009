"""Approximate nearest neighbours: an inverted file of vectors as tables.

``fit`` finds centroids by k-means over a bounded sample, in Arrow batches; ``build`` gives every vector to its
nearest centroid and writes the lists, partitioned by centroid, with one byte a dimension for what is left over
(residual codes) beside the vector itself.  A search

1. ranks the centroids and reads the lists of the nearest ``probe`` only (partition pruning);
2. scores their codes.  Each code carries the length of its error, so a score is known within a margin, and whatever
   cannot be among the best k by that margin is dropped.  Nothing else is: no cap on candidates;
3. scores what remains from the vectors.

So a search is exact over the lists it reads.  With ``probe=None`` it is exact over all: lists are balls around
their centroids, and those whose nearest possible point is behind the k-th of the first round are left out.

Similarity is the cosine; a zero vector is similar to nothing by 0.  Null vectors and those of another length than ``dimensions``
(that of most) are in no list, and queries of another length find nothing.  Equal scores go by the reference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from .retrieve import packed_blocks, pair_blocks, search_semantic

SAMPLE = 65_536  # vectors that centroids are fitted on, at most
MOST_LISTS = 4_096  # centroids are handed to every task: at most so many
SLACK = 1e-9  # for rounding


@dataclass
class VectorIndex:
    """``lists``: list, ref, embedding, code, scale, error.  ``centroids``: list, center, radius, n."""

    lists: DataFrame
    centroids: DataFrame
    ref: str

    @staticmethod
    def load(spark: SparkSession, path: str, ref: str = "chunk_id") -> VectorIndex:
        return VectorIndex(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids"), ref)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _nearest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * (v @ centers.T), axis=1)


def fit(vectors: DataFrame, lists: int, *, ref: str = "chunk_id", embedding: str = "embedding", sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centroids of at most ``sample`` vectors, those whose references hash lowest.  Each round sums the members of
    each centroid in the tasks; sums (as many rows as tasks times lists at most) are added up by list."""
    some = vectors.select(F.col(embedding).cast("array<double>").alias("v")).orderBy(F.xxhash64(F.col(ref)), F.col(ref)).limit(sample)
    some = some.repartition(max(1, min(vectors.sparkSession.sparkContext.defaultParallelism, sample // 1024))).cache()
    try:
        first = some.limit(lists).collect()  # at most MOST_LISTS vectors
        if not first:
            return np.zeros((0, 0))
        centers = np.unique(_unit(np.array([r.v for r in first], np.float64)), axis=0)
        width = centers.shape[1]
        for _ in range(rounds):

            def sums(batches: Iterator[pa.RecordBatch], centers: np.ndarray = centers) -> Iterator[pa.RecordBatch]:
                total, n = np.zeros_like(centers), np.zeros(len(centers), np.int64)
                for batch in batches:
                    v = _unit(_matrix(batch.column("v"), width))
                    at = _nearest(v, centers)
                    np.add.at(total, at, v)
                    n += np.bincount(at, minlength=len(n))
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.float64()))], ["list", "n", "total"])

            found = some.mapInArrow(sums, "list int, n long, total array<double>")
            added = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate("totals", F.lit(0.0), lambda s, t: s + t[i]))
            rows = found.groupBy("list").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals")).select("list", "n", added.alias("total")).collect()
            moved = centers.copy()
            for r in rows:
                moved[r.list] = np.array(r.total) / r.n
            if np.allclose(moved, centers, atol=1e-6):
                break
            centers = moved
        return centers
    finally:
        some.unpersist()


def build(vectors: DataFrame, path: str, *, ref: str = "chunk_id", embedding: str = "embedding", lists: int | None = None, sample: int = SAMPLE, rows_a_file: int = 1 << 18) -> VectorIndex:
    """Write the index of all ``vectors`` below ``path``.  ``lists`` is the square root of their number unless given.  A list of more than
    ``rows_a_file`` rows is several files, so one that holds a third of all vectors is not one task."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(embedding).isNotNull()).select(F.col(ref).alias("ref"), F.col(embedding).alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (usual["width"], usual["count"]) if usual else (1, 0)
    rows = rows.filter(F.size("embedding") == width)
    many = max(1, min(lists or round(n**0.5), MOST_LISTS, n or 1))
    centers = fit(rows, many, ref="ref", sample=sample)
    kind = rows.schema["ref"].dataType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column("embedding"), width))
            at = _nearest(v, centers)
            left = v - centers[at]
            scale = np.abs(left).max(axis=1) / 127
            code = np.rint(left / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            error = np.linalg.norm(left - code * scale[:, None], axis=1)
            out = [pa.array(at.astype(np.int32)), batch.column("ref"), batch.column("embedding"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(error), pa.array(np.linalg.norm(left, axis=1))]
            yield pa.RecordBatch.from_arrays(out, ["list", "ref", "embedding", "code", "scale", "error", "away"])

    schema = StructType().add("list", IntegerType()).add("ref", kind).add("embedding", rows.schema["embedding"].dataType).add("code", "binary").add("scale", DoubleType()).add("error", DoubleType()).add("away", DoubleType())
    given = rows.mapInArrow(assign, schema)
    salt = F.pmod(F.xxhash64("ref"), F.lit(max(1, n // (rows_a_file * 4))))  # rows of a list are spread by their reference
    given.repartition("list", salt).write.partitionBy("list").option("maxRecordsPerFile", rows_a_file).parquet(f"{path}/lists")
    held = spark.read.schema(schema).parquet(f"{path}/lists").groupBy("list").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "list int, center array<double>")
    table.join(held, "list").coalesce(1).write.parquet(f"{path}/centroids")
    return VectorIndex(spark.read.schema(schema).parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids"), ref)


def _ranked(index: VectorIndex, query: np.ndarray) -> list[tuple[int, float, float]]:
    """``list, similarity of the centroid, the largest that a member can have``, nearest first."""
    rows = index.centroids.collect()  # at most MOST_LISTS
    if not rows or len(rows[0].center) != len(query):
        return []
    centers = np.array([r.center for r in rows])
    near = 2 * (centers @ query) - (centers * centers).sum(axis=1)
    best = centers @ query + np.array([r.radius for r in rows]) * np.linalg.norm(query)
    order = np.argsort(-near, kind="stable")
    return [(rows[i].list, float(near[i]), float(best[i])) for i in order]


def _bounds(index: VectorIndex, query: np.ndarray, lists: list[int]) -> DataFrame:
    """``ref, list, low, high`` of all members of ``lists``, from their codes alone."""
    centers = {r.list: np.array(r.center) for r in index.centroids.filter(F.col("list").isin(lists)).collect()}
    size = float(np.linalg.norm(query))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float64)
            base = np.array([centers[i] @ query for i in batch.column("list").to_pylist()])
            about = base + batch.column("scale").to_numpy() * (code @ query)
            margin = batch.column("error").to_numpy() * size + SLACK
            yield pa.RecordBatch.from_arrays([batch.column("ref"), batch.column("list"), pa.array(about - margin), pa.array(about + margin)], ["ref", "list", "low", "high"])

    schema = StructType().add("ref", index.lists.schema["ref"].dataType).add("list", IntegerType()).add("low", DoubleType()).add("high", DoubleType())
    return index.lists.filter(F.col("list").isin(lists)).select("ref", "list", "code", "scale", "error").mapInArrow(score, schema)


def search(index: VectorIndex, query: list[float], k: int, probe: int | None = None) -> DataFrame:
    """``ref, score`` of the best k in the ``probe`` nearest lists; with None in all."""
    q = _unit(np.array([query], np.float64))[0]
    order = _ranked(index, q)
    empty = search_semantic(index.lists.limit(0).select("ref", "embedding"), query, k, ref="ref")
    if not order or not k:
        return empty.withColumnRenamed("ref", index.ref)
    lists, held = [], 0
    sizes = {r.list: r.n for r in index.centroids.select("list", "n").collect()}
    for at, _, _ in order:  # the first round: the nearest that hold k rows
        if len(lists) >= (probe or 1) and (held >= k or probe):
            break
        lists.append(at)
        held += sizes[at]

    def kth(lists: list[int]) -> float:
        low = _bounds(index, q, lists).select("low").orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("m"), F.count(F.lit(1)).alias("n")).first()
        return low.m if low.n == k else float("-inf")

    least = kth(lists)
    if probe is None:
        lists = [at for at, _, best in order if at in set(lists) or best + SLACK >= least]
    kept = _bounds(index, q, lists).filter(F.col("high") >= least).select("ref", "list")
    rows = index.lists.filter(F.col("list").isin(lists)).select("ref", "list", "embedding").join(kept, ["list", "ref"], "left_semi")
    return search_semantic(rows, query, k, ref="ref").withColumnRenamed("ref", index.ref)


def search_batch(index: VectorIndex, queries: DataFrame, k: int, probe: int) -> DataFrame:
    """Many queries (``query_id, q``), each against its ``probe`` nearest lists: ``query_id, ref, score, rank``.  Queries go to
    the lists they ask; blocks of a list's queries and of its vectors meet by list and are matrix products."""
    rows = index.centroids.orderBy("list").collect()  # at most MOST_LISTS
    kind = queries.schema["query_id"].dataType
    ids = np.array([r.list for r in rows], np.int32)
    centers = np.array([r.center for r in rows]) if rows else np.zeros((1, 1))
    width = centers.shape[1]
    take = min(probe, len(rows))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column("v"), width))
            near = 2 * (v @ centers.T) - (centers * centers).sum(axis=1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :take]
            at = pa.array(np.repeat(np.arange(len(v)), take))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("v").take(at), pa.array(ids[top.ravel()])], ["key", "v", "n"])

    asked = queries.filter(F.size("q") == width).select(F.col("query_id").alias("key"), F.col("q").cast("array<double>").alias("v"))
    routed = asked.mapInArrow(route, StructType().add("key", kind).add("v", ArrayType(DoubleType())).add("n", IntegerType()))
    left = packed_blocks(routed.repartition("n"))
    right = packed_blocks(index.lists.select(F.col("ref").alias("key"), F.col("embedding").cast("array<double>").alias("v"), F.col("list").alias("n")))
    return pair_blocks(left, right, k, index.ref)


def probe_for(index: VectorIndex, recall: float = 0.95, k: int = 10, *, queries: int = 256) -> int:
    """The fewest lists to probe for this share of the exact best k, measured on ``queries`` indexed vectors (those whose references
    hash lowest): each of their exact neighbours lies in the list that is so-and-so many'th nearest to the query."""
    some = index.lists.orderBy(F.xxhash64("ref"), "ref").limit(queries).select(F.col("ref").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    asked = {r.query_id: np.array(r.q) for r in some.collect()}
    rows = index.centroids.orderBy("list").collect()
    if not asked or not rows:
        return 1
    centers, ids = np.array([r.center for r in rows]), [r.list for r in rows]
    near = 2 * (_unit(np.array(list(asked.values()))) @ centers.T) - (centers * centers).sum(axis=1)
    place = {q: {ids[j]: i + 1 for i, j in enumerate(np.argsort(-row, kind="stable"))} for q, row in zip(asked, near, strict=True)}
    exact = search_batch(index, some, k, len(rows)).select("query_id", F.col(index.ref).alias("ref"))
    needed = sorted(place[r.query_id][r.list] for r in exact.join(index.lists.select("ref", "list"), "ref").collect())  # queries times k rows
    return needed[max(0, -int(-recall * len(needed) // 1) - 1)]
