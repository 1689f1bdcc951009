"""Vector search, tier weighting, rank fusion and file aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions.languages import boost_of
from ..functions.vectors import cosine, l2

RRF = 60
BLOCK = 1024  # vectors of a block of a batched search
ARROW_BYTES = 4 << 20  # of an Arrow batch of pairs of blocks: a pair is a megabyte and more, and a worker holds whole batches


def search_semantic(vectors: DataFrame, query: list[float], k: int | None, *, ref: str = "chunk_id", embedding: str = "embedding", metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """Exact nearest neighbours, ``ref, score`` with score = 1 - distance; vectors of another
    length are skipped.  A scan and a distributed top-k: nothing is shuffled but k rows a task.
    Without k all are given, in no order."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.size(embedding) == len(query))
    if where is not None:
        rows = rows.filter(where)
    score = cosine(F.col(embedding), q) if metric == "cosine" else 1 - l2(F.col(embedding), q)
    scored = rows.select(F.col(ref), score.alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), ref).limit(k)


def search_semantic_batch(vectors: DataFrame, queries: DataFrame, k: int, *, ref: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """Many queries (``query_id, q``) against all vectors: ``query_id, ref, score, rank``.

    Both sides are packed into blocks of BLOCK rows; a pair of blocks is one matrix product that gives the best k
    of its block only, so what is shuffled is k rows for each query and block.  Blocks of vectors are dealt to as many
    places as there are shuffle partitions and move once; query blocks, the smaller side, go to each place.  Nothing is
    collected; the work is queries times vectors, as no index is asked for.  Vectors of another length than a
    query's are skipped; scores are rounded to 12 decimals, so that equal vectors tie and go by ``ref``."""
    places = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = lambda rows, key, vector: packed_blocks(rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("n")))
    left = packed(queries, "query_id", "q").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    right = packed(vectors, ref, embedding).withColumn("place", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(places)).cast("int"))
    return pair_blocks(left, right, k, ref, ("n", "place"))


def pair_blocks(left: DataFrame, right: DataFrame, k: int, ref: str, on: tuple[str, ...] = ("n",)) -> DataFrame:
    """Blocks of queries and of vectors that meet by ``on``, multiplied: ``query_id``, ``ref``, ``score`` and ``rank`` of each query's best k.
    Batches are limited by their bytes (a session setting), so a worker's memory does not grow with the pairs of its task."""
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    kinds = left.schema["keys"].dataType.elementType, right.schema["keys"].dataType.elementType

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                refs, ids = (batch.column(c)[i].values for c in ("keys", "qs"))
                v, q = (batch.column(c)[i].values.to_numpy().reshape(len(x), -1) for c, x in (("vs", refs), ("qv", ids)))
                lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
                score = np.round(np.divide(q @ v.T, lengths, out=np.zeros_like(lengths), where=lengths > 0), 12)
                order = pc.rank(refs, tiebreaker="first").to_numpy()  # equal scores go by ref
                top = np.stack([np.lexsort((order, -row))[:k] for row in score])
                row = np.repeat(np.arange(len(top)), top.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), refs.take(pa.array(top.ravel())), pa.array(score[row, top.ravel()])], ["query_id", ref, "score"])

    schema = StructType().add("query_id", kinds[0]).add(ref, kinds[1]).add("score", DoubleType())
    pairs = right.join(left.withColumnsRenamed({"keys": "qs", "vs": "qv"}), list(on))
    scored = pairs.select("keys", "vs", "qs", "qv").mapInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), ref))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def packed_blocks(rows: DataFrame) -> DataFrame:
    """``n, keys, vs``: blocks of up to BLOCK rows ``key, v, n`` of one ``n`` (and one length), packed where they are, without a shuffle."""
    kind = rows.schema["key"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in pc.unique(batch.column("n")).to_pylist():
                some = batch.filter(pc.equal(batch.column("n"), n))
                for at in range(0, some.num_rows, BLOCK):
                    part = some.slice(at, BLOCK)
                    flat = part.column("v").flatten()
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (part.column("key"), flat)]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *lists], ["n", "keys", "vs"])

    return rows.mapInArrow(pack, StructType().add("n", IntegerType()).add("keys", ArrayType(kind)).add("vs", ArrayType(DoubleType())))


def weigh_tiers(results: DataFrame, k: int, *, include_deps: bool = True, boosts: dict[str, float] | None = None, tier: str = "tier", key: str = "chunk_id") -> DataFrame:
    """Scores times the weight of their tier, optionally of project rows only, best k."""
    rows = results.withColumn("score", F.col("score") * boost_of(F.col(tier), boosts))
    if not include_deps:
        rows = rows.filter(F.coalesce(F.col(tier), F.lit("project")) == "project")
    return rows.orderBy(F.desc("score"), key).limit(k)


def dependencies_only(results: DataFrame, tier: str = "tier") -> DataFrame:
    """Of given results (after their top-k), those of dependencies; a missing tier is none."""
    return results.filter(F.col(tier) == "dependency")


def fuse(semantic: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 0.7, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``key, score``; ties by semantic, then lexical rank."""
    ranked = lambda df, name: df.select(key, (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias(name))
    rows = ranked(semantic, "sem_rank").join(ranked(lexical, "lex_rank"), key, "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (RRF + F.col(r)), F.lit(0.0))
    rows = rows.withColumn("score", part("sem_rank", vector_weight) + part("lex_rank", 1 - vector_weight))
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank"), key).limit(k)


def by_file(results: DataFrame, k: int, how: str = "sum", path: str = "file_path") -> DataFrame:
    """Results grouped to files by the sum or the maximum of their scores."""
    total = F.sum("score") if how == "sum" else F.max("score")
    return results.groupBy(path).agg(total.alias("score")).orderBy(F.desc("score"), path).limit(k)


def one_per_place(results: DataFrame, k: int) -> DataFrame:
    """The best result of each file and start line, best k."""
    first = F.row_number().over(Window.partitionBy("file_path", "start_line").orderBy(F.desc("score"), "chunk_id"))
    return results.withColumn("_r", first).filter("_r = 1").drop("_r").orderBy(F.desc("score"), "chunk_id").limit(k)


def by_key(chunks: DataFrame, value: object, key: str = "uri") -> DataFrame:
    """The chunk of one URI or id; no row without it.  An equality filter, which reaches the scan."""
    return chunks.filter(F.col(key) == F.lit(value))


def with_chunks(results: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the results' chunks; results are at most k rows and are broadcast."""
    return chunks.join(F.broadcast(results), key).orderBy(F.desc("score"), key)


def valid_only(results: DataFrame, manifest: DataFrame, key: str = "uri") -> DataFrame:
    """Results whose chunk the manifest still lists as valid."""
    return results.join(manifest.select(F.explode("valid_chunks").alias(key)).distinct(), key, "left_semi")
