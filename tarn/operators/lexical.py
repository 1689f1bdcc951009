"""Full-text index and BM25 search with phrases and prefixes.

The index is ordinary tables: ``postings(term, chunk_id, field, pos, dl)``, one row per token,
and ``lengths(chunk_id, dl)``.  Searches are joins and grouped sums, for any number of
queries at once; phrase positions line up by grouping on the phrase's start.

A saved index is bucketed by blocks of chunk ids: texts are shuffled once, before they are cut into tokens, and whatever is
grouped by chunk or block is grouped in the task that reads the bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, search_terms, tokens

K1, B = 1.2, 0.75


HEAD = 3  # leading letters by which prefixes meet the dictionary
SPAN_BITS = 7
SPAN = 1 << SPAN_BITS  # chunk ids of a block
BUCKET_TOKENS = 2_000_000  # of a bucket of a saved index, about: a task sorts so many


@dataclass
class TextIndex:
    """Tables of an index.  ``terms`` (the dictionary: distinct terms with their heads) is there for saved indexes; without it
    queries' tokens are compared with the postings themselves in their one scan.  ``blocks`` tells of each term and block of
    chunk ids how often it occurs in a chunk at most, in how short a chunk, and in which chunks (:func:`search_top`).  ``texts``
    are what an index that is not saved was built from: ``chunk_id`` and the fields."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame | None = None
    blocks: DataFrame | None = None
    texts: DataFrame | None = None

    def save(self, path: str) -> None:
        """Postings are bucketed by block and sorted by term and chunk in each bucket, so scans for few terms skip row groups and
        pages, and those for few blocks skip buckets.  The dictionary and the blocks come from the buckets, in one pass each."""
        spark = self.postings.sparkSession
        self.lengths.write.parquet(f"{path}/lengths")
        total = spark.read.parquet(f"{path}/lengths").agg(F.sum("dl")).first()[0] or 0
        buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_TOKENS))
        dealt = lambda rows: rows.withColumn("block", block_of(F.col("chunk_id"))).repartition(buckets, "block")
        rows = dealt(self.postings) if self.texts is None else _postings(_lists(dealt(self.texts), "block"), "block")
        name = _table_of(path)
        rows.write.bucketBy(buckets, "block").sortBy("term", "chunk_id").option("path", f"{path}/postings").saveAsTable(name)
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")
        term_blocks(spark.table(name)).sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
        dictionary(spark.read.parquet(f"{path}/blocks")).sortWithinPartitions("term").write.parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        name = _table_of(path)
        if not spark.catalog.tableExists(name):  # saved by another session
            files = spark.read.parquet(f"{path}/postings")
            buckets = spark.read.parquet(f"{path}/layout").first().buckets
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
        return TextIndex(spark.table(name), *(spark.read.parquet(f"{path}/{t}") for t in ("lengths", "terms", "blocks")))


def _table_of(path: str) -> str:
    """Name of a saved index's postings in the session's catalog, which knows of their buckets."""
    return f"tarn_postings_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def block_of(chunk_id: Column) -> Column:
    return F.shiftright(chunk_id.cast("long"), SPAN_BITS)


def dictionary(rows: DataFrame) -> DataFrame:
    """``term, head``: distinct terms of ``rows`` with what they start with, in HEAD letters at most."""
    return rows.select("term").distinct().withColumn("head", F.substring("term", 1, HEAD))


def term_blocks(postings: DataFrame) -> DataFrame:
    """``term, block, most, least, marks``: of the chunks of a block that hold a term, the largest number of occurrences, the smallest
    length, and a bit for each."""
    block = F.col("block") if "block" in postings.columns else block_of(F.col("chunk_id")).alias("block")
    by_chunk = postings.groupBy("term", block, "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("f"), F.min("dl").alias("dl"))
    at = F.pmod("chunk_id", F.lit(SPAN)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)))
    marks = [F.bit_or(F.when(F.shiftright(at, 6) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(SPAN // 64)]
    return by_chunk.groupBy("term", "block").agg(F.max("f").alias("most"), F.min("dl").alias("least"), F.array(*marks).alias("marks"))


def _lists(texts: DataFrame, *more: str) -> DataFrame:
    """``chunk_id, dl, fields`` and columns ``more``: the tokens of each field of ``texts``, its other columns."""
    fields = [f for f in texts.columns if f not in ("chunk_id", *more)]
    lists = texts.select("chunk_id", *more, F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields]).alias("fields"))
    return lists.withColumn("dl", F.aggregate("fields", F.lit(0), lambda n, x: n + F.size(x["terms"])))


def _postings(lists: DataFrame, *more: str) -> DataFrame:
    rows = lists.select("chunk_id", *more, "dl", F.explode("fields").alias("x"))
    return rows.select("chunk_id", *more, "dl", F.col("x.field").alias("field"), F.posexplode("x.terms").alias("pos", "term")).select("term", "chunk_id", "field", "pos", "dl", *more)


def build_index(chunks: DataFrame, fields: tuple[str, ...] = ("symbol", "code"), chunk_id: str = "chunk_id") -> TextIndex:
    """Postings carry their chunk's length, so that scoring needs no join with the lengths."""
    texts = chunks.select(F.col(chunk_id).alias("chunk_id"), *fields)
    lists = _lists(texts)
    return TextIndex(_postings(lists), lists.select("chunk_id", "dl"), texts=texts)


def phrases(queries: DataFrame, query: str = "query") -> DataFrame:
    """``query_id, phrase, i, m, token, prefix``: each search term is a phrase of tokens whose last one is a prefix."""
    terms = queries.select("query_id", F.posexplode(search_terms(F.col(query))).alias("phrase", "term"))
    parts = F.filter(F.split(fold(F.col("term")), "_"), lambda x: x != "")
    rows = terms.withColumn("parts", parts).select("query_id", "phrase", F.size("parts").alias("m"), F.posexplode("parts").alias("i", "token"))
    return rows.withColumn("prefix", F.col("i") == F.col("m") - 1)


def _matches() -> Column:
    return F.when(F.col("prefix"), F.col("term").startswith(F.col("token"))).otherwise(F.col("term") == F.col("token"))


def expand(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """``token, prefix, term``: dictionary terms that the tokens of ``wanted`` stand for.  Whole tokens meet their term by equality; prefixes
    meet terms by equal heads of as many letters as they have, HEAD at most, and only those that share one are compared."""
    asked = wanted.select("token", "prefix").distinct()
    whole = terms.select("term").join(F.broadcast(asked.filter(~F.col("prefix"))), F.col("term") == F.col("token")).select("token", "prefix", "term")
    size = F.least(F.length("token"), F.lit(HEAD))
    heads = asked.filter("prefix").select("token", "prefix", size.alias("size"), F.expr(f"left(token, least(length(token), {HEAD}))").alias("head"))
    filed = terms.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("head")), lambda n: F.struct(n.alias("size"), F.substring("head", F.lit(1), n).alias("head")))).alias("h"))
    met = filed.select("term", "h.size", "h.head").join(F.broadcast(heads), ["size", "head"]).filter(F.col("term").startswith(F.col("token")))
    return whole.unionByName(met.select("token", "prefix", "term"))


def _hits(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """Postings of the terms that the queries' tokens stand for.  The queries' tokens are broadcast (20 terms a
    query); with a dictionary they are expanded there and joined by equality."""
    if index.terms is None:
        return index.postings.join(F.broadcast(wanted), _matches())
    return index.postings.join(expand(index.terms, wanted), "term").join(F.broadcast(wanted), ["token", "prefix"])


def occurrences(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``query_id, phrase, chunk_id, dl, f``: how often each phrase occurs in a chunk, within a field."""
    return _counted(_hits(index, wanted))


def _counted(hits: DataFrame) -> DataFrame:
    """Occurrences of phrases from their tokens' postings; with a column ``block`` they keep it."""
    block = [c for c in hits.columns if c == "block"]
    keys = ["query_id", "phrase", "m", *block, "chunk_id", "dl", "field"]
    starts = hits.groupBy(*keys, (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("got"))
    return starts.filter("got = m").groupBy("query_id", "phrase", *block, "chunk_id", "dl").agg(F.count(F.lit(1)).alias("f"))


def _near(asked: list[Row]) -> Column:
    """Whether ``term`` is what any token of ``asked`` stands for; reaches the scan."""
    near = F.lit(False)
    for t in sorted({(r.token, r.prefix) for r in asked}):
        near = near | (F.col("term").startswith(t[0]) if t[1] else F.col("term") == t[0])
    return near


def _met(rows: DataFrame, asked: list[Row]) -> DataFrame:
    """``rows`` with ``query_id, phrase, m, i`` of each token of ``asked`` (one at least) that their ``term`` meets.  Tokens are literals, so rows
    stay where they are, and a frequent term's do not come together."""
    names = ("query_id", "phrase", "m", "i", "token", "prefix")
    every = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in names]) for r in asked])
    hit = F.filter(every, lambda q: F.when(q["prefix"], F.col("term").startswith(q["token"])).otherwise(F.col("term") == q["token"]))
    return rows.filter(_near(asked)).withColumn("_q", F.explode(hit)).select(*rows.columns, *[F.col(f"_q.{c}") for c in names[:4]])


def bm25(index: TextIndex, wanted: DataFrame) -> DataFrame:
    """``query_id, chunk_id, bm25``: positive scores summed over a query's phrases."""
    return _scored(index, occurrences(index, wanted))


def _scored(index: TextIndex, f: DataFrame) -> DataFrame:
    corpus = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = f.groupBy("query_id", "phrase").agg(F.count(F.lit(1)).alias("n_hit"))
    idf = F.log((F.col("n_docs") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5))
    df = df.crossJoin(F.broadcast(corpus)).select("query_id", "phrase", "avgdl", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))
    rows = f.join(F.broadcast(df), ["query_id", "phrase"])
    score = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    block = [c for c in f.columns if c == "block"]
    return rows.groupBy("query_id", *block, "chunk_id").agg(F.sum(score).alias("bm25")).drop("block")


def search_lexical(index: TextIndex, queries: DataFrame, k: int = 10, query: str = "query") -> DataFrame:
    """``query_id, chunk_id, score, rank`` (from 1) of the best k of each query."""
    scored = bm25(index, phrases(queries, query)).select("query_id", "chunk_id", (F.col("bm25") / 100).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_one(index: TextIndex, text: str, k: int | None = 10) -> DataFrame:
    """One query: ``chunk_id, score``, a plain top-k; without k all that score, in no order.  Its tokens filter the postings where they are scanned."""
    spark = index.lengths.sparkSession
    asked = phrases(spark.createDataFrame([(0, text)], "query_id int, query string")).collect()  # 20 terms at most
    if not asked:
        return index.lengths.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    scored = _scored(index, _counted(_met(index.postings, asked))).select("chunk_id", (F.col("bm25") / 100).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def search_top(index: TextIndex, text: str, k: int = 10, *, first: int = 4) -> DataFrame:
    """The rows of :func:`search_one` with an early end, ``chunk_id, score``.

    1. Phrases of one token are counted exactly from the blocks' marks, without postings; those of several tokens need
       positions, so theirs are read.
    2. A block's score is at most what its largest counts would give its shortest chunk.  The ``first`` blocks by that bound are
       scored; the k-th score so far is a floor.
    3. Blocks whose bound is under the floor hold nothing of the best k: postings of the others are read, once.
    Bounds are summed by block in the tasks, and only the floor and the first blocks' numbers reach the driver."""
    spark = index.lengths.sparkSession
    asked = phrases(spark.createDataFrame([(0, text)], "query_id int, query string")).collect()  # 20 terms at most
    if not asked:
        return index.lengths.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    short, longer = [r for r in asked if r.m == 1], [r for r in asked if r.m > 1]
    corpus = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    marks = F.array(*[F.bit_or(F.col("marks")[w]) for w in range(SPAN // 64)])
    parts = []
    if short:
        seen = _met(index.blocks, short).groupBy("phrase", "block").agg(F.sum("most").alias("most"), F.min("least").alias("least"), marks.alias("marks"))
        parts.append(seen.select("phrase", "block", "most", "least", F.aggregate("marks", F.lit(0), lambda n, w: n + F.bit_count(w)).cast("long").alias("n")))
    exact = _counted(_met(index.postings, longer)) if longer else None
    if longer:
        parts.append(exact.groupBy("phrase", "block").agg(F.max("f").alias("most"), F.min("dl").alias("least"), F.count(F.lit(1)).alias("n")))
    blocks = reduce(DataFrame.unionByName, parts)

    df = blocks.groupBy("phrase").agg(F.sum("n").alias("n_hit")).crossJoin(F.broadcast(corpus))
    ratio = F.log((F.col("n_docs") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5))
    idf = df.select("phrase", "avgdl", F.when(ratio <= 0, 1e-6).otherwise(ratio).alias("idf")).collect()  # a row for each phrase
    if not idf:
        return index.lengths.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
    weights = F.broadcast(spark.createDataFrame([tuple(r) for r in idf], "phrase int, avgdl double, idf double"))
    part = lambda f, dl: F.col("idf") * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col(dl) / F.col("avgdl"))) / 100
    bound = blocks.join(weights, "phrase").groupBy("block").agg((F.sum(part("most", "least")) * (1 + 1e-9)).alias("bound"))

    def scored(kept: Column | DataFrame) -> DataFrame:
        """Exact scores in some blocks: a condition on ``block``, or a table of blocks."""
        some = (lambda df: df.filter(kept)) if isinstance(kept, Column) else (lambda df: df.join(kept, "block", "left_semi"))
        counts = []
        if short:
            counts.append(_met(some(index.postings), short).groupBy("phrase", "block", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("f")))
        if longer:
            counts.append(some(exact).select("phrase", "block", "chunk_id", "dl", "f"))
        f = reduce(DataFrame.unionByName, counts)
        return f.join(weights, "phrase").groupBy("block", "chunk_id").agg(F.sum(part("f", "dl")).alias("score")).drop("block")

    best = [r.block for r in bound.orderBy(F.desc("bound"), "block").limit(max(first, -(-k // SPAN))).collect()]
    floor = scored(F.col("block").isin(best)).orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("m"), F.count(F.lit(1)).alias("n")).first()
    rows = scored(bound.filter(F.col("bound") >= (floor.m if floor.n == k else 0.0)).select("block"))
    return rows.orderBy(F.desc("score"), "chunk_id").limit(k)


def prefix_counts(index: TextIndex, prefixes: list[str]) -> DataFrame:
    """``token, term, n_chunks``: the terms that start with each of some prefixes and how many chunks hold them, from the blocks' marks.
    Prefixes are literals, so only counts by term are shuffled."""
    met = F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.col("term").startswith(p))
    held = F.aggregate("marks", F.lit(0), lambda n, w: n + F.bit_count(w)).cast("long")
    near = reduce(Column.__or__, [F.col("term").startswith(p) for p in prefixes])
    rows = index.blocks.filter(near).select("term", held.alias("n"), F.explode(met).alias("token"))
    return rows.groupBy("token", "term").agg(F.sum("n").alias("n_chunks"))


def memory_like(rows: DataFrame, text: str, columns: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows of which any column is like %text% whatever its case, ``%`` and ``_`` acting as wildcards."""
    pattern = f"%{text}%"
    hit = None
    for c in columns:
        x = F.col(c).ilike(pattern)
        hit = x if hit is None else hit | x
    return rows.filter(hit).orderBy(*order).limit(k).withColumn("score", F.lit(1.0))
