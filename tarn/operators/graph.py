"""Relationships between chunks: bounded multi-hop search, call graphs, entry points, links of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lexical import TextIndex, search_lexical


def call_graph(edges: DataFrame) -> DataFrame:
    """``from_entity`` and its targets in order of discovery (``seq``)."""
    return edges.groupBy("from_entity").agg(F.array_sort(F.collect_list(F.struct("seq", "to_entity", "relationship_type"))).alias("targets"))


def entry_points(edges: DataFrame) -> DataFrame:
    """Entities that nothing points to."""
    every = edges.select(F.col("from_entity").alias("entity")).union(edges.select("to_entity")).distinct()
    return every.join(edges.select(F.col("to_entity").alias("entity")).distinct(), "entity", "left_anti")


def reachable(edges: DataFrame, start: list[str], hops: int) -> DataFrame:
    """``entity, hop``: entities within ``hops`` steps of those at the start, each at its first hop.  One join of the
    newest entities with the edges for each hop."""
    seen = edges.sparkSession.createDataFrame([(e, 0) for e in dict.fromkeys(start)], "entity string, hop int")
    new = seen
    for hop in range(1, hops + 1):
        step = edges.join(new.select(F.col("entity").alias("from_entity")), "from_entity").select(F.col("to_entity").alias("entity")).distinct()
        new = step.join(seen, "entity", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(new)
    return seen


def _first_names(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities of found chunks (``chunk_id, at``), each name once, in order of discovery."""
    rows = entities.join(found, "chunk_id")
    first = Window.partitionBy("name").orderBy("at", "seq")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("name", "entity_type", "chunk_id", "at", "seq")


def research(
    spark: SparkSession, index: TextIndex, chunks: DataFrame, entities: DataFrame, start: DataFrame, *, hops: int = 2, per_hop: int = 5, most: int = 50, per_entity: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from ``start`` (``chunk_id, score``): found chunks (``chunk_id, at, hop``) and edges.

    A hop takes the first ``per_hop`` new entities in order of discovery and searches them all in one batched
    job; results count in order of entity and rank, a chunk at its first place, and entities that come
    after ``most`` chunks are not searched.  All tables here are bounded by ``most``, ``per_hop`` and ``per_entity``,
    so one hop's new rows are small and are the only rows that reach the driver."""
    first = [r.chunk_id for r in start.orderBy(F.desc("score"), "chunk_id").collect()]
    found = {c: (i, 0) for i, c in enumerate(first)}
    edges: list[tuple] = []
    seen: set[str] = set()
    frontier, new = [], list(first)
    for hop in range(1, hops + 1):
        at = spark.createDataFrame([(c, found[c][0]) for c in new], "chunk_id long, at int")
        names = _first_names(entities, F.broadcast(at)).orderBy("at", "seq").collect() if new else []
        frontier = [r for r in names if r.name not in seen]
        seen |= {r.name for r in frontier}
        frontier, new = frontier[:per_hop], []
        if not frontier or len(found) >= most:
            break
        queries = spark.createDataFrame([(i, r.name) for i, r in enumerate(frontier)], "query_id int, query string")
        hits: dict[int, list[int]] = {}
        for r in search_lexical(index, queries, per_entity).orderBy("query_id", "rank").collect():
            hits.setdefault(r.query_id, []).append(r.chunk_id)
        for i, r in enumerate(frontier):
            if len(found) >= most:
                break
            for c in hits.get(i, []):
                if c not in found:
                    found[c] = (len(found), hop)
                    new.append(c)
                    edges.append((len(edges), r.chunk_id, c, r.name, r.entity_type, hop))
    rows = spark.createDataFrame([(c, a, h) for c, (a, h) in found.items()], "chunk_id long, at int, hop int")
    links = spark.createDataFrame(edges, "seq int, from_chunk long, to_chunk long, entity string, relationship_type string, hop int")
    name = lambda side: F.broadcast(chunks.select(F.col("chunk_id").alias(f"{side}_chunk"), F.col("symbol").alias(f"{side}_entity")).join(F.broadcast(links.select(f"{side}_chunk").distinct()), f"{side}_chunk"))
    return rows, links.join(name("from"), "from_chunk").join(name("to"), "to_chunk")


def document_links(docs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of documentation files: to files in the same directory (0.9; a readme also to those one level
    below), to files that define a symbol it names (0.6), to files its path mirrors (0.7).

    ``docs``: ``doc_path, symbols``; ``files``: ``file_path``; ``symbols``: ``file_path, symbol``."""
    directory = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    d = docs.withColumn("dir", directory(F.col("doc_path")))
    f = files.select("file_path").distinct().withColumn("dir", directory(F.col("file_path")))
    near = d.join(f, "dir").select("doc_path", "file_path", F.lit("proximity").alias("kind"), F.lit(0.9).alias("confidence"))
    readme = d.filter(F.lower(F.element_at(F.split("doc_path", "/"), -1)) == "readme.md")
    below = readme.join(f.select("file_path", directory(F.col("dir")).alias("dir"), F.col("dir").alias("_own")).filter("_own <> ''"), "dir")
    below = below.select("doc_path", "file_path", F.lit("proximity").alias("kind"), F.lit(0.9).alias("confidence"))
    named = d.select("doc_path", F.explode("symbols").alias("symbol")).join(symbols, "symbol").select("doc_path", "file_path", F.lit("symbol").alias("kind"), F.lit(0.6).alias("confidence"))
    stem = F.regexp_replace(F.regexp_extract("doc_path", r"(?:^|/)docs?/(.*)\.md$", 1), "^/", "")
    mirrored = d.select("doc_path", F.nullif(stem, F.lit("")).alias("stem")).filter("stem is not null").withColumn("last", F.element_at(F.split("stem", "/"), -1))
    named_file = f.select("file_path", F.regexp_extract("file_path", r"([^/]+?)\.[^./]+$", 1).alias("last"), F.regexp_replace("file_path", r"\.[^./]+$", "").alias("bare"))
    mirror = mirrored.join(named_file, "last").filter((F.col("bare") == F.col("stem")) | F.col("bare").endswith(F.concat(F.lit("/"), F.col("stem"))))
    mirror = mirror.select("doc_path", "file_path", F.lit("hierarchy").alias("kind"), F.lit(0.7).alias("confidence"))
    return near.unionByName(below).unionByName(named).unionByName(mirror).distinct()
