"""An index of a project: ingest, search, research, upkeep and memory behind one object.

Tables live under ``root``: chunks, manifest, postings, lengths, terms, entities and vectors as segments, so that a change
writes in proportion to itself; decisions, timeline and changelogs as versioned snapshots; settings are one JSON file.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions import config, embed, text
from .operators import graph, lexical, maintain, memory, retrieve
from .operators.segments import Segments
from .sources import code, files, history
from .streaming import watch

CHUNKS = (
    "chunk_id long, uri string, symbol string, chunk_type string, file_path string, start_line int, end_line int, language string, code string, "
    "metadata map<string,string>, tier string, created_at timestamp_ntz"
)
MANIFEST = "file_path string, hash string, mtime double, size long, valid_chunks array<string>, stale_chunks array<string>"
VECTORS = "chunk_id long, embedding array<float>"
WATCHED = "root string, file_path string, change string, ts timestamp"
#: Segmented tables: schema, key of what a change replaces, order within a segment.
SEGMENTED = {
    "chunks": (CHUNKS, "chunk_id", ()), "manifest": (MANIFEST, "file_path", ()), "vectors": (VECTORS, "chunk_id", ()), "entities": (code.ENTITIES, "chunk_id", ()),
    "postings": ("term string, chunk_id long, field string, pos int, dl int", "chunk_id", ("term", "chunk_id")), "lengths": ("chunk_id long, dl int", "chunk_id", ()),
    "terms": ("term string, head string", "term", ("term",)),
}
SEARCHED = ("chunks", "manifest", "postings", "lengths", "terms", "vectors")  # what a search reads
CACHED = 500  # searches whose results are kept
MEMORY = {"decisions": memory.DECISIONS, "timeline": memory.TIMELINE, "changelogs": memory.CHANGELOGS}


class Project:
    def __init__(self, spark: SparkSession, root: str, dimensions: int = 64):
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions
        self._found: OrderedDict[str, tuple[tuple, list, object]] = OrderedDict()  # by digest of the search: versions, rows, schema

    # ------------------------------------------------------------ tables
    def segments(self, name: str) -> Segments:
        return Segments(self.spark, f"{self.root}/{name}", *SEGMENTED[name])

    def table(self, name: str) -> DataFrame:
        return self.segments(name).read() if name in SEGMENTED else memory.load_snapshot(self.spark, f"{self.root}/{name}", MEMORY[name])

    def _save(self, name: str, df: DataFrame) -> None:
        """The whole table anew."""
        if name in SEGMENTED:
            self.segments(name).replace(df)
            return
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{name}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{self.root}/{name}/v*"))
        last = max((int(s.getPath().getName()[1:]) for s in found or []), default=0)
        memory.save_snapshot(df, f"{self.root}/{name}", last + 1)

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written below the root and read again, so that later steps see the same rows and recompute nothing."""
        path = f"{self.root}/staging/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    # ---------------------------------------------------------- settings
    def settings(self) -> dict:
        """All settings: the defaults with the project's own over them."""
        return config.merged(self._own_settings())

    def _own_settings(self) -> dict:
        rows = self.spark.read.text(f"{self.root}/config", wholetext=True).collect() if self._exists("config/_SUCCESS") else []
        return json.loads(rows[0].value) if rows else {}

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def get(self, name: str) -> object:
        section, _, key = name.partition(".")
        return self.settings()[section][key]

    def set(self, name: str, value: str) -> object:
        """Set ``section.name`` to a value given as text; an unknown name or another kind is an error."""
        own = config.changed(self._own_settings(), name, config.parse(value))
        self.spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/config")
        return self.get(name)

    # ------------------------------------------------------------ ingest
    def index(self, source: str, *, patterns: list[str] = (), tier: str = "project", repo: str | None = None) -> DataFrame:
        """Index what is new or changed under ``source``; returns ``file_path, change`` (readable until the next call).

        Files are listed without their contents; contents are then read, by the tasks, only for files whose
        time or size differ from the manifest's.  The other tables follow from the next chunks by anti-joins
        on chunk ids.  What is left out: the default patterns, the project's, ``patterns`` and ignore files."""
        self._delete(f"{self.root}/staging")
        left_out = files.patterns_of([*self.get("indexing.exclude_patterns"), *patterns], files.ignore_files(self.spark, source))
        listing = self._stage("listing", files.list_files(self.spark, source, patterns=left_out, max_mb=self.get("indexing.max_file_size_mb")))
        known = self.table("manifest")
        old = known.select("file_path", F.col("mtime").alias("_t"), F.col("size").alias("_s"))
        fresh = listing.join(old, "file_path", "left").filter(~(F.col("_t").eqNullSafe(F.col("mtime")) & F.col("_s").eqNullSafe(F.col("size")))).drop("_t", "_s")
        fresh = files.with_content(fresh).filter("content is not null")
        fresh = self._stage("fresh", fresh.withColumn("text", files.text_of(F.col("content"))).withColumn("hash", maintain.content_hash(F.col("content"))).drop("content"))
        change = maintain.changed_files(known, listing.join(fresh.select("file_path", "hash"), "file_path", "left").join(known.select("file_path", F.col("hash").alias("_h")), "file_path", "left").withColumn("hash", F.coalesce("hash", "_h")).drop("_h"))
        change = self._stage("change", change)
        todo = fresh.join(change.filter("change in ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        sizes = self.settings()["chunking"]
        made = code.chunk_files(todo.select("file_path", "language", "text"), most=sizes["max_chunk_size"], part=sizes["merge_threshold"], merge=sizes["greedy_merge"])
        note = F.create_map(F.lit("tier"), F.lit(tier))
        if repo:
            head = history.commits(self.spark, repo, "HEAD", 1).first()
            if head:
                note = F.map_concat(note, F.create_map(F.lit("commit_hash"), F.lit(head["hash"]), F.lit("commit_time"), F.lit(str(head["time"]))))
        made = made.select(F.lit(None).cast("long").alias("chunk_id"), "uri", "symbol", "chunk_type", "file_path", "start_line", "end_line", "language", "code", note.alias("metadata"), F.lit(tier).alias("tier"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
        made = self._stage("made", made)
        # chunks of the same places keep their ids; only rows of changed files are written
        every = self.table("chunks")
        same = every.join(made.select("uri"), "uri", "left_semi").select(*every.columns)
        rows = self._stage("chunks", maintain.upsert(same, made, ids=every))
        touched = change.filter("change in ('new', 'changed', 'deleted')").select("file_path")
        before = known.join(touched, "file_path", "left_semi").select(F.explode("valid_chunks").alias("uri"))
        left = self._stage("left", every.join(before, "uri", "left_semi").select("chunk_id"))
        self.segments("chunks").add(rows, gone=self._stage("same", same.select("chunk_id")))
        lists = rows.groupBy("file_path").agg(F.collect_list("uri").alias("valid_chunks"))
        entries = todo.select("file_path", "hash", "mtime", "size").join(lists, "file_path", "left").withColumn("valid_chunks", F.coalesce("valid_chunks", F.array().cast("array<string>")))
        moved = listing.join(known.select("file_path", "hash", "valid_chunks"), "file_path").join(change.filter("change = 'same'").select("file_path"), "file_path")
        moved = moved.join(fresh.select("file_path"), "file_path", "left_semi").select(*entries.columns)  # another time or size, the same text
        entries = self._stage("entries", maintain.update_manifest(known.join(touched, "file_path", "left_semi"), entries).join(listing.select("file_path"), "file_path", "left_semi"))
        moved = self._stage("moved", maintain.update_manifest(known.join(moved.select("file_path"), "file_path", "left_semi"), moved))
        self.segments("manifest").add(entries.unionByName(moved), gone=touched.unionAll(moved.select("file_path")))
        self._derive(rows.select("chunk_id"), left)
        return change

    def _derive(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Postings, lengths, entities and vectors: those of ``changed`` chunks, as far as they are valid, anew; those of ``gone`` chunks
        no more; others stay where they are."""
        gone = changed if gone is None else changed.unionAll(gone)
        new = self._stage("new", retrieve.valid_only(self.table("chunks").join(changed, "chunk_id", "left_semi"), self.table("manifest")))
        index = lexical.build_index(new)
        self.segments("postings").add(index.postings, gone)
        terms = lexical.dictionary(index.postings)
        self.segments("terms").add(terms.join(self.table("terms").select("term"), "term", "left_anti").select(*terms.columns))
        self.segments("lengths").add(index.lengths, gone)
        self.segments("entities").add(code.entities(new.select("chunk_id", "language", "start_line", "code")), gone)
        vector = embed.hashed(embed.chunk_text(F.col("symbol"), F.col("code")), self.dimensions)
        self.segments("vectors").add(new.select("chunk_id", vector.alias("embedding")), gone)

    def chunks(self, no_filter: bool = False) -> DataFrame:
        every = self.table("chunks")
        return every if no_filter else retrieve.valid_only(every, self.table("manifest"))

    def compact(self, threshold: float = 0.2) -> bool:
        done = maintain.compact(self.table("chunks"), self.table("manifest"), threshold=threshold)
        if done:
            self._save("chunks", done[0])
            self._save("manifest", done[1])
        return done is not None

    def status(self) -> DataFrame:
        """One row: chunks, files, last update and its age in hours, bytes indexed, valid and stale chunks, health and advice."""
        rows = maintain.index_stats(self.table("chunks")).crossJoin(maintain.staleness(self.table("manifest")))
        rows = rows.crossJoin(maintain.cache_stats(self.table("manifest")).select("n_bytes"))
        age = F.timestamp_diff("HOUR", F.col("last_update"), F.current_timestamp().cast("timestamp_ntz"))
        return rows.withColumns({"age_hours": age, "advice": maintain.advice(F.col("ratio"))})

    def watch(self, events: str, source: str, *, checkpoint: str, quiet: str = "2 seconds", trigger: str = "2 seconds", report: Callable[[dict[str, int]], None] = lambda counts: None, **options) -> StreamingQuery:
        """Index ``source`` again whenever its event files (JSON lines of WATCHED in the folder ``events``) have been quiet for a
        while.  Files that are gone leave the manifest with the rest; a batch without events does nothing.  ``report`` gets the
        number of files by change after each turn."""

        def reindex(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                report({r.change: r["count"] for r in self.index(source, **options).groupBy("change").count().collect()})

        return watch.watch(self.spark, events, WATCHED, reindex, checkpoint=checkpoint, quiet=quiet, trigger=trigger)

    # ------------------------------------------------------------ search
    def _index(self) -> lexical.TextIndex:
        return lexical.TextIndex(self.table("postings"), self.table("lengths"), self.table("terms"))

    def _vector(self, query: str) -> list[float]:
        return self.spark.range(1).select(embed.hashed(F.lit(query), self.dimensions).alias("v")).first().v

    def _weigh(self, hits: DataFrame, k: int, include_deps: bool, boosts: dict[str, float] | None, strict: bool, where: Column | None) -> DataFrame:
        if strict:  # any number of hits: joined as they are, filtered and weighed before the cut
            rows = self.table("chunks").join(hits, "chunk_id")
            rows = rows if where is None else rows.filter(where)
            return retrieve.weigh_tiers(rows.select("chunk_id", "tier", "score"), k, include_deps=include_deps, boosts=boosts)
        tiers = self.table("chunks").select("chunk_id", "tier")
        return retrieve.weigh_tiers(tiers.join(F.broadcast(hits), "chunk_id"), k, include_deps=include_deps, boosts=boosts)

    def search(self, query: str, k: int = 10, *, mode: str = "hybrid", vector_weight: float = 0.7, include_deps: bool = True, boosts: dict[str, float] | None = None, strict: bool = False, where: Column | None = None) -> DataFrame:
        """Best chunks with their rows, by ``hybrid``, ``lexical`` or ``semantic`` search.  Legs are cut to k
        before tiers are weighed and ``where`` filters the results' chunks; with ``strict`` all that score are
        filtered (``score`` being the leg's) and weighed first."""
        legs = {
            "lexical": lambda n: self._weigh(lexical.search_one(self._index(), query, None if strict else n), n, include_deps, boosts, strict, where),
            "semantic": lambda n: self._weigh(retrieve.search_semantic(self.table("vectors"), self._vector(query), None if strict else n), n, include_deps, boosts, strict, where),
        }
        hits = retrieve.fuse(legs["semantic"](3 * k), legs["lexical"](3 * k), k, vector_weight) if mode == "hybrid" else legs[mode](k)
        rows = retrieve.with_chunks(hits.select("chunk_id", "score"), self.table("chunks"))
        return rows if where is None or strict else rows.filter(where)

    def versions(self) -> tuple[int, ...]:
        """The last commits of the tables that a search reads."""
        return tuple((self.segments(t).versions() or [0])[-1] for t in SEARCHED)

    def search_cached(self, query: str, k: int = 10, **options) -> DataFrame:
        """:func:`search`, whose k rows are kept for the next one that asks the same.  A result is void once any table has another
        version; of more than CACHED the one used longest ago goes.  A hit runs no job.  Conditions (``where``) are told apart by their text."""
        asked = json.dumps([query, k, sorted((n, str(v)) for n, v in options.items())])
        key, now = hashlib.sha256(asked.encode()).hexdigest(), self.versions()
        known = self._found.pop(key, None)
        if known is None or known[0] != now:
            found = self.search(query, k, **options)
            known = (now, found.collect(), found.schema)  # k rows
        self._found[key] = known
        while len(self._found) > CACHED:
            self._found.popitem(last=False)
        return self.spark.createDataFrame(known[1], known[2])

    def search_files(self, query: str, k: int = 10, how: str = "sum") -> DataFrame:
        return retrieve.by_file(self.search(query, 5 * k), k, how)

    def search_memory(self, words: str, k: int = 10, *, decisions_only: bool = True) -> DataFrame:
        """Memory rows that hold ``words``, newest first: decisions, or events and changelogs too."""
        tables = [self.table(t) for t in ("decisions", "timeline", "changelogs")]
        return memory.search(tables[0], *[t.limit(0) if decisions_only else t for t in tables[1:]], words, k)

    def search_all(self, query: str, k: int = 10, **options) -> DataFrame:
        """Code and memory in one list: ``kind, ref, title, body, score, rank``.  The k rows of :func:`search` in their order, and after them
        up to k memory rows that hold the words, newest first and without a score: neither kind takes the other's places."""
        code = self.search(query, k, **options).select(F.lit("code").alias("kind"), F.col("uri").alias("ref"), F.col("symbol").alias("title"), F.col("code").alias("body"), "score", F.lit(None).cast("timestamp_ntz").alias("at"))
        known = self.search_memory(query, k, decisions_only=False).select("kind", "ref", "title", "body", F.lit(None).cast("double").alias("score"), F.col("created_at").alias("at"))
        order = [F.desc_nulls_last("score"), F.desc("at"), "kind", "ref"]
        rows = code.unionByName(known).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # 2 k rows
        return rows.drop("at").orderBy("rank")

    def research(self, question: str, hops: int = 2, per_hop: int = 5, most: int = 50) -> tuple[DataFrame, DataFrame]:
        words = self.spark.range(1).select(text.keywords(F.lit(question)).alias("w")).first().w or question
        start = lexical.search_one(self._index(), words, per_hop)
        return graph.research(self.spark, self._index(), self.table("chunks"), self.table("entities"), start, hops=hops, per_hop=per_hop, most=most)

    # ------------------------------------------------------------ memory
    def add_decision(self, title: str, description: str, session_id: str = "cli", reasoning: str | None = None) -> int:
        rows = self.table("decisions")
        new_id = (rows.agg(F.max("id")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(new_id, session_id, title, description, reasoning, "pending")], "id long, session_id string, title string, description string, reasoning string, status string")
        row = row.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
        self._save("decisions", memory.add_decisions(rows, row))
        return new_id

    def decide(self, decision: int, category: str | None) -> None:
        """Approve a pending decision under a category, or reject it with None."""
        rows = self.table("decisions")
        if category is not None and rows.filter((F.col("id") == decision) & (F.col("status") == "pending")).isEmpty():
            raise ValueError(f"no pending decision {decision}")
        now = F.current_timestamp().cast("timestamp_ntz")
        self._save("decisions", memory.reject(rows, [decision]) if category is None else memory.approve(rows, [decision], category, now))

    def add_event(self, event_type: str, from_ref: str, to_ref: str, summary: str, *, files_changed: list[str] = (), importance: str = "medium", commit_hash: str | None = None) -> int:
        """Add a timeline event; its id."""
        if importance not in ("high", "medium", "low"):
            raise ValueError(f"no importance {importance}")
        row = [(event_type, from_ref, to_ref, summary, list(files_changed), importance, commit_hash)]
        new = self.spark.createDataFrame(row, "event_type string, from_ref string, to_ref string, summary string, files_changed array<string>, importance string, commit_hash string")
        return self._add("timeline", new)

    def add_changelog(self, tag: str, summary: str = "", *, breaking: list[str] = (), features: list[str] = (), fixes: list[str] = (), commit_hash: str | None = None) -> int:
        """Add a changelog; its id.  A tag that is there already is an error."""
        rows = self.table("changelogs")
        row = [(tag, summary, list(breaking), list(features), list(fixes), commit_hash)]
        new = self.spark.createDataFrame(row, "tag string, summary string, breaking_changes array<string>, features array<string>, fixes array<string>, commit_hash string")
        if not memory.duplicate_tags(rows, new).isEmpty():
            raise ValueError(f"changelog {tag} exists")
        new = new.withColumns({"version": text.version(F.col("tag")), "date": F.current_timestamp().cast("timestamp_ntz")})
        return self._add("changelogs", new)

    def _add(self, name: str, new: DataFrame) -> int:
        """``new`` rows added with ids and the time; the largest id."""
        rows = self.table(name)
        new = new.withColumns({"id": F.lit(None).cast("long"), "created_at": F.current_timestamp().cast("timestamp_ntz")})
        self._save(name, memory.numbered(rows, new))
        return self.table(name).agg(F.max("id")).first()[0]

    def import_memory(self, path: str) -> dict[str, int]:
        """Add what an exported document has and the project has not: events by their refs, changelogs by tag, decisions by title
        (approved).  Counts of rows added and skipped; rows that are there already stay as they are."""
        found, counts = memory.read_export(self.spark, path), {"added": 0, "skipped": 0}
        now = F.current_timestamp().cast("timestamp_ntz")
        for name, keys in (("timeline", ["from_ref", "to_ref"]), ("changelogs", ["tag"]), ("decisions", ["title"])):
            rows, new = self.table(name), found[name]
            if name == "decisions":
                new = new.withColumns({"session_id": F.lit("imported"), "status": F.lit("approved"), "category": F.coalesce("category", F.lit("imported")), "approved_at": F.coalesce("approved_at", now)})
            new = new.withColumn("created_at", F.coalesce("created_at", now))
            if name == "changelogs":
                new = new.withColumn("date", F.coalesce("date", now))
            fresh = self._stage(f"import-{name}", memory.import_rows(rows.limit(0), new, keys).join(rows.select(*keys).distinct(), keys, "left_anti"))
            n, m = new.count(), fresh.count()
            counts["added"] += m
            counts["skipped"] += n - m
            if m:
                self._save(name, memory.numbered(rows, fresh))
        return counts

    def sync_history(self, repo: str, *, since: str | None = None, limit: int = 50, least: str = "low", dry_run: bool = False, tags: bool = True, merges: bool = True) -> dict[str, int]:
        """Tags to changelogs and merges to the timeline (or one of them), new ones only; counts of what was added and skipped."""
        counts = {}
        sources = []
        if tags:
            sources.append(("changelogs", history.tags(self.spark, repo), ["tag"], [F.desc("date"), F.col("tag")]))
        if merges:
            sources.append(("timeline", history.merges(self.spark, repo, since, limit), ["event_type", "from_ref", "to_ref"], [F.desc("commit_time"), F.col("commit_hash")]))
        for name, found, keys, order in sources:
            rows = self.table(name)
            judged = memory.sync(rows, found, keys, least=least if name == "timeline" else None, limit=limit, order=order)
            counts |= {f"{name}_{r.outcome}": r["count"] for r in judged.groupBy("outcome").count().collect()}
            added = judged.filter("outcome = 'added'").drop("outcome")
            if not dry_run:
                added = added.withColumns({"id": F.lit(None).cast("long"), "created_at": F.current_timestamp().cast("timestamp_ntz")})
                self._save(name, memory.numbered(rows, added))
        return counts

    def context(self, query: str) -> str:
        tables = (self.table(t) for t in ("decisions", "timeline", "changelogs"))
        return memory.context(*tables, self.search(query, 5)).first().json

    def export(self, path: str, pending: bool = False) -> None:
        memory.export_memory(*(self.table(t) for t in ("decisions", "timeline", "changelogs")), pending=pending).write.mode("overwrite").text(path)
