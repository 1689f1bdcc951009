"""Queries of sources, retrieval filters, renderings, manifests and memory that the other modules do not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, embed, render, text
from ..operators import evaluate, graph, maintain, memory, retrieve
from ..sources import files
from ..sources.tables import read_spread, read_table
from . import chunks as chunk_plans
from . import project


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: ``file_path`` in a directory of their size, ``rel_path``, ``name``, ``ext``."""
    p = read_table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey", F.lit("."), ext)
    top = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "docs/").when(F.col("p_size") % 5 == 2, "src/build/").otherwise(F.concat(F.lit("src/m"), "p_size", F.lit("/")))
    return p.select("p_partkey", F.concat(top, name).alias("rel_path"), name.alias("name"), ext.alias("ext"), "p_size")


EXTENSIONS = ("py", "log", "md", "js", "txt")
PATTERNS = ["*.log", "build/", "/docs/*.txt", "**/m7/*.js", "!*widget_1?.log"]


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", files.ignored(F.col("rel_path"), PATTERNS).alias("ignored"))


def default_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = F.element_at(F.array(*map(F.lit, ("node_modules", "src", ".git", "__pycache__", "lib", "dist"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(dirs, F.lit("/"), "name")
    return _parts(spark, sf_dir).select("p_partkey", files.ignored(path, files.patterns_of(["*.md"])).alias("ignored"))


def documentation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    named = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("README"), F.when(F.col("p_size") % 2 == 0, ".rst").otherwise(""))).when(F.col("p_partkey") % 10 == 1, "contributing.txt").otherwise(F.col("rel_path"))
    return files.documentation(rows.select(F.concat(F.lit("/r/"), "p_partkey").alias("file_path"), named.alias("rel_path"))).select("file_path", "rel_path")


def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ROOT_FILES)), (F.col("p_partkey") % len(ROOT_FILES) + 1).cast("int"))
    found = files.detect_languages(read_table(spark, sf_dir, "part").select(names.alias("name")).distinct())
    return found.select("language", F.round("confidence", 9).alias("confidence"), F.size("evidence").alias("n_evidence"))


ROOT_FILES = ("setup.py", "tox.ini", "package.json", "yarn.lock", "go.mod", "app.csproj", "Makefile", "notes.txt", "Gemfile")


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents by share, as a profile."""
    d = read_table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("n"))
    shares = d.select("language", F.when(F.col("n") > 100, 0.9).otherwise(0.3).alias("confidence"))
    return files.profile(shares).withColumn("primary_languages", F.array_join("primary_languages", ","))


def parse_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    uri = F.when(k % 4 == 0, F.concat(F.lit("pci://src/a_"), k, F.lit(".py#"), k, F.lit("-"), k + 7)).when(k % 4 == 1, F.concat(F.lit("pci://b_"), k)).when(k % 4 == 2, F.concat(F.lit("file://c#1-"), k)).otherwise("pci://#x")
    return read_table(spark, sf_dir, "part").select("p_partkey", *files.parse_uri(uri))


def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_spread(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    out = files.matching_lines(rows, ["thand", "schein", "que la"], per_file=3, context=1, most=25)
    return out.select("file_path", "n_matches", F.md5(F.array_join(F.transform("snippets", lambda s: F.concat_ws("|", s["line"].cast("string"), s["word"], s["code"])), "\n")).alias("snippets"))


def stub_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    p = read_table(spark, sf_dir, "part")
    name = F.when(k % 4 == 0, F.concat(F.lit("types-"), n, k)).when(k % 4 == 1, F.concat(n, k, F.lit("-stubs"))).otherwise(F.concat(n, k))
    entries = F.when(k % 4 == 2, F.array(F.lit("a.py"), F.lit("py.typed"))).otherwise(F.array(F.lit("a.py")))
    versions = p.filter("p_partkey % 3 = 0").select(F.concat(n, k).alias("package"), F.concat(F.lit("1."), k).alias("version"))
    return files.classify_stubs(p.select(name.alias("name"), entries.alias("entries")), versions)


def script_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    name = F.when(k % 5 == 0, F.concat(F.lit("@types/"), n, k)).otherwise(F.concat(F.lit("@own/"), n, k))
    entries = F.when(k % 5 == 1, F.array(F.lit("index.d.ts"))).when(k % 5 == 2, F.array(F.concat(n, k, F.lit(".d.ts")))).otherwise(F.array(F.lit("index.js")))
    manifest = F.when(k % 5 == 3, F.concat(F.lit('{"typings": "t.d.ts", "version": "2.'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"version": "1.'), k, F.lit('"}')))
    return files.classify_script_packages(read_table(spark, sf_dir, "part").select(name.alias("name"), entries.alias("entries"), manifest.alias("manifest")))


# ------------------------------------------------------------------ retrieval
def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results: a place of source and lines, a score."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("u"), "doc_id").alias("uri"), F.col("source").alias("file_path"), (F.col("n_chars") % 50).cast("int").alias("start_line"), ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("score"))


def one_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.one_per_place(_results(spark, sf_dir), 40).select("chunk_id", "file_path", "start_line", "score")


def valid_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    manifest = read_table(spark, sf_dir, "documents").select(F.when(k % 3 == 0, F.array(F.concat(F.lit("u"), k), F.concat(F.lit("u"), k + 1))).otherwise(F.array().cast("array<string>")).alias("valid_chunks"))
    return retrieve.valid_only(_results(spark, sf_dir), manifest).select("chunk_id", "uri")


def with_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _results(spark, sf_dir).orderBy(F.desc("score"), "chunk_id").limit(15).select("chunk_id", "score")
    return retrieve.with_chunks(top, read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "n_chars")).select("chunk_id", "source", "n_chars", "score")


def lookup_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_key(_results(spark, sf_dir), "u77").select("chunk_id", "file_path", "score")


def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readme files, guides below ``docs`` and files of parts, tied by place, name and path."""
    p = read_table(spark, sf_dir, "part").filter("p_partkey < 400")
    k, m = F.col("p_partkey"), F.col("p_size") % 8
    path = F.concat(F.lit("src/m"), m, F.when(k % 2 == 0, "/inner").otherwise(""), F.lit("/f"), k, F.lit(".py"))
    code = p.select(path.alias("file_path"), F.concat(F.lit("sym_"), k).alias("symbol"))
    readme = p.select(F.concat(F.lit("src/m"), m, F.lit("/README.md")).alias("doc_path"), F.array(F.lit("sym_1")).alias("symbols")).distinct()
    guide = p.filter("p_partkey % 9 = 0").select(F.concat(F.lit("docs/src/m"), m, F.lit("/f"), k, F.lit(".md")).alias("doc_path"), F.array(F.concat(F.lit("sym_"), k + 1)).alias("symbols"))
    return graph.document_links(readme.unionAll(guide), code.select("file_path"), code)


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(project._edges(spark, sf_dir), ["ASIA", "NATION_3"], 3)


# ------------------------------------------------------------------ upkeep
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.duplicate_ids(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id")))


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return maintain.relative_paths(rows.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/"), "rel_path")).otherwise(F.col("rel_path")).alias("file_path")))


def normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("/repo/x/"), "rel_path")).when(k % 4 == 1, F.concat(F.lit("./"), "rel_path")).when(k % 4 == 2, F.replace("rel_path", F.lit("/"), F.lit("\\"))).otherwise(F.col("rel_path"))
    return rows.select("p_partkey", files.repo_relative(path, "/repo/x").alias("path"))


def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("p_size") > 40, "too large").when(F.col("p_partkey") % 7 == 0, "unknown language")
    out = maintain.skipped(_parts(spark, sf_dir).select(F.col("rel_path").alias("file_path"), reason.alias("skip_reason")))
    return out.select("skip_reason", "n_files", F.array_join("examples", ",").alias("examples"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"), F.count(F.when(F.col("event_id") % 1000 == 0, 1)).alias("s"))
    return e.select("event_type", *maintain.throughput(F.col("u"), F.col("n"), F.col("n") * 1000, F.col("s")))


def drop_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chunk_plans._manifest(spark, sf_dir)
    return maintain.drop_deleted(m, m.filter(F.col("file_path").cast("int") % 3 > 0)).select("file_path", "size")


def clear_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.staleness(maintain.clear_stale(chunk_plans._manifest(spark, sf_dir)))


def health_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("p_partkey") % 60 / 100.0
    return read_table(spark, sf_dir, "part").select("p_partkey", maintain.health(ratio).alias("status"), maintain.advice(ratio).alias("advice"))


# --------------------------------------------------------------------- memory
def timeline_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return memory.timeline(project._timeline(spark, sf_dir), from_ref="b2", n=300, event_type="error", since=since).select("id", "from_ref", "created_at")


def decision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project._decisions(spark, sf_dir).withColumn("category", F.when(F.col("id") % 4 == 0, "design"))
    return memory.with_status(rows, "approved", "design").select("id", "title", "created_at")


def approved_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project._decisions(spark, sf_dir).withColumn("reasoning", F.when(F.col("id") % 3 == 0, F.concat(F.lit("because "), "id")))
    return memory.approved_memory(rows).select("decision_id", "title", "content")


def search_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, events and changelogs that hold a text, best kinds first."""
    decisions = project._decisions(spark, sf_dir)
    events = project._timeline(spark, sf_dir).withColumn("summary", F.concat(F.lit("merge of "), "from_ref", F.lit(" "), "id"))
    logs = project._changelogs(spark, sf_dir).select(F.col("tag"), "date", F.concat(F.lit("release "), "tag").alias("summary"))
    return memory.search(decisions, events, logs, "b3 1", 12).select("kind", "ref", "title")


def rejected_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a batch that a changelog has already, or that the batch repeats."""
    logs = project._changelogs(spark, sf_dir)
    return memory.duplicate_tags(logs.filter("tag like '%.1'"), logs.filter("tag like 'v1.%' or tag like 'v2.%'").unionAll(logs.filter("tag like 'v2.3.%'"))).select("tag", "n_rows", "known")


def set_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.set_statistics(_queries(spark, sf_dir))


def query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.select_queries(_queries(spark, sf_dir), "hard", "ECONOMY").select("p_partkey")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = F.when(F.col("p_size") > 30, "hard").when(F.col("p_size") > 15, "medium").otherwise("easy")
    return read_table(spark, sf_dir, "part").select("p_partkey", hard.alias("difficulty"), F.col("p_type").alias("category"), F.sequence(F.lit(1), F.col("p_size") % 4 + 1).alias("relevant_files"))


# ------------------------------------------------------------------ functions
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags' and merges' own summaries against generated ones."""
    k = F.col("p_partkey")
    own = F.when(k % 4 == 0, F.concat(F.lit("Bump version to "), k)).when(k % 4 == 1, F.concat(F.lit("A long account of all that has changed in this version, number "), k)).when(k % 4 == 2, F.concat(F.lit("Release "), k)).otherwise(F.concat(F.lit("Merge branch "), k))
    made = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "").otherwise(F.concat(F.lit("generated "), k))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.changelog_summary(own, made).alias("changelog"), text.timeline_summary(own, made).alias("timeline"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.concat(F.lit("v1."), k, F.lit(".2"))).when(k % 3 == 1, F.concat(F.lit("2."), k, F.lit(".0-rc1"))).otherwise(F.concat(F.lit("build-"), k))
    return read_table(spark, sf_dir, "part").select("p_partkey", text.version(tag).alias("version"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rows are embedded by, and keys of vectors made and parsed."""
    n, k = F.col("p_name"), F.col("p_partkey")
    key = embed.vector_key(F.when(k % 2 == 0, "decision").otherwise("timeline"), k.cast("string"))
    return read_table(spark, sf_dir, "part").select(
        embed.chunk_text(n, F.col("p_type")).alias("chunk"), embed.decision_text(n, F.col("p_type"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "")).alias("decision"),
        embed.event_text(F.col("p_type"), n, F.col("p_brand"), n).alias("event"), embed.changelog_text(n, F.col("p_brand"), F.col("p_type")).alias("log"), key.alias("key"), *embed.parse_vector_key(key),
    )


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.array(*map(F.lit, ("true", "No", "12", "-3.5", "on", "1", "words here", "1e3", "0", "")))
    return read_table(spark, sf_dir, "part").select("p_partkey", *config.typed(F.element_at(words, (k % 10 + 1).cast("int"))))


def decision_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project._decisions(spark, sf_dir)
    body = F.concat(F.lit("first\nsecond line that goes on and on "), F.repeat(F.lit("word "), (F.col("id") % 20).cast("int")))
    return rows.select("id", render.decision_line(F.col("id"), F.col("title"), F.col("status"), body).alias("line"))


def timeline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), "id"))
    return project._timeline(spark, sf_dir).select("id", render.timeline_markdown(F.col("event_type"), F.col("from_ref"), F.col("to_ref"), summary, F.col("created_at")).alias("line"))


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of hashed vectors: one, or none for texts without words."""
    v = embed.hashed(F.when(F.col("item_id") % 5 == 0, "").otherwise(F.col("text")), 64)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.size(v).alias("dimensions"), F.round(length, 4).alias("length"))


def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each path among debounced events: what is to be indexed and what to be dropped."""
    from ..streaming.watch import settled

    e = read_table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("file_path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("change"))
    return settled(e, order=["ts", "event_id"]).select("file_path", "change")


_EXT = "['py', 'log', 'md', 'js', 'txt'][p_partkey % 5 + 1]"
_FILE = f"""f AS (SELECT p_partkey, p_size, {_EXT} AS ext, replace(p_name, ' ', '_') || '_' || p_partkey || '.' || {_EXT} AS name,
    CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'docs/' WHEN 2 THEN 'src/build/' ELSE 'src/m' || p_size || '/' END || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || {_EXT} AS rel_path FROM part)"""
_RESULTS = "r AS (SELECT doc_id AS chunk_id, 'u' || doc_id AS uri, source AS file_path, CAST(n_chars % 50 AS INTEGER) AS start_line, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS score FROM documents)"
_MARKERS = ", ".join(f"('{lang}', '{m}', {files.LEAST_CONFIDENCE.get(m, 0.0)}, {len(ms)})" for lang, ms in files.MARKERS.items() for m in ms)
_HARD = "CASE WHEN p_size > 30 THEN 'hard' WHEN p_size > 15 THEN 'medium' ELSE 'easy' END"
_LINE = "SELECT CAST(doc_id AS VARCHAR) AS file_path, string_split(text, chr(10)) AS ls FROM documents"
_MADE = "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'generated ' || p_partkey END"
_OWN = "CASE p_partkey % 4 WHEN 0 THEN 'Bump version to ' || p_partkey WHEN 1 THEN 'A long account of all that has changed in this version, number ' || p_partkey WHEN 2 THEN 'Release ' || p_partkey ELSE 'Merge branch ' || p_partkey END"

ORACLES = {
    "ignored_files": f"""WITH {_FILE} SELECT p_partkey, CASE WHEN regexp_matches(name, 'widget_1[^/]\\.log$') THEN false WHEN ext = 'js' AND regexp_matches(rel_path, '(^|/)m7/[^/]*\\.js$') THEN true
        WHEN regexp_matches(rel_path, '^docs/[^/]*\\.txt$') THEN true WHEN contains(rel_path, 'build/') OR ext = 'log' THEN true ELSE false END AS ignored FROM f""",
    "default_excludes": f"WITH {_FILE} SELECT p_partkey, p_partkey % 6 IN (0, 2, 3, 5) OR ext = 'md' AS ignored FROM f",
    "documentation_files": f"""WITH {_FILE}, n AS (SELECT '/r/' || p_partkey AS file_path, CASE p_partkey % 10 WHEN 0 THEN 'README' || CASE WHEN p_size % 2 = 0 THEN '.rst' ELSE '' END WHEN 1 THEN 'contributing.txt' ELSE rel_path END AS rel_path FROM f)
        SELECT * FROM n WHERE rel_path LIKE '%.md' OR rel_path LIKE 'README%' OR rel_path LIKE 'contributing%'""",
    "detect_languages": f"""WITH m(language, marker, least, total) AS (VALUES {_MARKERS}), n AS (SELECT DISTINCT [{', '.join(repr(x) for x in ROOT_FILES)}][p_partkey % {len(ROOT_FILES)} + 1] AS name FROM part)
        SELECT language, round(greatest(least(1.0::DOUBLE, count(DISTINCT marker) / total), max(least)::DOUBLE), 9) AS confidence, CAST(least(5, count(DISTINCT name)) AS INTEGER) AS n_evidence FROM n JOIN m ON n.name = m.marker OR (marker LIKE '*%' AND suffix(name, marker[2:])) GROUP BY language, total""",
    "language_profile": """WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (n > 100), '') AS primary_languages, count(*) FILTER (n > 100) > 1 AS multi FROM n)
        SELECT primary_languages, multi, 1.0::DOUBLE AS project, CASE WHEN multi THEN 0.5 ELSE 0.7 END::DOUBLE AS dependency, CASE WHEN multi THEN 0.3 ELSE 0.5 END::DOUBLE AS stdlib, CASE WHEN multi THEN 0.8 ELSE 0.9 END::DOUBLE AS documentation FROM p""",
    "parse_uri": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/a_' || p_partkey || '.py' WHEN 1 THEN 'b_' || p_partkey ELSE 'unknown' END AS file_path,
        CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE 1 END AS INTEGER) AS start_line, CAST(CASE p_partkey % 4 WHEN 0 THEN p_partkey + 7 WHEN 2 THEN p_partkey ELSE 1 END AS INTEGER) AS end_line FROM part""",
    "line_search": f"""WITH l AS ({_LINE}), w(word) AS (VALUES ('thand'), ('schein'), ('que la')),
        h AS (SELECT file_path, ls, word, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l, w),
        t AS (SELECT *, row_number() OVER (PARTITION BY file_path, word ORDER BY i) AS r FROM h WHERE contains(lower(x), word)),
        s AS (SELECT file_path, i || '|' || word || '|' || array_to_string(ls[greatest(i - 1, 1) : i + 1], chr(10)) AS s, i, word FROM t WHERE r <= 3)
        SELECT file_path, count(*) AS n_matches, md5(string_agg(s, chr(10) ORDER BY i, word)) AS snippets FROM s GROUP BY file_path ORDER BY n_matches DESC, file_path LIMIT 25""",
    "stub_packages": """WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') || p_partkey AS n FROM part)
        SELECT CASE k % 4 WHEN 0 THEN 'types-' || n WHEN 1 THEN n || '-stubs' ELSE n END AS name, n AS target, CASE k % 4 WHEN 0 THEN 'prefix' WHEN 1 THEN 'suffix' ELSE 'typed' END AS kind, CASE WHEN k % 3 = 0 THEN '1.' || k END AS version FROM p WHERE k % 4 < 3""",
    "script_packages": """WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || p_partkey AS n FROM part)
        SELECT CASE WHEN k % 5 = 0 THEN '@types/' ELSE '@own/' END || n AS name, CASE k % 5 WHEN 0 THEN 'types' WHEN 1 THEN 'index' WHEN 2 THEN 'named' ELSE 'manifest' END AS kind, CASE WHEN k % 5 = 3 THEN '2.' ELSE '1.' END || k AS version FROM p WHERE k % 5 < 4""",
    "one_per_place": f"WITH {_RESULTS} SELECT chunk_id, file_path, start_line, score FROM (SELECT *, row_number() OVER (PARTITION BY file_path, start_line ORDER BY score DESC, chunk_id) AS n FROM r) WHERE n = 1 ORDER BY score DESC, chunk_id LIMIT 40",
    "valid_only": "SELECT doc_id AS chunk_id, 'u' || doc_id AS uri FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id - 1 IN (SELECT doc_id FROM documents))",
    "with_chunks": f"WITH {_RESULTS} SELECT chunk_id, source, n_chars, score FROM r JOIN documents ON doc_id = chunk_id ORDER BY score DESC, chunk_id LIMIT 15",
    "lookup_uri": f"WITH {_RESULTS} SELECT chunk_id, file_path, score FROM r WHERE uri = 'u77'",
    "document_links": """WITH p AS (SELECT p_partkey AS k, p_size % 8 AS m FROM part WHERE p_partkey < 400), c AS (SELECT 'src/m' || m || CASE WHEN k % 2 = 0 THEN '/inner' ELSE '' END || '/f' || k || '.py' AS file_path, k, m FROM p),
        readme AS (SELECT DISTINCT m, 'src/m' || m || '/README.md' AS doc_path FROM p), guide AS (SELECT k, m, 'docs/src/m' || m || '/f' || k || '.md' AS doc_path FROM p WHERE k % 9 = 0)
        SELECT doc_path, file_path, 'proximity' AS kind, 0.9::DOUBLE AS confidence FROM readme JOIN c USING (m)
        UNION SELECT doc_path, file_path, 'symbol', 0.6 FROM readme, c WHERE c.k = 1
        UNION SELECT doc_path, file_path, 'symbol', 0.6 FROM guide JOIN c ON c.k = guide.k + 1
        UNION SELECT doc_path, file_path, 'hierarchy', 0.7 FROM guide JOIN c ON c.k = guide.k AND c.m = guide.m WHERE c.k % 2 = 1""",
    "reachable": f"""WITH RECURSIVE {project._EDGES}, w AS (SELECT 'ASIA' AS entity, 0 AS hop UNION ALL SELECT 'NATION_3', 0 UNION ALL SELECT b, hop + 1 FROM w JOIN e ON a = entity WHERE hop < 3) SELECT entity, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY entity""",
    "duplicate_ids": "SELECT user_id AS chunk_id, count(*) AS n_rows FROM events GROUP BY user_id HAVING count(*) > 1",
    "relative_paths": f"WITH {_FILE} SELECT rel_path AS file_path FROM f WHERE p_partkey % 3 > 0",
    "normalised_paths": f"WITH {_FILE} SELECT p_partkey, rel_path AS path FROM f",
    "skipped_files": f"""WITH {_FILE}, s AS (SELECT rel_path, CASE WHEN p_size > 40 THEN 'too large' WHEN p_partkey % 7 = 0 THEN 'unknown language' END AS skip_reason FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY skip_reason ORDER BY rel_path) AS n FROM s WHERE skip_reason IS NOT NULL)
        SELECT skip_reason, count(*) AS n_files, string_agg(rel_path, ',' ORDER BY rel_path) FILTER (n <= 3) AS examples FROM r GROUP BY skip_reason""",
    "throughput": """WITH e AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (event_id % 1000 = 0) AS s FROM events GROUP BY event_type)
        SELECT event_type, round(CASE WHEN s > 0 THEN u / s ELSE 0 END, 2) AS files_per_s, round(CASE WHEN s > 0 THEN n / s ELSE 0 END, 2) AS chunks_per_s, round(CASE WHEN s > 0 THEN n * 1000 / 1000000.0::DOUBLE / s ELSE 0 END, 2) AS mb_per_s FROM e""",
    "drop_deleted": "SELECT CAST(doc_id AS VARCHAR) AS file_path, n_chars AS size FROM documents WHERE doc_id % 3 > 0",
    "clear_stale": "SELECT CAST(sum(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 3 END) AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_stale, count(*) AS n_files, CAST(0 AS BIGINT) AS n_files_stale, 0.0::DOUBLE AS ratio, 'healthy' AS status FROM documents",
    "health_advice": """SELECT p_partkey, CASE WHEN p_partkey % 60 < 10 THEN 'healthy' WHEN p_partkey % 60 < 20 THEN 'acceptable' WHEN p_partkey % 60 < 40 THEN 'degraded' ELSE 'critical' END AS status,
        CASE WHEN p_partkey % 60 < 10 THEN 'No action needed' WHEN p_partkey % 60 < 20 THEN 'Compact soon' WHEN p_partkey % 60 < 40 THEN 'Compact now' ELSE 'Rebuild the index' END AS advice FROM part""",
    "timeline_refs": "WITH t AS (SELECT event_id AS id, 'b2' AS from_ref, ts AS created_at, event_type FROM events WHERE user_id % 4 = 2 ORDER BY ts DESC, event_id DESC LIMIT 300) SELECT id, from_ref, created_at FROM t WHERE event_type = 'error' AND created_at >= TIMESTAMP '2024-01-02 00:00:00'",
    "decision_status": "SELECT event_id AS id, 'd' || event_id AS title, ts AS created_at FROM events WHERE event_type = 'purchase' AND event_id % 4 = 0",
    "approved_memory": "SELECT event_id AS decision_id, 'd' || event_id AS title, 'text' || chr(10) || chr(10) || 'Reasoning: ' || CASE WHEN event_id % 3 = 0 THEN 'because ' || event_id ELSE 'N/A' END AS content FROM events WHERE event_type = 'purchase'",
    "search_memory": """WITH u AS (SELECT 'timeline' AS kind, CAST(event_id AS VARCHAR) AS ref, event_type || ': b' || (user_id % 4) || ' → main' AS title, ts, event_id FROM events WHERE contains('merge of b' || (user_id % 4) || ' ' || event_id, 'b3 1')) SELECT kind, ref, title FROM u ORDER BY ts DESC, event_id DESC LIMIT 12""",
    "rejected_tags": f"""WITH t AS (SELECT 'v' || (o_orderkey // 500) || '.' || ((o_orderkey // 10) % 50) || '.' || (o_orderkey % 10) AS tag FROM orders), n AS (SELECT tag FROM t WHERE tag LIKE 'v1.%' OR tag LIKE 'v2.%' UNION ALL SELECT tag FROM t WHERE tag LIKE 'v2.3.%')
        SELECT tag, count(*) AS n_rows, tag IN (SELECT tag FROM t WHERE tag LIKE '%.1') AS known FROM n GROUP BY tag HAVING count(*) > 1 OR known""",
    "set_statistics": f"SELECT {_HARD} AS difficulty, p_type AS category, count(*) AS n_queries, avg(p_size % 4 + 1) AS avg_relevant FROM part GROUP BY 1, 2",
    "query_filter": f"SELECT p_partkey FROM part WHERE {_HARD} = 'hard' AND p_type = 'ECONOMY'",
    "summaries": f"""WITH s AS (SELECT p_partkey, {_OWN} AS own, {_MADE} AS made FROM part) SELECT p_partkey, CASE WHEN coalesce(made, '') = '' OR (length(own) > 50 AND NOT regexp_matches(lower(own), 'bump|release')) THEN own ELSE made END AS changelog,
        CASE WHEN coalesce(made, '') = '' THEN own WHEN contains(lower(own), 'merge') AND length(own) < 100 THEN made ELSE own || ' — ' || made END AS timeline FROM s""",
    "versions": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1.' || p_partkey || '.2' WHEN 1 THEN '2.' || p_partkey || '.0' END AS version FROM part",
    "embedding_texts": """SELECT p_name || chr(10) || chr(10) || p_type AS chunk, p_name || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Reasoning: ' || p_brand ELSE '' END AS decision,
        p_type || ': ' || p_name || ' → ' || p_brand || chr(10) || chr(10) || p_name AS event, p_name || ' (' || p_brand || ')' || chr(10) || chr(10) || p_type AS log,
        CASE WHEN p_partkey % 2 = 0 THEN 'decision:' ELSE 'timeline:' END || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'decision' ELSE 'timeline' END AS kind, p_partkey AS ref_id FROM part""",
    "config_values": """WITH v AS (SELECT p_partkey, p_partkey % 10 AS i FROM part) SELECT p_partkey, CASE WHEN i IN (0, 1, 5, 8) THEN 'boolean' WHEN i = 2 THEN 'integer' WHEN i IN (3, 7) THEN 'float' ELSE 'string' END AS kind,
        CASE WHEN i IN (0, 5) THEN 'true' WHEN i IN (1, 8) THEN 'false' WHEN i = 2 THEN '12' WHEN i = 3 THEN '-3.5' WHEN i = 7 THEN '1000.0' WHEN i = 6 THEN 'words here' WHEN i = 4 THEN 'on' ELSE '' END AS value FROM v""",
    "decision_lines": """SELECT event_id AS id, '#' || event_id || ' [' || CASE WHEN event_type = 'signup' THEN 'pending' ELSE 'approved' END || '] d' || event_id || ': ' || ('first second line that goes on and on ' || repeat('word ', CAST(event_id % 20 AS INTEGER)))[1:80] AS line
        FROM events WHERE event_type IN ('signup', 'purchase')""",
    "timeline_pages": "SELECT event_id AS id, '- **' || strftime(ts, '%Y-%m-%d') || '** ' || event_type || ': b' || (user_id % 4) || ' → main' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '  about ' || event_id ELSE '' END AS line FROM events",
    "hashed_vectors": "SELECT item_id, CAST(64 AS INTEGER) AS dimensions, CASE WHEN item_id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS length FROM benchmark",
    "pending_events": "SELECT CAST(user_id AS VARCHAR) AS file_path, CASE WHEN arg_max(event_type, {'t': ts, 'e': event_id}) = 'error' THEN 'deleted' ELSE 'modified' END AS change FROM events GROUP BY user_id",
}
QUERIES = {f.__name__: f for f in (
    ignored_files, default_excludes, documentation_files, detect_languages, language_profile, parse_uri, line_search, stub_packages, script_packages, one_per_place, valid_only, with_chunks, lookup_uri,
    document_links, reachable, duplicate_ids, relative_paths, normalised_paths, skipped_files, throughput, drop_deleted, clear_stale, health_advice, timeline_refs, decision_status, approved_memory,
    search_memory, rejected_tags, set_statistics, query_filter, summaries, versions, embedding_texts, config_values, decision_lines, timeline_pages, hashed_vectors, pending_events,
)}
