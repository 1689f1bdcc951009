"""Queries of evaluation, project memory, graphs and streams over the business tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render, text
from ..operators import evaluate, graph, memory
from ..sources.tables import read_stream, shared_folder
from ..streaming import pending
from ..streaming.watch import debounced


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of each language's documents, by length and by id; good documents are relevant."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    rank = lambda *o: F.row_number().over(Window.partitionBy("lang").orderBy(*o))
    row = lambda name, r: d.select(F.lit(name).alias("system"), F.col("lang").alias("query_id"), F.col("doc_id").alias("item"), r.alias("rank"))
    run = row("length", rank(F.desc("n_chars"), "doc_id")).unionAll(row("id", rank("doc_id"))).filter("rank <= 20")
    return run, d.filter("quality = 1 and doc_id % 3 = 0").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item"))


def recall_precision_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_runs(spark, sf_dir)).select("system", "query_id", "k", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"), "hit")


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_runs(spark, sf_dir)).select("system", "query_id", "k", F.round("ndcg", 9).alias("ndcg"))


def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_runs(spark, sf_dir), ks=(1,)).select("system", "query_id", F.round("mrr", 9).alias("mrr"))


def compare_systems_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.deltas(evaluate.averages(evaluate.metrics(*_runs(spark, sf_dir))), "id", "precision")
    return out.select("system", "k", *[F.round(c, 9).alias(c) for c in ("value", "base", "delta")])


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.weighted_mean(_table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return out.select("o_orderpriority", F.round("o_totalprice", 6).alias("mean_price"))


def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(_table(spark, sf_dir, "events"), "value", "event_type")


def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    results = d.select(F.col("lang").alias("query_id"), rank.alias("rank"), F.upper("source").alias("symbol"), F.lit("x").alias("file_path"))
    expected = spark.createDataFrame([("en", ["src9", "src17"]), ("de", ["RC16"]), ("fr", ["none"]), ("es", ["src5"])], "query_id string, expected array<string>")
    return evaluate.match_metrics(results, expected, 5).select("query_id", F.round("mrr", 9).alias("mrr"), "hit")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_decisions(_table(spark, sf_dir, "events"))


def _as_decisions(events: DataFrame) -> DataFrame:
    e = events.filter("event_type in ('signup', 'purchase')")
    status = F.when(F.col("event_type") == "signup", "pending").otherwise("approved")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("d"), "event_id").alias("title"), F.lit("text").alias("description"), F.lit(None).cast("string").alias("reasoning"), status.alias("status"), F.lit(None).cast("string").alias("category"), F.col("ts").alias("created_at"), F.col("ts").alias("approved_at"))


def pending_fifo_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.retain_pending(_decisions(spark, sf_dir)).select("id", "status")


def pending_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending rows of :func:`pending_fifo_100`, kept by a query over the stream of decisions."""
    folder = f"{shared_folder(spark)}/tarn-pending-{uuid.uuid4().hex}"
    decisions = _as_decisions(read_stream(spark, sf_dir, "events"))
    query = pending.keep_pending(decisions, f"{folder}/rows", f"{folder}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination()
    return pending.read_pending(spark, f"{folder}/rows", "id long, status string, created_at timestamp_ntz").select("id", "created_at")


def oldest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.oldest_pending(_decisions(spark, sf_dir)).select("id", "created_at")


def approve_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = memory.approve(_decisions(spark, sf_dir), list(range(0, 400, 3)), "design", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = memory.reject(rows, list(range(1, 400, 3)))
    return rows.groupBy("status", "category").agg(F.count(F.lit(1)).alias("n_rows"))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    files, lines = F.floor(F.col("value") % 70), F.floor(F.col("value") * 7 % 1500)
    return e.select(F.col("event_id").alias("id"), F.col("event_type"), F.concat(F.lit("b"), F.col("user_id") % 4).alias("from_ref"), F.lit("main").alias("to_ref"), memory.importance(files, lines).alias("importance"), F.col("ts").alias("created_at"), F.col("ts").alias("commit_time"))


def timeline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.timeline(_timeline(spark, sf_dir), from_ref="b1", to_ref="main", least="medium").select("id", "event_type", "importance", "created_at")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).groupBy("importance").agg(F.count(F.lit(1)).alias("n_events"))


def _changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("v"), F.floor(k / 500), F.lit("."), F.floor(k / 10) % 50, F.lit("."), k % 10).alias("tag"), F.col("o_orderdate").alias("date"))


def changelog_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.changelogs(_changelogs(spark, sf_dir), 100, "v1", "v20")


def changelog_range_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.changelogs(_changelogs(spark, sf_dir), 100, "v2.0.0", "v20.10.0", semver=True)


def sync_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _timeline(spark, sf_dir)
    keys = ["event_type", "from_ref", "to_ref"]
    known = t.filter("id % 2 = 0 and event_type in ('view', 'click')")
    out = memory.sync(known, t.filter("id % 2 = 1"), keys, least="medium", limit=50, order=[F.desc("commit_time"), F.col("id")])
    return out.select("id", "outcome")


def import_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("user_id")).alias("tag"), F.col("event_id").alias("id"), F.struct("ts", "event_id").alias("created_at"))
    mine = e.filter("id % 97 = 0").groupBy("tag").agg(F.min("id").alias("id"), F.min("created_at").alias("created_at"))
    return memory.import_rows(mine, e.filter("id % 2 = 1"), ["tag"]).select("tag", "id")


def import_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("user_id")).alias("tag"), F.col("event_id").alias("id"), F.struct("ts", "event_id").alias("created_at"))
    mine = e.filter("id % 97 = 0").groupBy("tag").agg(F.max("id").alias("id"), F.max("created_at").alias("created_at"))
    return memory.import_rows(mine, e.filter("id % 2 = 1"), ["tag"], newest_wins=True).select("tag", "id")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit messages made of parts' names."""
    p = _table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("feat: ", "fix: ", "Bug: ", "feat(core): ", "BREAKING change ", "!: ", "docs: ", "Add: ")])
    one = F.concat(F.element_at(kinds, (F.col("p_partkey") % 8 + 1).cast("int")), "p_name")
    two = F.concat(F.element_at(kinds, (F.col("p_size") % 8 + 1).cast("int")), "p_brand")
    merge = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Merge branch '"), "p_brand", F.lit("' into 'main'"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Merge pull request #7 from user/"), "p_partkey")).otherwise(F.col("p_name"))
    return p.select("p_partkey", F.concat(one, F.lit("\n"), two).alias("message"), merge.alias("merge"))


def commit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    parts = {"breaking": text.breaking_changes(m), "features": text.feature_lines(m), "fixes": text.fix_lines(m)}
    return _messages(spark, sf_dir).select("p_partkey", *[F.array_join(c, "|").alias(n) for n, c in parts.items()])


def merge_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = text.merge_branches(F.col("merge"))
    return _messages(spark, sf_dir).select("p_partkey", a.alias("from_branch"), b.alias("to_branch"))


def render_changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    at = F.lit("2024-03-05 10:00:00").cast("timestamp_ntz")
    page = render.changelog_markdown(F.concat(F.lit("v"), "p_partkey"), at, F.col("merge"), text.breaking_changes(m), text.feature_lines(m), text.fix_lines(m))
    return _messages(spark, sf_dir).select("p_partkey", page.alias("page"))


def render_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = render.timeline_line(F.col("event_type"), F.col("from_ref"), F.col("to_ref"), F.col("importance"), F.col("created_at"))
    return _timeline(spark, sf_dir).select("id", line.alias("line"))


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("root"), F.col("event_type").alias("file_path"))
    return debounced(e, "30 minutes").select("root", "start", "n_events", F.array_join("paths", ",").alias("paths"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to supplier, and a cycle between two nations."""
    n, r, s = (_table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("from_entity"), F.col("n_name").alias("to_entity"), F.col("n_nationkey").cast("int").alias("seq"))
    b = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("from_entity"), F.col("s_name").alias("to_entity"), (F.col("s_suppkey") + 100).cast("int").alias("seq"))
    return a.unionAll(b).withColumn("relationship_type", F.lit("calls"))


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.call_graph(_edges(spark, sf_dir))
    return out.select("from_entity", F.array_join(F.transform("targets", lambda t: t["to_entity"]), ",").alias("targets"))


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_points(_edges(spark, sf_dir))


def multi_hop_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their distance from one region, each at its first hop."""
    return graph.reachable(_edges(spark, sf_dir), ["ASIA"], 2)


_RUN = """d AS (SELECT * FROM documents JOIN labels USING (doc_id)),
    run AS (SELECT 'length' AS system, lang AS query_id, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM d
            UNION ALL SELECT 'id', lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM d),
    rel AS (SELECT lang AS query_id, doc_id AS item, 1 AS rel FROM d WHERE quality = 1 AND doc_id % 3 = 0),
    size_ AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
    j AS (SELECT system, query_id, item, rank, coalesce(rel, 0) AS rel, coalesce(n_rel, 0) AS n_rel FROM run LEFT JOIN rel USING (query_id, item) LEFT JOIN size_ USING (query_id) WHERE rank <= 20),
    m AS (SELECT system, query_id, k, n_rel, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS n_hit, min(CASE WHEN rel = 1 THEN rank END) AS first,
                 sum(CASE WHEN rank <= k AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM j, (VALUES (1), (5), (10)) AS c(k) GROUP BY system, query_id, k, n_rel)"""
_EDGES = """e AS (SELECT r_name AS a, n_name AS b, n_nationkey AS seq FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name, s_suppkey + 100 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_IMPORTANCE = "CASE WHEN floor(value % 70) > 50 OR floor(value * 7 % 1500) > 1000 THEN 'high' WHEN floor(value % 70) > 10 OR floor(value * 7 % 1500) > 200 THEN 'medium' ELSE 'low' END"
_KINDS = "['feat: ', 'fix: ', 'Bug: ', 'feat(core): ', 'BREAKING change ', '!: ', 'docs: ', 'Add: ']"
_MESSAGES = f"""m AS (SELECT p_partkey, 1 AS i, {_KINDS}[p_partkey % 8 + 1] || p_name AS line FROM part UNION ALL SELECT p_partkey, 2, {_KINDS}[p_size % 8 + 1] || p_brand FROM part)"""
_TAGS = "t AS (SELECT 'v' || (o_orderkey // 500) || '.' || ((o_orderkey // 10) % 50) || '.' || (o_orderkey % 10) AS tag, o_orderdate AS date, o_orderkey AS k FROM orders), l AS (SELECT * FROM t ORDER BY date DESC, tag DESC LIMIT 100)"

ORACLES = {
    "recall_precision_hit": f"WITH {_RUN} SELECT system, query_id, k, round(CASE WHEN n_rel > 0 THEN n_hit / n_rel ELSE 0 END, 9) AS recall, round(n_hit / k, 9) AS precision, n_hit > 0 AS hit FROM m",
    "ndcg": f"""WITH {_RUN} SELECT system, query_id, k, round(CASE WHEN n_rel > 0 THEN dcg / (SELECT sum(1 / log2(g + 1)) FROM generate_series(1, least(n_rel, k)) AS s(g)) ELSE 0 END, 9) AS ndcg FROM m""",
    "mrr": f"WITH {_RUN} SELECT system, query_id, round(coalesce(1 / first, 0), 9) AS mrr FROM m WHERE k = 1",
    "compare_systems_delta": f"""WITH {_RUN}, a AS (SELECT system, k, avg(n_hit / k) AS value FROM m GROUP BY system, k)
        SELECT a.system, a.k, round(a.value, 9) AS value, round(b.value, 9) AS base, round(a.value - b.value, 9) AS delta FROM a JOIN a b ON a.k = b.k AND b.system = 'id'""",
    "weighted_mean": "SELECT o_orderpriority, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 6) AS mean_price FROM orders GROUP BY o_orderpriority",
    "latency_percentile": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY event_type""",
    "match_metrics": """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, source,
            CASE lang WHEN 'en' THEN contains(source, 'src9') OR contains(source, 'src17') WHEN 'de' THEN contains(source, 'rc16') WHEN 'es' THEN contains(source, 'src5') ELSE false END AS ok FROM documents)
        SELECT lang AS query_id, round(coalesce(1 / min(rank) FILTER (ok), 0), 9) AS mrr, coalesce(min(rank) FILTER (ok) <= 5, false) AS hit FROM r GROUP BY lang""",
    "pending_fifo_100": "SELECT event_id AS id, 'approved' AS status FROM events WHERE event_type = 'purchase' UNION ALL (SELECT event_id, 'pending' FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 100)",
    "pending_stream": "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 100",
    "oldest_pending": "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 20",
    "approve_reject": """SELECT CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_id < 400 AND event_id % 3 = 0 THEN 'approved' WHEN event_id < 400 AND event_id % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status,
        CASE WHEN event_type = 'signup' AND event_id < 400 AND event_id % 3 = 0 THEN 'design' END AS category, count(*) AS n_rows FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2""",
    "timeline_filter": f"""WITH t AS (SELECT event_id AS id, event_type, {_IMPORTANCE} AS importance, ts AS created_at FROM events WHERE user_id % 4 = 1 ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT * FROM t WHERE importance <> 'low'""",
    "importance": f"SELECT {_IMPORTANCE} AS importance, count(*) AS n_events FROM events GROUP BY 1",
    "changelog_range": f"WITH {_TAGS} SELECT tag, date FROM l WHERE tag >= 'v1' AND tag <= 'v20'",
    "changelog_range_semver": f"WITH {_TAGS} SELECT tag, date FROM l WHERE (k // 500) * 1000000 + ((k // 10) % 50) * 1000 + k % 10 BETWEEN 2000000 AND 20010000",
    "sync_dedup": f"""WITH t AS (SELECT event_id AS id, event_type, 'b' || (user_id % 4) AS from_ref, {_IMPORTANCE} AS importance, ts FROM events),
        k AS (SELECT DISTINCT event_type, from_ref, 1 AS known FROM t WHERE id % 2 = 0 AND event_type IN ('view', 'click')),
        f AS (SELECT t.*, known IS NULL AND importance <> 'low' AS ok FROM t LEFT JOIN k USING (event_type, from_ref) WHERE id % 2 = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY ts DESC, id) AS r FROM f)
        SELECT id, CASE WHEN NOT ok THEN 'skipped' WHEN r <= 50 THEN 'added' ELSE 'left' END AS outcome FROM r""",
    "import_insert_if_absent": """WITH e AS (SELECT 't' || user_id AS tag, event_id AS id, ts FROM events), mine AS (SELECT tag, min(id) AS id FROM e WHERE id % 97 = 0 GROUP BY tag)
        SELECT tag, id FROM mine UNION ALL SELECT tag, arg_min(id, {'ts': ts, 'id': id}) FROM e WHERE id % 2 = 1 AND tag NOT IN (SELECT tag FROM mine) GROUP BY tag""",
    "import_newest_wins": """WITH e AS (SELECT 't' || user_id AS tag, event_id AS id, ts FROM events), mine AS (SELECT tag, max(id) AS id, max({'ts': ts, 'id': id}) AS c FROM e WHERE id % 97 = 0 GROUP BY tag),
        inc AS (SELECT tag, arg_min(id, {'ts': ts, 'id': id}) AS id, min({'ts': ts, 'id': id}) AS c FROM e WHERE id % 2 = 1 GROUP BY tag), u AS (SELECT *, 0 AS i FROM mine UNION ALL SELECT *, 1 FROM inc)
        SELECT tag, id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY c DESC, i) AS r FROM u) WHERE r = 1""",
    "commit_classify": f"""WITH {_MESSAGES} SELECT p_partkey, coalesce(string_agg(trim(line), '|' ORDER BY i) FILTER (regexp_matches(line, '(?i)breaking|^!:')), '') AS breaking,
        coalesce(string_agg(trim(line), '|' ORDER BY i) FILTER (regexp_matches(line, '(?i)^(feat|feature|add):')), '') AS features, coalesce(string_agg(trim(line), '|' ORDER BY i) FILTER (regexp_matches(line, '(?i)^(fix|bug):')), '') AS fixes FROM m GROUP BY p_partkey""",
    "merge_branches": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'user/' || p_partkey END AS from_branch, CASE WHEN p_size % 3 = 0 THEN 'main' END AS to_branch FROM part",
    "render_changelogs": f"""WITH {_MESSAGES}, x AS (SELECT p_partkey, string_agg('- ' || trim(line), chr(10) ORDER BY i) FILTER (regexp_matches(line, '(?i)breaking|^!:')) AS b,
            string_agg('- ' || trim(line), chr(10) ORDER BY i) FILTER (regexp_matches(line, '(?i)^(feat|feature|add):')) AS f, string_agg('- ' || trim(line), chr(10) ORDER BY i) FILTER (regexp_matches(line, '(?i)^(fix|bug):')) AS x FROM m GROUP BY p_partkey)
        SELECT p_partkey, '## v' || p_partkey || ' (2024-03-05)' || chr(10) || chr(10) || CASE p_size % 3 WHEN 0 THEN 'Merge branch ' || chr(39) || p_brand || chr(39) || ' into ' || chr(39) || 'main' || chr(39) WHEN 1 THEN 'Merge pull request #7 from user/' || p_partkey ELSE p_name END
            || coalesce(chr(10) || chr(10) || '### Breaking Changes' || chr(10) || b, '') || coalesce(chr(10) || chr(10) || '### Features' || chr(10) || f, '') || coalesce(chr(10) || chr(10) || '### Fixes' || chr(10) || x, '') AS page
        FROM part JOIN x USING (p_partkey)""",
    "render_timeline": f"SELECT event_id AS id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || event_type || ': b' || (user_id % 4) || ' → main (' || {_IMPORTANCE} || ')' AS line FROM events",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT user_id AS root, min(ts) AS start, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS paths FROM s GROUP BY user_id, n""",
    "call_graph": f"WITH {_EDGES} SELECT a AS from_entity, string_agg(b, ',' ORDER BY seq) AS targets FROM e GROUP BY a",
    "entry_points": f"WITH {_EDGES} SELECT a AS entity FROM e UNION SELECT b FROM e EXCEPT SELECT b FROM e",
    "multi_hop_frontier": f"WITH {_EDGES} SELECT 'ASIA' AS entity, 0 AS hop UNION ALL SELECT b, 1 FROM e WHERE a = 'ASIA' UNION ALL SELECT DISTINCT e2.b, 2 FROM e e1 JOIN e e2 ON e1.b = e2.a WHERE e1.a = 'ASIA'",
}
QUERIES = {f.__name__: f for f in (
    recall_precision_hit, ndcg, mrr, compare_systems_delta, weighted_mean, latency_percentile, match_metrics, pending_fifo_100, pending_stream, oldest_pending, approve_reject, timeline_filter, importance, changelog_range,
    changelog_range_semver, sync_dedup, import_insert_if_absent, import_newest_wins, commit_classify, merge_branches, render_changelogs, render_timeline, debounce_sessions, call_graph, entry_points, multi_hop_frontier,
)}
