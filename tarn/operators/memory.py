"""Project memory: decisions, timeline events and changelogs as snapshots of tables.

Every change is a function from a table to its next snapshot; ``save_snapshot`` writes it
beside the old one and then moves the pointer, so readers see one or the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PENDING_LIMIT, SPREAD = 100, 64

DECISIONS = (
    "id long, session_id string, title string, description string, reasoning string, alternatives array<map<string,string>>, status string, category string, "
    "commit_hash string, commit_time timestamp_ntz, created_at timestamp_ntz, approved_at timestamp_ntz"
)
TIMELINE = (
    "id long, event_type string, from_ref string, to_ref string, summary string, files_changed array<string>, "
    "diff_stats struct<insertions:long,deletions:long,files:long,commits:long>, importance string, commit_hash string, commit_time timestamp_ntz, created_at timestamp_ntz"
)
CHANGELOGS = (
    "id long, tag string, version string, date timestamp_ntz, summary string, breaking_changes array<string>, features array<string>, fixes array<string>, "
    "commit_hash string, commit_time timestamp_ntz, created_at timestamp_ntz"
)


def retain_pending(decisions: DataFrame, most: int = PENDING_LIMIT) -> DataFrame:
    """All decided rows, and the newest ``most`` pending ones by creation and id."""
    pending = F.coalesce(F.col("status") == "pending", F.lit(False))
    newest = decisions.filter(pending).orderBy(F.desc("created_at"), F.desc("id")).limit(most)  # a top-k of each task
    return decisions.filter(~pending).unionByName(newest)


def add_decisions(decisions: DataFrame, new: DataFrame, most: int = PENDING_LIMIT) -> DataFrame:
    return retain_pending(decisions.unionByName(new, allowMissingColumns=True), most)


def approve(decisions: DataFrame, ids: list[int], category: str, at: Column) -> DataFrame:
    """Pending decisions of ``ids`` approved; others stay as they are."""
    hit = F.col("id").isin(ids) & (F.col("status") == "pending")
    return decisions.withColumns({"status": F.when(hit, "approved").otherwise(F.col("status")), "category": F.when(hit, category).otherwise(F.col("category")), "approved_at": F.when(hit, at).otherwise(F.col("approved_at"))})


def approved_memory(decisions: DataFrame) -> DataFrame:
    """What approved decisions are remembered by."""
    content = F.concat("description", F.lit("\n\nReasoning: "), F.coalesce("reasoning", F.lit("N/A")))
    return decisions.filter("status = 'approved'").select(F.col("id").alias("decision_id"), "category", "title", content.alias("content"), "approved_at")


def reject(decisions: DataFrame, ids: list[int]) -> DataFrame:
    return decisions.withColumn("status", F.when(F.col("id").isin(ids) & (F.col("status") == "pending"), "rejected").otherwise(F.col("status")))


def with_status(decisions: DataFrame, status: str | None = None, category: str | None = None) -> DataFrame:
    """Decisions of a status and a category, newest first."""
    for column, value in (("status", status), ("category", category)):
        if value:
            decisions = decisions.filter(F.col(column) == value)
    return decisions.orderBy(F.desc("created_at"), F.desc("id"))


def oldest_pending(decisions: DataFrame, n: int = 20) -> DataFrame:
    return decisions.filter("status = 'pending'").orderBy("created_at", "id").limit(n)


def importance(files: Column, lines: Column) -> Column:
    return F.when((files > 50) | (lines > 1000), "high").when((files > 10) | (lines > 200), "medium").otherwise("low")


def level(name: Column) -> Column:
    """Importance as a number; an unknown one is low."""
    return F.when(name == "high", 2).when(name == "medium", 1).otherwise(0)


def timeline(events: DataFrame, *, from_ref: str | None = None, to_ref: str | None = None, n: int = 100, event_type: str | None = None, least: str | None = None, since: Column | None = None) -> DataFrame:
    """The newest ``n`` events of given refs, then those of a type, importance or time among them."""
    for column, value in (("from_ref", from_ref), ("to_ref", to_ref)):
        if value:
            events = events.filter(F.col(column) == value)
    out = events.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if least:
        out = out.filter(level(F.col("importance")) >= level(F.lit(least)))
    return out if since is None else out.filter(F.col("created_at") >= since)


def changelogs(rows: DataFrame, n: int = 100, start: str | None = None, end: str | None = None, semver: bool = False) -> DataFrame:
    """The newest ``n`` changelogs, then those of a range of tags, as text or by version numbers."""
    out = rows.orderBy(F.desc("date"), F.desc("tag")).limit(n)
    key = lambda c: F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda x: F.try_to_number(x, F.lit("999999")).cast("int")) if semver else c
    for value, test in ((start, lambda a, b: a >= b), (end, lambda a, b: a <= b)):
        if value:
            out = out.filter(test(key(F.col("tag")), key(F.lit(value))))
    return out


def sync(existing: DataFrame, found: DataFrame, keys: list[str], *, least: str | None = None, limit: int = 50, order: list[Column] | None = None) -> DataFrame:
    """``found`` with ``outcome``: ``skipped`` below the importance or known already, ``added`` for the first ``limit``
    others, ``left`` for the rest (they are looked at in ``order``).

    Rows are ranked in SPREAD groups first; only the first ``limit`` of each meet in one task."""
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    rows = found.join(known, keys, "left")
    ok = F.col("_known").isNull() & (level(F.col("importance")) >= level(F.lit(least)) if least else F.lit(True))
    order = order or [F.desc("commit_time"), *keys]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_ok", ok)
    fit = rows.filter("_ok").withColumn("_part", F.pmod(F.xxhash64(*found.columns), F.lit(SPREAD))).withColumn("_r", rank("_part"))
    first = fit.filter(F.col("_r") <= limit).withColumn("_r", rank()).withColumn("outcome", F.when(F.col("_r") <= limit, "added").otherwise("left"))
    rest = fit.filter(F.col("_r") > limit).withColumn("outcome", F.lit("left"))
    skipped = rows.filter("not _ok").withColumn("outcome", F.lit("skipped"))
    names = [*found.columns, "outcome"]
    return first.select(*names).unionByName(rest.select(*names)).unionByName(skipped.select(*names))


def import_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], newest_wins: bool = False, time: str = "created_at") -> DataFrame:
    """Next snapshot of a table after an import: new keys are added; known keys keep their row, or
    the newer of the two with ``newest_wins``."""
    first = Window.partitionBy(*keys).orderBy(time)
    incoming = incoming.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    if not newest_wins:
        return existing.unionByName(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc(time), "_in")
    return both.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r", "_in")


def search(decisions: DataFrame, events: DataFrame, logs: DataFrame, words: str, k: int = 10) -> DataFrame:
    """``kind, ref, title, body, created_at`` of the newest k rows that hold ``words`` (whatever their case; ``%`` and ``_`` are wildcards):
    decisions by title or description, events and changelogs by their summary."""
    line = F.concat("event_type", F.lit(": "), "from_ref", F.lit(" → "), "to_ref")
    kinds = [
        decisions.select(F.lit("decision").alias("kind"), F.col("id").cast("string").alias("ref"), "title", F.col("description").alias("body"), "created_at"),
        events.select(F.lit("timeline").alias("kind"), F.col("id").cast("string").alias("ref"), line.alias("title"), F.col("summary").alias("body"), "created_at"),
        logs.select(F.lit("changelog").alias("kind"), F.col("tag").alias("ref"), F.col("tag").alias("title"), F.col("summary").alias("body"), F.col("date").alias("created_at")),
    ]
    pattern = f"%{words}%"
    hits = [rows.filter(F.col("body").ilike(pattern) | ((F.col("kind") == "decision") & F.col("title").ilike(pattern))) for rows in kinds]
    best = [rows.orderBy(F.desc("created_at"), F.desc("ref")).limit(k) for rows in hits]
    return best[0].unionByName(best[1]).unionByName(best[2]).orderBy(F.desc("created_at"), "kind", F.desc("ref")).limit(k)


def duplicate_tags(logs: DataFrame, new: DataFrame) -> DataFrame:
    """``tag, n_rows, known``: tags of ``new`` that it repeats or that ``logs`` has already."""
    known = logs.select("tag").distinct().withColumn("known", F.lit(True))
    rows = new.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows")).join(known, "tag", "left")
    return rows.withColumn("known", F.coalesce("known", F.lit(False))).filter("known or n_rows > 1")


def numbered(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and after it ``new``, whose ids follow the largest one without gaps: a row's place in its
    partition after the counts of the partitions before."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = new.drop("id").withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").crossJoin(F.broadcast(top))
    rows = rows.withColumn("id", F.col("_top") + F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_top", "_m", "_part", "_before")
    return existing.unionByName(rows, allowMissingColumns=True)


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a document that :func:`export_memory` wrote."""
    schema = f"version string, timeline array<struct<{_fields(TIMELINE)}>>, changelogs array<struct<{_fields(CHANGELOGS)}>>, decisions array<struct<{_fields(DECISIONS)}>>, pending array<struct<{_fields(DECISIONS)}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    table = lambda name: rows.select(F.explode(name).alias("r")).select("r.*")
    return {"timeline": table("timeline"), "changelogs": table("changelogs"), "decisions": table("decisions").unionByName(table("pending"))}


def _fields(schema: str) -> str:
    """``name: type, ...`` of a table's schema."""
    out, depth, item = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = item.strip().split(" ", 1)
            out.append(f"{name}: {kind.replace('struct<', 'struct<')}")
            item = ""
        else:
            item += c
    return ", ".join(out)


def export_memory(decisions: DataFrame, events: DataFrame, logs: DataFrame, n: int = 100, pending: bool = False) -> DataFrame:
    """One row, one JSON document: the newest ``n`` events and changelogs, all approved decisions, and pending ones if asked."""
    packed = lambda df, name: df.agg(F.collect_list(F.struct("*")).alias(name))
    rows = packed(timeline(events, n=n), "timeline").crossJoin(packed(changelogs(logs, n), "changelogs"))
    rows = rows.crossJoin(packed(decisions.filter("status = 'approved'").orderBy(F.desc("approved_at"), "id"), "decisions"))
    if pending:
        rows = rows.crossJoin(packed(oldest_pending(decisions, n), "pending"))
    return rows.select(F.to_json(F.struct(F.lit("1.0").alias("version"), "*")).alias("json"))


def context(decisions: DataFrame, events: DataFrame, logs: DataFrame, hits: DataFrame) -> DataFrame:
    """One JSON bundle: 10 pending decisions, 10 events, 5 changelogs, 5 hits with 200 characters of code."""
    packed = lambda df, name: df.agg(F.collect_list(F.struct("*")).alias(name))
    short = hits.orderBy(F.desc("score"), "chunk_id").limit(5).withColumn("code", F.substring("code", 1, 200))
    rows = packed(oldest_pending(decisions, 10), "decisions").crossJoin(packed(timeline(events, n=10), "timeline"))
    rows = rows.crossJoin(packed(changelogs(logs, 5), "changelogs")).crossJoin(packed(short, "code"))
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def save_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write version ``version`` of a table; it counts once its ``_SUCCESS`` mark is there."""
    df.write.mode("overwrite").parquet(f"{root}/v{version:08d}")


def load_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest complete version, or an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(s.getPath().getParent().toString() for s in (system.globStatus(hadoop.Path(f"{root}/v*/_SUCCESS")) or []))
    return spark.read.schema(schema).parquet(done[-1]) if done else spark.createDataFrame([], schema)
