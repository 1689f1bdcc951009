"""Queries of commit tables: the orders of a customer are the commits of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ancestry
from ..sources import history
from ..sources.tables import read_table

LIMIT = 3


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each five commits the third starts a branch beside the second, and the fifth merges both."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").alias("time"), "o_totalprice", "o_orderpriority",
        F.row_number().over(by).alias("n"), *[F.lag(F.col("o_orderkey").cast("string"), k).over(by).alias(f"p{k}") for k in (1, 2, 3)],
    )
    k = F.col("n") % 5
    parents = F.when(k == 3, F.array("p2")).when(k == 0, F.array("p1", "p3")).otherwise(F.array("p1"))
    lines = F.floor("o_totalprice").cast("long") % 1500
    title = F.when(k == 0, F.concat(F.lit("Merge branch 'b"), "n", F.lit("'"), F.when(F.col("n") % 10 == 0, " into 'main'").otherwise(""))).otherwise(F.concat(F.lit("fix: "), "hash"))
    return o.select(
        "repo", "hash", F.filter(parents, lambda x: x.isNotNull()).alias("parents"), "n", "p1", "time", F.concat(title, F.lit("\nbody")).alias("message"),
        F.array(F.concat(F.lit("f"), F.col("n") % 4), F.substring("o_orderpriority", 1, 1)).alias("files"), lines.alias("insertions"), F.lit(1).cast("long").alias("deletions"),
    )


def _stretches(rows: DataFrame) -> DataFrame:
    """``repo, old, new``: from each fourth commit of a repository to the one four later."""
    at = rows.filter("n % 4 = 0").select("repo", "hash", "n")
    return at.select("repo", F.col("hash").alias("old"), (F.col("n") + 4).alias("n")).join(at.select("repo", "n", F.col("hash").alias("new")), ["repo", "n"]).select("repo", "old", "new")


def commit_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestry.generations(ancestry.fold(_commits(spark, sf_dir)))


def commit_merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of every commit and the one before it in time."""
    rows = _commits(spark, sf_dir)
    pairs = rows.filter("p1 is not null").select("repo", F.col("p1").alias("left"), F.col("hash").alias("right"))
    return ancestry.merge_bases(ancestry.fold(rows), pairs)


def commit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir)
    found = ancestry.commit_range(ancestry.fold(rows), _stretches(rows))
    return found.join(rows.select("repo", "hash", history.subject(F.col("message")).alias("subject")), ["repo", "hash"])


def compare_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir)
    asked = _stretches(rows)
    inside = ancestry.commit_range(ancestry.fold(rows), asked).join(rows, ["repo", "hash"])
    out = history.compare_ranges(inside, asked)
    return out.select("repo", "from_ref", "to_ref", "summary", F.array_join("files_changed", ",").alias("files_changed"), "diff_stats.*", "importance")


def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.merge_rows(_commits(spark, sf_dir), LIMIT)
    return out.select("repo", "from_ref", "to_ref", "summary", F.array_join("files_changed", ",").alias("files_changed"), "diff_stats.*", "importance", "commit_hash", "commit_time")


def tag_changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sixth commit has a tag, with its message or without."""
    k = F.col("hash").cast("long")
    tag = F.concat(F.when(k % 4 == 0, "release-").when(k % 4 == 1, "").otherwise("v"), k % 9, F.lit("."), k % 7, F.lit("."), k)
    message = F.when(k % 3 == 0, F.concat(F.lit("feat: "), k, F.lit("\n  fix: x\nbug: y\nBREAKING "), k, F.lit("\n"))).when(k % 3 == 1, " \n ")
    rows = _commits(spark, sf_dir).filter("n % 6 = 0").select(tag.alias("tag"), "hash", "time", message.alias("message"))
    lists = ("breaking_changes", "features", "fixes")
    return history.tag_rows(rows).select("tag", "version", "date", "summary", *[F.array_join(c, "|").alias(c) for c in lists], "commit_hash")


_COMMITS = """c AS (
    SELECT o_custkey::VARCHAR AS repo, o_orderkey::VARCHAR AS hash, o_orderdate AS time, floor(o_totalprice)::BIGINT % 1500 AS insertions, o_orderpriority[1] AS pr, row_number() OVER w AS n,
        lag(o_orderkey::VARCHAR, 1) OVER w AS p1, lag(o_orderkey::VARCHAR, 2) OVER w AS p2, lag(o_orderkey::VARCHAR, 3) OVER w AS p3
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT repo, hash, CASE WHEN n % 5 = 3 THEN p2 ELSE p1 END AS parent FROM c WHERE n > 1 UNION ALL SELECT repo, hash, p3 FROM c WHERE n % 5 = 0),
titles AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'Merge branch ''b' || n || '''' || CASE WHEN n % 10 = 0 THEN ' into ''main''' ELSE '' END ELSE 'fix: ' || hash END AS subject FROM c),
reach AS (SELECT repo, hash AS start, hash FROM c UNION SELECT r.repo, r.start, e.parent FROM reach r JOIN edges e ON e.repo = r.repo AND e.hash = r.hash),
asked AS (SELECT a.repo, a.hash AS old, b.hash AS new FROM c a JOIN c b ON a.repo = b.repo AND b.n = a.n + 4 WHERE a.n % 4 = 0),
inside AS (SELECT a.repo, a.old, a.new, r.hash FROM asked a JOIN reach r ON r.repo = a.repo AND r.start = a.new ANTI JOIN reach o ON o.repo = a.repo AND o.start = a.old AND o.hash = r.hash)"""
_LEVEL = "CASE WHEN {f} > 50 OR {l} > 1000 THEN 'high' WHEN {f} > 10 OR {l} > 200 THEN 'medium' ELSE 'low' END AS importance"
_LINES = "array_to_string(list_transform(list_filter(string_split(summary, chr(10)), lambda x: regexp_matches(x, '{}')), lambda x: trim(x)), '|')"

ORACLES = {
    "commit_generations": f"WITH RECURSIVE {_COMMITS}, d AS (SELECT repo, hash, 1::BIGINT AS g FROM c WHERE n = 1 UNION SELECT e.repo, e.hash, d.g + 1 FROM d JOIN edges e ON e.repo = d.repo AND e.parent = d.hash) SELECT repo, hash, max(g) AS generation FROM d GROUP BY repo, hash",
    "commit_merge_bases": f"""WITH RECURSIVE {_COMMITS}, common AS (
            SELECT c.repo, c.p1, c.hash AS tip, a.hash FROM c JOIN reach a ON a.repo = c.repo AND a.start = c.p1 JOIN reach b ON b.repo = c.repo AND b.start = c.hash AND b.hash = a.hash)
        SELECT repo, p1 AS "left", tip AS "right", hash AS base FROM common x
        WHERE NOT EXISTS (SELECT 1 FROM common y JOIN reach r ON r.repo = y.repo AND r.start = y.hash WHERE y.repo = x.repo AND y.p1 = x.p1 AND y.tip = x.tip AND y.hash <> x.hash AND r.hash = x.hash)""",
    "commit_ranges": f"WITH RECURSIVE {_COMMITS} SELECT i.repo, i.old, i.new, i.hash, t.subject FROM inside i JOIN titles t USING (repo, hash)",
    "compare_refs": f"""WITH RECURSIVE {_COMMITS}, s AS (
            SELECT a.repo, a.old, a.new, count(t.hash) AS commits, coalesce(sum(t.insertions), 0)::BIGINT AS insertions, list(t.subject ORDER BY t.time DESC, t.hash) FILTER (t.hash IS NOT NULL) AS subjects,
                list_sort(list_distinct(flatten(list([t.f, t.pr]) FILTER (t.hash IS NOT NULL)))) AS files
            FROM asked a LEFT JOIN inside i USING (repo, old, new) LEFT JOIN (SELECT *, 'f' || n % 4 AS f FROM titles) t ON t.repo = i.repo AND t.hash = i.hash GROUP BY ALL)
        SELECT repo, old AS from_ref, new AS to_ref, array_to_string(subjects[:5], chr(10)) || CASE WHEN commits > 5 THEN chr(10) || '… and ' || (commits - 5) || ' more commits' ELSE '' END AS summary,
            array_to_string(files, ',') AS files_changed, insertions, commits AS deletions, len(files) AS files, commits, {_LEVEL.format(f="len(files)", l="insertions + commits")} FROM s""",
    "merge_events": f"""WITH RECURSIVE {_COMMITS}, looked AS (SELECT * FROM titles QUALIFY row_number() OVER (PARTITION BY repo ORDER BY time DESC, hash) <= {2 * LIMIT}),
        m AS (SELECT * FROM looked WHERE n % 5 = 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY time DESC, hash) <= {LIMIT})
        SELECT repo, 'b' || n AS from_ref, 'main' AS to_ref, subject AS summary, 'f' || n % 4 || ',' || pr AS files_changed, insertions, 1::BIGINT AS deletions, 2::BIGINT AS files, 1::BIGINT AS commits,
            {_LEVEL.format(f="2", l="insertions + 1")}, hash AS commit_hash, time AS commit_time FROM m""",
    "tag_changelogs": f"""WITH RECURSIVE {_COMMITS}, t AS (
            SELECT hash::BIGINT AS k, hash, time, CASE k % 4 WHEN 0 THEN 'release-' WHEN 1 THEN '' ELSE 'v' END || k % 9 || '.' || k % 7 || '.' || k AS tag FROM c WHERE n % 6 = 0),
        s AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'feat: ' || k || chr(10) || '  fix: x' || chr(10) || 'bug: y' || chr(10) || 'BREAKING ' || k ELSE 'Release ' || tag END AS summary FROM t)
        SELECT tag, nullif(regexp_extract(tag, '^v?([0-9]+[.][0-9]+[.][0-9]+)', 1), '') AS version, time AS date, summary, {_LINES.format("(?i)breaking|^!:")} AS breaking_changes,
            {_LINES.format("(?i)^(feat|feature|add):")} AS features, {_LINES.format("(?i)^(fix|bug):")} AS fixes, hash AS commit_hash FROM s""",
}
QUERIES = {f.__name__: f for f in (commit_generations, commit_merge_bases, commit_ranges, compare_refs, merge_events, tag_changelogs)}
