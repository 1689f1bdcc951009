"""Git history as DataFrames: commits, tags, merges and comparisons.

The log of a repository is streamed into the shared folder, a megabyte at a time, and read back by the tasks; the rest
works on tables of commits (``repo, hash, parents, time, message, files, insertions, deletions``) of any number of
repositories.  Ranges of such tables come from :mod:`tarn.operators.ancestry`.
"""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import breaking_changes, feature_lines, fix_lines, merge_branches, version
from ..operators.memory import importance
from .tables import shared_folder

_UNIT, _RECORD = "\x1f", "\x1e"


PIECE = 1 << 20


def _records(spark: SparkSession, repo: str, *args: str) -> DataFrame | None:
    """``raw, seq``: what a git command prints, by records in its order; None if it fails."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tarn-git/{uuid.uuid4().hex}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    with subprocess.Popen(["git", "-C", repo, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        while piece := run.stdout.read(PIECE):
            out.write(bytearray(piece))
    out.close()
    if run.returncode:
        return None
    rows = spark.read.option("lineSep", _RECORD).text(str(at.toString()))
    seq = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("value").alias("raw"), seq.alias("seq")).filter(F.col("raw").rlike(r"\S"))  # what stands before the first record and after the last one


def commits(spark: SparkSession, repo: str, revisions: str = "HEAD", most: int | None = None) -> DataFrame:
    """``repo, seq, hash, parents, time, message, files, insertions, deletions`` of a range, newest first by ``seq``; an invalid range lists HEAD."""
    log = ["log", "--diff-merges=first-parent", "--numstat", f"--format={_RECORD}%H{_UNIT}%P{_UNIT}%ct{_UNIT}%B{_UNIT}", *(["-n", str(most)] if most else [])]
    raw = _records(spark, repo, *log, revisions)
    raw = _records(spark, repo, *log, "HEAD") if raw is None else raw
    raw = spark.createDataFrame([], "raw string, seq struct<block:long,row:long>") if raw is None else raw  # no commit yet
    f = F.split("raw", _UNIT)
    stats = F.filter(F.split(F.try_element_at(f, F.lit(5)), "\n"), lambda x: x.rlike(r"^[0-9-]+\t[0-9-]+\t"))
    total = lambda i: F.aggregate(stats, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.element_at(F.split(x, "\t"), i).try_cast("long"), F.lit(0)))
    return raw.select(
        F.lit(repo).alias("repo"), "seq", F.try_element_at(f, F.lit(1)).alias("hash"), F.filter(F.split(F.try_element_at(f, F.lit(2)), " "), lambda p: p != "").alias("parents"),
        F.timestamp_seconds(F.try_element_at(f, F.lit(3)).cast("long")).cast("timestamp_ntz").alias("time"), F.trim(F.try_element_at(f, F.lit(4))).alias("message"),
        F.transform(stats, lambda x: F.element_at(F.split(x, "\t"), 3)).alias("files"), total(1).alias("insertions"), total(2).alias("deletions"),
    )


def subject(message: Column) -> Column:
    return F.element_at(F.split(message, "\n"), 1)


def tags(spark: SparkSession, repo: str) -> DataFrame:
    """Changelog rows of all tags, newest first."""
    raw = _records(spark, repo, "for-each-ref", "refs/tags", f"--format=%(refname:short){_UNIT}%(objectname){_UNIT}%(creatordate:unix){_UNIT}%(contents){_RECORD}")
    raw = spark.createDataFrame([], "raw string") if raw is None else raw
    f = F.split(F.ltrim(F.regexp_replace("raw", r"^\n+", "")), _UNIT)
    return tag_rows(raw.select(F.try_element_at(f, F.lit(1)).alias("tag"), F.try_element_at(f, F.lit(2)).alias("hash"), F.timestamp_seconds(F.try_element_at(f, F.lit(3)).cast("long")).cast("timestamp_ntz").alias("time"), F.try_element_at(f, F.lit(4)).alias("message")))


def tag_rows(tagged: DataFrame) -> DataFrame:
    """Changelog rows of ``tag, hash, time, message``, newest first: a tag without a message is a release."""
    text = F.trim(F.regexp_replace("message", r"^\s+|\s+$", ""))
    rows = tagged.select("tag", F.col("hash").alias("commit_hash"), F.col("time").alias("date"), F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("Release "), F.col("tag"))).alias("summary"))
    return rows.select("tag", version(F.col("tag")).alias("version"), "date", "summary", breaking_changes(F.col("summary")).alias("breaking_changes"), feature_lines(F.col("summary")).alias("features"), fix_lines(F.col("summary")).alias("fixes"), "commit_hash", F.col("date").alias("commit_time")).orderBy(F.desc("date"), "tag")


def _newest(keys: list[str], order: list[Column]) -> Column:
    """Rank in ``order``; a filter on it is met by each task before rows are shuffled."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def merges(spark: SparkSession, repo: str, since: str | None = None, limit: int = 50) -> DataFrame:
    """Timeline rows of merge commits among the newest ``2 * limit`` commits."""
    return merge_rows(commits(spark, repo, f"{since}..HEAD" if since else "HEAD", 2 * limit), limit, [F.col("seq")]).drop("repo")


def merge_rows(rows: DataFrame, limit: int = 50, order: list[Column] | None = None) -> DataFrame:
    """``repo`` and timeline rows: of the newest ``2 * limit`` commits of each repository those of two parents or more, at most
    ``limit``, newest first (by time, then hash)."""
    order = order or [F.desc("time"), F.col("hash")]
    looked = rows.withColumn("_n", _newest(["repo"], order)).filter(F.col("_n") <= 2 * limit).filter(F.size("parents") >= 2)
    source, target = merge_branches(F.col("message"))
    n_files, n_lines = F.size("files"), F.col("insertions") + F.col("deletions")
    return looked.withColumn("_n", _newest(["repo"], order)).filter(F.col("_n") <= limit).select(
        "repo", F.lit("merge").alias("event_type"), F.coalesce(source, F.lit("unknown")).alias("from_ref"), F.coalesce(target, F.lit("main")).alias("to_ref"), subject(F.col("message")).alias("summary"),
        F.slice("files", 1, 20).alias("files_changed"),
        F.struct("insertions", "deletions", n_files.cast("long").alias("files"), F.lit(1).cast("long").alias("commits")).alias("diff_stats"),
        importance(n_files, n_lines).alias("importance"), F.col("hash").alias("commit_hash"), F.col("time").alias("commit_time"),
    )


def compare(spark: SparkSession, repo: str, start: str, end: str) -> DataFrame:
    """One timeline row for the commits from ``start`` to ``end``: first five subjects, totals, up to 50 files."""
    rows = commits(spark, repo, f"{start}..{end}").withColumns({"old": F.lit(start), "new": F.lit(end)})
    asked = spark.createDataFrame([(repo, start, end)], "repo string, old string, new string")
    return compare_ranges(rows, asked, [F.col("seq")]).drop("repo")


def compare_ranges(rows: DataFrame, asked: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One timeline row for each ``repo, old, new`` of ``asked``, from its commits among ``rows`` (with the same three columns).

    Sums, subjects and files are grouped apart, so a range of any length is added up by all tasks and no list holds all of it."""
    keys, order = ["repo", "old", "new"], order or [F.desc("time"), F.col("hash")]
    sums = rows.groupBy(*keys).agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("commits"))
    first = rows.select(*keys, subject(F.col("message")).alias("s"), _newest(keys, order).alias("n")).filter("n <= 5")
    first = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("s"))
    names = rows.select(*keys, F.explode("files").alias("f")).distinct()
    n_files = names.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    some = names.select(*keys, "f", _newest(keys, [F.col("f")]).alias("n")).filter("n <= 50").groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("f"))
    one = asked.select(*keys).distinct()
    for part in (sums, first, n_files, some):
        one = one.join(part, keys, "left")
    one = one.na.fill(0, ["insertions", "deletions", "commits", "files"]).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("s", "f")})
    more = F.when(F.col("commits") > 5, F.format_string("\n… and %d more commits", F.col("commits") - 5)).otherwise("")
    return one.select(
        "repo", F.lit("comparison").alias("event_type"), F.col("old").alias("from_ref"), F.col("new").alias("to_ref"), F.concat(F.array_join("s", "\n"), more).alias("summary"),
        F.col("f").alias("files_changed"), F.struct("insertions", "deletions", "files", "commits").alias("diff_stats"),
        importance(F.col("files"), F.col("insertions") + F.col("deletions")).alias("importance"),
    )
