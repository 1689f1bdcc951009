"""Chunks from lines of text: splits, merges, gaps and fixed windows.

Order-dependent folds run over the sizes of one file's lines or chunks (a few numbers for each,
in Arrow batches) and say where chunks start; texts stay in the JVM and are cut there, so files
are spread over the cluster, nothing is shuffled to be cut, and time grows with the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SIZE, MERGE_PART = 1200, 0.8


def _size(line: Column) -> Column:
    """Length without blanks and tabs."""
    return F.length(F.translate(line, " \t", ""))


def _solid(code: Column) -> Column:
    """Length without blanks, tabs and newlines."""
    return F.length(F.translate(code, " \t\n", ""))


def fixed_lines(files: DataFrame, n: int, path: str = "file_path", text: str = "text") -> DataFrame:
    """Chunks of ``n`` lines: ``file_path, symbol, start_line, end_line, code``."""
    count = F.size("_lines")
    starts = F.sequence(F.lit(0), F.floor((count - 1) / n).cast("int"))
    rows = files.select(F.col(path).alias("file_path"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines")).withColumn("_i", F.explode(starts))
    start, end = F.col("_i") * n + 1, F.least((F.col("_i") + 1) * n, count)
    code = F.array_join(F.slice("_lines", start, n), "\n")
    return rows.select("file_path", F.concat("file_path", F.lit(":L"), start, F.lit("-"), end).alias("symbol"), start.alias("start_line"), end.alias("end_line"), code.alias("code"))


def _fold(sizes: list[int], most: int) -> list[int]:
    """First line (from 0) of each chunk: a chunk ends before the line that overflows it."""
    starts, size = [0], 0
    for i, w in enumerate(sizes):
        if size + w > most and i > starts[-1]:
            starts.append(i)
            size = 0
        size += w
    return starts


def _starts(weights: Column, most: int) -> Column:
    """First lines of the chunks of each row."""

    def fold(rows: pa.Array) -> pa.Array:
        return pa.array([_fold(sizes, most) for sizes in rows.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(fold, "array<int>")(weights)


def _cut(rows: DataFrame, keys: list[str], weight, most: int, first_line: Column) -> DataFrame:
    """Chunks of the array ``_lines`` of each row: ``keys, part`` (from 0), ``start_line, end_line, code``."""
    rows = rows.withColumn("_starts", _starts(F.transform("_lines", weight), most))
    rows = rows.select(*keys, "_lines", "_starts", first_line.alias("_first"), F.posexplode("_starts").alias("part", "_a"))
    end = F.coalesce(F.get("_starts", F.col("part") + 1), F.size("_lines"))
    code = F.array_join(F.slice("_lines", F.col("_a") + 1, end - F.col("_a")), "\n")
    return rows.select(*keys, "part", (F.col("_first") + F.col("_a")).alias("start_line"), (F.col("_first") + end - 1).alias("end_line"), code.alias("code"))


def fixed_chars(files: DataFrame, most: int, path: str = "file_path", text: str = "text") -> DataFrame:
    """Chunks of whole lines of at most ``most`` characters, a newline each counted (a longer line alone)."""
    rows = files.select(F.col(path).alias("file_path"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    return _cut(rows, ["file_path"], lambda x: F.length(x) + 1, most, F.lit(1)).drop("part")


def split_oversized(chunks: DataFrame, most: int = MAX_SIZE) -> DataFrame:
    """Chunks over ``most`` solid characters cut before the line that overflows: symbols get ``_part1``, ``_part2``,
    ..., lines stay absolute.  Other columns: ``file_path, symbol, chunk_type, language, parent_header``."""
    keys = ["file_path", "symbol", "chunk_type", "language", "parent_header", "start_line", "end_line"]
    small = chunks.filter(_solid(F.col("code")) <= most).select(*keys, "code")
    large = chunks.filter(_solid(F.col("code")) > most).select(*keys, F.split("code", "\n").alias("_lines"))
    own = ["file_path", "symbol", "chunk_type", "language", "parent_header"]
    parts = _cut(large, own, _size, most, F.col("start_line")).withColumn("symbol", F.concat("symbol", F.lit("_part"), F.col("part") + 1))
    return small.unionByName(parts.select(*keys, "code"))


MERGED = "file_path string, start_line int, end_line int, symbol string, code string, chunk_type string, language string"


def greedy_merge(chunks: DataFrame, most: int = MAX_SIZE, part: float = MERGE_PART, grow_end: bool = False) -> DataFrame:
    """Adjacent or overlapping chunks of a file merged while both are under ``most * part`` solid characters.

    Sizes are looked at before a merge, so a result may exceed ``most``.  The end line is that of
    the chunk merged in, or the larger of the two with ``grow_end``.  Type and language are the first's.

    A scan of sorted rows: chunks are dealt out by file, sorted, and pass by; what is held is the one merged chunk that is
    still open, of less than twice the limit.  A gap or a chunk at the limit closes it."""
    limit = most * part
    order = ["file_path", "start_line", "end_line", "symbol", "code", "chunk_type", "language"]
    rows = chunks.select("file_path", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "symbol", "code", "chunk_type", "language", _solid(F.col("code")).alias("n"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in MERGED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
        joined = lambda parts, by: by.join(x for x in parts if x is not None)
        held, size, end, out = [], None, None, []

        def close() -> None:
            if held:
                ends = [r[2] for r in held if r[2] is not None]
                last = (max(ends) if ends else None) if grow_end else held[-1][2]
                out.append((held[0][0], held[0][1], last, joined([r[3] for r in held], "+"), joined([r[4] for r in held], "\n"), held[0][5], held[0][6]))
                held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, a, b, n = row[0], row[1], row[2], row[7]
                known = bool(held) and held[0][0] == path and None not in (end, size, a, n)
                if known and end + 1 >= a and size < limit and n < limit:
                    end, size = max(end, b) if grow_end and b is not None else b, size + n
                else:
                    close()
                    end, size = b, n
                held.append(row)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)

    return rows.repartition("file_path").sortWithinPartitions(*order).mapInArrow(scan, MERGED)


def deduplicate(chunks: DataFrame, keys: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """First chunk of each trimmed text within ``keys``, by start line."""
    order = Window.partitionBy(*keys, F.trim(F.regexp_replace("code", r"^\s+|\s+$", ""))).orderBy("start_line", "end_line", "symbol")
    return chunks.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def not_blank(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("code").rlike(r"\S"))


def coverage_gaps(spans: DataFrame, files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """``file_path, symbol, start_line, end_line, code`` of non-blank line ranges that no span covers; a file
    without spans is one ``module_content``.  A file's lines are in one row, which meets its ranges (two numbers each) and is cut there."""
    before = Window.partitionBy("file_path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    known = spans.select("file_path", "start_line", "end_line")
    inner = known.withColumn("a", F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1).select("file_path", "a", (F.col("start_line") - 1).alias("b"))
    tail = known.groupBy("file_path").agg((F.max("end_line") + 1).alias("a")).select("file_path", "a", F.lit(None).cast("int").alias("b"))
    open_ = inner.filter("a <= b").unionAll(tail).groupBy("file_path").agg(F.collect_list(F.struct("a", "b")).alias("_open"))
    lines = files.select(F.col(path).alias("file_path"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_lines"))
    n = F.size("_lines")

    def gap(g: Column) -> Column:
        end = F.coalesce(g["b"], n)
        return F.struct(F.concat(F.lit("module_gap_"), g["a"], F.lit("_"), end).alias("symbol"), g["a"].alias("start_line"), end.alias("end_line"))

    whole = F.array(F.struct(F.lit("module_content").alias("symbol"), F.lit(1).alias("start_line"), n.alias("end_line")))
    gaps = F.filter(F.when(F.col("_open").isNull(), whole).otherwise(F.transform("_open", gap)), lambda g: g["start_line"] <= g["end_line"])
    code = lambda g: F.array_join(F.slice("_lines", g["start_line"], g["end_line"] - g["start_line"] + 1), "\n")
    cut = F.transform(gaps, lambda g: F.struct(g["symbol"].alias("symbol"), g["start_line"].alias("start_line"), g["end_line"].alias("end_line"), code(g).alias("code")))
    return not_blank(lines.join(open_, "file_path", "left").select("file_path", F.inline(cut)))


BLANK = " \t\n\x0b\f\r"


def part_starts(lines: list[str], most: int) -> list[int]:
    """Where :func:`split_oversized` cuts one chunk's lines; nothing if they are not over ``most``."""
    sizes = [len(x) - x.count(" ") - x.count("\t") for x in lines]
    return _fold(sizes, most) if sum(sizes) > most else []


def first_of_equal(chunks: list[tuple]) -> list[tuple]:
    """:func:`deduplicate` for one file's ``symbol, .., start_line, end_line, code``."""
    first: dict[str, tuple] = {}
    for c in sorted(chunks, key=lambda c: (c[-3], c[-2], c[0])):
        first.setdefault(c[-1].strip(BLANK), c)
    return list(first.values())


def uncovered(spans: list[tuple[int, int]], n: int) -> list[tuple[str, int, int]]:
    """Name, start and end of the ranges of ``n`` lines that no span covers, as :func:`coverage_gaps` has them (blank ones too)."""
    if not spans:
        return [("module_content", 1, n)]
    out, at = [], 1
    for start, end in [*sorted(spans), (n + 1, n + 1)]:
        if at < start:
            out.append((f"module_gap_{at}_{start - 1}", at, start - 1))
        at = max(at, end + 1)
    return out


def chunk_stats(chunks: DataFrame, by: str = "strategy") -> DataFrame:
    n = F.length("code")
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(n).alias("avg_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"))


def overlapping(a: DataFrame, b: DataFrame, on: str, width: int = 100) -> DataFrame:
    """Pairs of closed line ranges of the same ``on`` that overlap: ``on, a_id, b_id``.

    Ranges are filed under the buckets of ``width`` they touch and meet by an equality join; a
    pair counts in the first bucket both touch."""
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.select(on, F.col("id").alias("a_id"), F.col("start_line").alias("a1"), F.col("end_line").alias("a2"), bucket("start_line", "end_line").alias("_b"))
    y = b.select(on, F.col("id").alias("b_id"), F.col("start_line").alias("b1"), F.col("end_line").alias("b2"), bucket("start_line", "end_line").alias("_b"))
    both = x.join(y, [on, "_b"]).filter((F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")))
    return both.filter(F.col("_b") == F.floor(F.greatest("a1", "b1") / width)).select(on, "a_id", "b_id")
