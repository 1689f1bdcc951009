"""Audit of how sources of a language differ in their words, by sorting and scanning runs.

1. Documents are counted where they lie: a row for each language, source and term of some Arrow batches (a task's, while
   they have at most HELD rows) with the documents that hold the term and its occurrences.  So a word of all
   documents is a few rows a task.
2. These rows are range-partitioned and sorted by language, term, source and document (the batches'
   digest).  A scan of runs gives partial document frequencies and counts; as ranges also split equal terms,
   no term is ever one task's.  The partial rows of a run, at most one for each range it spans, are summed.
3. Terms in at least ``min_docs`` documents of their language are kept.  Each becomes one row with the shares of all
   sources of the language, in parts of a billion, and the scan of those emits, for each task, the partial sums of
   absolute differences of every two sources and the best terms of every source; both are merged at the end.

Shares are ``1 + floor(1e9 (count + 5) / (N + 5 V))`` in whole numbers, so results do not depend on order.
A term is a run of ASCII letters and code points from 128 on, with A-Z lower-cased.  Null text, language and source are
empty texts.  Repeated rows count as documents of their own; ids play no part.  A source without terms has N = 0; a
language without kept terms has pairs of value 0 and no terms.  An empty table gives an empty result.  Memory grows with
the sources of a language squared (as the result does) and with the longest text, not with documents or terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_buffer, tidied, words

BILLION = 1_000_000_000
HELD = 800_000  # rows that a task adds up before it hands them on
GROUPS = 20_000  # languages with sources up to this many are broadcast
_TERM = np.zeros(256, bool)
_TERM[128:] = _TERM[65:91] = _TERM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column, and the row of each."""
    data, offsets = text_buffer(col)
    start, end, row = words(data, offsets, _TERM)
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    kept = _LOWER[data[_TERM[data]]]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(kept)), row


_COUNTED = ["lang", "term", "source", "document", "docs", "n"]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows, mark = 0, 0
    for batch in batches:
        found = _counted(batch)
        if found is None:
            continue
        held.append(found)
        rows += len(found)
        mark = zlib.crc32(memoryview(text_buffer(batch.column("text"))[0]), mark)
        if rows > HELD:
            held = [_summed(held)]
            rows = len(held[0])
            if rows > HELD // 2:  # equal terms are few: on with them
                yield from _marked(held[0], mark)
                held, rows, mark = [], 0, 0
    if held:
        yield from _marked(_summed(held), mark)


def _summed(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    return pa.concat_tables(held).group_by(["lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(["lang", "term", "source", "docs", "n"])


def _marked(table: pa.Table, mark: int) -> Iterator[pa.RecordBatch]:
    table = table.append_column("document", pa.array(np.full(len(table), mark, np.int64))).select(_COUNTED)
    yield from table.to_batches(max_chunksize=1 << 16)


def _counted(batch: pa.RecordBatch) -> pa.Table | None:
    """``lang, term, source, docs, n`` of the documents of a batch."""
    terms, row = _terms(batch.column("text"))
    if not len(terms):
        return None
    coded = terms.dictionary_encode()
    group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    keys = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
    of_row = keys[0].indices.to_numpy().astype(np.int64) * len(keys[1].dictionary) + keys[1].indices.to_numpy()
    size = len(coded.dictionary)
    seen, n = np.unique(row.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)  # of each document, in order
    key = of_row[seen // size] * size + seen % size
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    place = group.take(pa.array((seen // size)[order][first]))
    term = coded.dictionary.take(pa.array(key[first] % size)).cast(pa.string())
    docs, total = np.diff(np.append(first, len(key))), np.add.reduceat(n[order], first)
    return pa.table([place.field("lang"), term, place.field("source"), pa.array(docs, pa.int64()), pa.array(total, pa.int64())], ["lang", "term", "source", "docs", "n"])


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each run of equal language, term and source in a batch, with sums."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = False
        for c in ("lang", "term", "source"):
            col = batch.column(c)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sums = [pa.array(np.add.reduceat(batch.column(c).to_numpy(), first)) for c in ("docs", "n")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in ("lang", "term", "source")), *sums], ["lang", "term", "source", "docs", "n"])


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, term, source, docs, n``: documents of a source that hold a term, and its occurrences there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    counted = materialize(map_arrow(rows, _count_batches, "lang string, term string, source string, document long, docs long, n long"), "batch-terms")
    keys = ["lang", "term", "source", "document"]
    runs = map_arrow(counted.repartitionByRange(*keys).sortWithinPartitions(*keys), _scan_runs, "lang string, term string, source string, docs long, n long")
    return runs.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    top, below = wide(F.lit(BILLION)) * wide(count + 5), wide(total + 5 * kept)
    return 1 + F.call_function("div", top, below)


def _compare(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``lang, term, p, n`` (lists over the language's sources) and ``q`` to partial pairs and terms of this task."""
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes, str]]] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy()
            for k in np.unique(code):
                lang = langs.dictionary[int(k)].as_py()
                some = batch.take(pa.array(np.flatnonzero(code == k)))
                p, n = (some.column(c).flatten().to_numpy().reshape(some.num_rows, -1) for c in ("p", "n"))
                over = np.where(n > 0, p - some.column("q").to_numpy()[:, None], 0)
                sums = pairs.setdefault(lang, np.zeros((p.shape[1], p.shape[1]), np.int64))
                for i in range(p.shape[1]):
                    sums[i] += np.abs(p - p[:, i : i + 1]).sum(axis=0)
                    hit = np.flatnonzero(over[:, i] > 0)
                    if len(hit) > limit:  # all that reach the limit-th value; ties are settled by term
                        hit = hit[over[hit, i] >= np.partition(over[hit, i], len(hit) - limit)[len(hit) - limit]]
                    if len(hit):
                        found = [(-int(over[j, i]), t.encode(), t) for j, t in zip(hit, some.column("term").take(pa.array(hit)).to_pylist(), strict=True)]
                        best[lang, i] = sorted(best.get((lang, i), []) + found)[:limit]
        rows = [(lang, i, "term", t, None, -v) for (lang, i), found in best.items() for v, _, t in found]
        for lang, sums in pairs.items():
            rows += [(lang, i, "pair", None, j, int(sums[i, j])) for i in range(len(sums)) for j in range(len(sums)) if i != j]
            if len(rows) > 1 << 16:
                yield _emitted(rows)
                rows = []
        if rows:
            yield _emitted(rows)

    return work


_PARTIAL = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("part", pa.string()), ("term", pa.string()), ("other", pa.int32()), ("value", pa.int64())])


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARTIAL.types, strict=True)], schema=_PARTIAL)


@tidied
def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 30, limit: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the distance of a source to each other of its language, part
    ``term`` the ``limit`` kept terms whose share is most above the language's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = materialize(term_counts(docs, text=text, lang=lang, source=source), "term-counts")
    # one row for each kept term: a list over the sources that hold it
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"))
    kept = materialize(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")

    held = kept.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct()
    groups = groups.join(held, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("size", F.lit(0)).alias("size")).alias("g"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups"), F.sum("g.size").alias("size"), F.count(F.lit(1)).alias("many"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = materialize(langs.join(terms, "lang", "left").fillna(0, ["v"]), "languages")
    few = (langs.agg(F.sum("many")).first()[0] or 0) <= GROUPS
    small = F.broadcast if few else (lambda df: df)

    n = F.transform("groups", lambda g: F.coalesce(F.try_element_at("by", g["source"]), F.lit(0)))
    rows = kept.join(small(langs.select("lang", "groups", "size", "v")), "lang").withColumn("counts", n)
    p = F.transform(F.arrays_zip("groups", "counts"), lambda x: _share(x["counts"], x["groups"]["size"], F.col("v")))
    rows = rows.select("lang", "term", p.alias("p"), F.col("counts").alias("n"), _share(F.col("total"), F.col("size"), F.col("v")).alias("q"))
    partial = materialize(map_arrow(rows, _compare(limit), "lang string, at int, part string, term string, other int, value long"), "partial")

    names = langs.select("lang", F.posexplode("groups").alias("at", "g")).select("lang", "at", F.col("g.source").alias("source"))
    others = names.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    summed = partial.filter("part = 'pair'").groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    pairs = small(names).join(others, "lang").filter("at <> other").join(summed, ["lang", "at", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    tops = partial.filter("part = 'term'").join(small(names), ["lang", "at"]).select("lang", "source", "part", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionAll(tops).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= limit))
