"""Exact removal of bytes covered by strings of ``LENGTH`` bytes that start in two places.

1. Reduction, exact: every window of LENGTH bytes is filed under its smallest hash of
   ``GRAM`` bytes, so equal windows are filed alike.  Runs of windows with the same smallest
   gram are segments (about 1 in 85 bytes starts one).  A value of one segment is no repeat.
   Of segments with equal bytes every window is repeated.  Only values with several
   different segments need their bytes, one copy of each different segment; these are
   filed again under a second hash, which leaves the groups that are merged small.  A group that
   is still larger than ``group_bytes`` is filed under a third, and so on; only what all TURNS
   hashes leave together is merged in one worker whatever its size.
2. Merge of Burrows-Wheeler transforms: the segments of a task are cut into shards, each
   shard gets its transform, and the transforms are merged by iterative interleave
   refinement: in each round the merged order by h symbols follows from the order by h - 1
   and the transforms alone, and so do the block bounds, that is where common prefixes end.
   A symbol is SYMBOL bytes at every offset, so LENGTH / SYMBOL rounds find all blocks of
   suffixes that agree in LENGTH bytes; blocks of two or more are the repeated windows.
3. Repeated windows become byte ranges of their documents, and what is left is digested.

Null texts are empty; matches never cross rows; a row with a null id takes part like any
other; rows that share an id are told apart by their text (rows equal in both are
copies of one another and so repeat).  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_signed, gram_hash, map_arrow, materialize, mix, prefix_hash, span_hash, sub_batches, text_buffer, tidied

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # grams of a window
SYMBOL = 20  # bytes of a symbol of the transforms
SHARD_BYTES, BATCH_BYTES = 256 << 10, 1 << 20
GROUP_BYTES, TURNS = 2 << 20, 6  # of a group that a worker merges, before it is filed by a further hash; hashes there are


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that has one, by block prefixes and suffixes."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Value, row, start in the row, windows and content digest (cryptographic) of every segment of a batch: the
    runs of windows whose smallest gram (the leftmost of equals) is the same one.  Equal
    windows have the same value and, if they overlap, lie in different segments."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    h = prefix_hash(data)
    gram = gram_hash(h, GRAM, seed)
    bits = np.uint64(max(22, len(gram).bit_length()))
    place = np.arange(len(gram), dtype=np.uint64)
    least = _sliding_min((gram >> bits << bits) | place, SPAN) & ((np.uint64(1) << bits) - np.uint64(1))
    open_ = np.zeros(len(data) + 1, np.int32)  # windows that end in their row
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    open_[offsets[:-1][long]] = 1
    open_[offsets[1:][long] - LENGTH + 1] = -1
    valid = np.cumsum(open_[: len(least)], dtype=np.int32) > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[offsets[:-1][long]] = True
    stops = valid.copy()
    stops[:-1] &= begins[1:] | ~valid[1:]
    run = np.flatnonzero(begins)
    size = np.flatnonzero(stops) - run + 1
    row = np.searchsorted(offsets, run, side="right") - 1
    raw, ends = data.tobytes(), (run + size + LENGTH - 1).tolist()
    content = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(run.tolist(), ends))
    return gram[least[run].astype(np.int64)], row, run - offsets[:-1][row], size, np.frombuffer(content, np.uint64)


def _sorted(rank: np.ndarray, high: int) -> np.ndarray:
    """Stable order of non-negative numbers up to ``high``, 16 bits at a time (radix sorts)."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while high >> shift:
        order = order[np.argsort(((rank >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def transform(symbols: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard of strings over symbols >= 1 (0 ends a string), and the
    position in ``symbols`` (ends included) of every suffix, in order by ``depth`` symbols at least."""
    text, strings = symbols, len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    rank = text.astype(np.int64) + strings  # ends get ranks of their own, so order by string
    rank[ends] = np.arange(strings)
    step = 1
    while True:
        ahead = np.zeros(len(text), np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(text), bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
        if new.all() or step > depth:
            break
    before = np.roll(text, 1)
    before[ends - sizes] = 0
    return before[order], order


def merge(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms ``shards`` by the first ``depth`` symbols of the suffixes.

    Returns the shard of each merged suffix, and bounds: True where a suffix's first ``depth``
    symbols differ from those of the one before.  A round extends the order by one symbol in
    front: suffixes keep their order within the bucket of the symbol before them."""
    z = np.repeat(np.arange(len(shards), dtype=np.int16), [len(s) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.int16), [int((s == 0).sum()) for s in shards])
    high = max(int(s.max()) for s in shards)
    bounds = np.zeros(len(z), bool)
    bounds[0] = True
    symbols = np.empty(len(z), np.int32)
    for _ in range(depth):
        for i, s in enumerate(shards):
            symbols[z == i] = s
        order = _sorted(symbols, high)
        block, symbol = np.cumsum(bounds, dtype=np.int32)[order], symbols[order]
        merged = z[order]
        merged[: len(ends)] = ends  # ends sort by shard and string, whatever comes before them
        new = np.ones(len(z), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        new[: len(ends) + 1] = True
        z, bounds = merged, new
        if bounds.all():
            break
    return z, bounds


def repeated_windows(strings: list[bytes], shard_bytes: int = SHARD_BYTES, length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes start in two places of the collection.

    Symbols are groups of ``symbol`` bytes (a divisor of ``length``), so a string gives one symbol
    string for each of its first ``symbol`` offsets and a window is length / symbol symbols."""
    size = np.array([len(s) for s in strings], np.int64)
    out = [np.zeros(max(0, n - length + 1), bool) for n in size.tolist()]
    data = np.frombuffer(b"".join(strings), np.uint8)
    if len(data) < length:
        return out
    begin = np.cumsum(size) - size
    group = span_hash(prefix_hash(data), np.arange(len(data) - symbol + 1), np.arange(symbol, len(data) + 1))
    names = pd.factorize(group)[0].astype(np.int32) + np.int32(1)
    del group
    # a window with a group that starts nowhere else is no repeat: only runs of the other windows are sorted
    lone = np.concatenate([[0], np.cumsum(np.bincount(names)[names] == 1)])
    inside = np.zeros(len(data) + 1, np.int32)
    inside[begin[size >= length]] = 1
    inside[(begin + size)[size >= length] - length + 1] = -1
    n_starts = len(data) - length + 1
    maybe = (np.cumsum(inside[:n_starts]) > 0) & (lone[length - symbol + 1 :] == lone[:n_starts])
    runs = np.array(_ranges(maybe), np.int64).reshape(-1, 2)
    del lone, inside, maybe
    if not len(runs):
        return out
    run, run_size = runs[:, 0], runs[:, 1] - runs[:, 0] + length - 1
    # symbol strings: (run, phase), each with the positions phase, phase + symbol, ...
    which, phase = np.repeat(np.arange(len(runs)), symbol), np.tile(np.arange(symbol), len(runs))
    count = np.maximum(0, (run_size[which] - phase) // symbol)
    which, phase, count = which[count > 0], phase[count > 0], count[count > 0]
    stop = np.cumsum(count + 1)
    inner = np.arange(int(stop[-1]), dtype=np.int32) - np.repeat((stop - count - 1).astype(np.int32), count + 1)
    place = np.repeat((run[which] + phase).astype(np.int32), count + 1) + inner * np.int32(symbol)
    del inner
    end = np.zeros(len(place), bool)
    end[stop - 1] = True
    text = np.where(end, 0, names[np.minimum(place, len(names) - 1)])
    # shards of whole symbol strings
    cuts = np.unique(np.r_[0, np.searchsorted(stop, np.arange(shard_bytes, int(stop[-1]), shard_bytes), side="left") + 1, len(stop)])
    cuts = cuts[cuts <= len(stop)]
    edge = np.r_[0, stop][cuts]
    parts = [transform(text[a:b], count[i:j], length // symbol) for a, b, i, j in zip(edge[:-1], edge[1:], cuts[:-1], cuts[1:])]
    z, bounds = merge([p[0] for p in parts], length // symbol)
    at = np.empty(len(z), np.int64)
    for i, (_, order) in enumerate(parts):
        at[z == i] = order + edge[i]
    hit = at[~(bounds & np.append(bounds[1:], True))]
    flag = np.zeros(len(data) + 1, bool)
    flag[place[hit[~end[hit]]]] = True
    for i, (b, n) in enumerate(zip(begin.tolist(), size.tolist())):
        out[i][:] = flag[b : b + len(out[i])]
    return out


def _ranges(mark: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _file(rows: DataFrame) -> DataFrame:
    """Segments of ``doc_id, tag, text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                value, row, start, size, content = segments(*text_buffer(part.column("text")))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("tag").take(take), pa.array(as_signed(value)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(as_signed(content))],
                    ["doc_id", "tag", "v", "start", "size", "content"],
                )

    return map_arrow(rows, work, "doc_id long, tag long, v long, start int, size int, content long")


PIECES = "f long, v long, content long, shift int, piece binary"


def _cut(texts: DataFrame) -> DataFrame:
    """Bytes of the wanted segments of ``text``, filed again by a second hash so that groups get smaller."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, keys = [], []
            for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                raw = text.encode()
                for w in wanted:
                    held.append(raw[w["start"] : w["start"] + w["size"] + LENGTH - 1])
                    keys.append((w["v"], w["v"], w["content"], 0))
                if sum(map(len, held)) >= BATCH_BYTES or i + 1 == batch.num_rows:
                    if held:
                        yield _refile(held, keys, 1)
                    held, keys = [], []

    return map_arrow(texts, work, PIECES)


def _finer(pieces: DataFrame, turn: int) -> DataFrame:
    """``pieces`` filed again by one more hash, within the groups they are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, v, content, shift, piece = (batch.column(i).to_pylist() for i in range(5))
            yield _refile(piece, list(zip(f, v, content, shift)), turn)

    return map_arrow(pieces, work, PIECES)


def _refile(held: list[bytes], keys: list[tuple[int, int, int, int]], turn: int) -> pa.RecordBatch:
    """Pieces of ``held`` by hash number ``turn``; ``keys``: group, value, content and shift of each."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    value, row, start, size, _ = segments(np.frombuffer(b"".join(held), np.uint8), offsets, seed=turn * 0x5BD1E995)
    f, v, c, shift = (np.array(k, np.int64)[row] for k in zip(*keys))
    f = as_signed(mix(value + f.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    pieces = [held[r][a : a + n + LENGTH - 1] for r, a, n in zip(row.tolist(), start.tolist(), size.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(f), pa.array(v), pa.array(c), pa.array((shift + start).astype(np.int32)), pa.array(pieces, pa.binary())], [x.split()[0] for x in PIECES.split(", ")])


def _merge_pieces(pieces: DataFrame, most: float) -> DataFrame:
    """Repeated windows of the pieces, as ranges ``a, b`` of window starts of their segments (``piece`` is null); groups of
    more than ``most`` bytes are handed on as they are, so that no worker holds more of one."""
    names = ["f", "v", "content", "a", "b", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    out_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (f, v, c, shift, _), mark in zip(rows, repeated_windows([r[4] for r in rows])):
            out += [(f, v, c, shift + a, shift + b, None) for a, b in _ranges(mark)]
        return out_of(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size, group, held, late = [], 0, [], 0, []
        name = None  # of the group at hand; its pieces are in ``group``, or in ``late`` once they are too many

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != name:
                    if len(group) > 1:
                        ready += group
                        size += held
                        if size >= BATCH_BYTES:
                            yield solve(ready)
                            ready, size = [], 0
                    name, group, held = row[0], [], 0
                held += len(row[4])
                if held <= most:
                    group.append(row)
                else:
                    late += [(f, v, c, shift, None, piece) for f, v, c, shift, piece in (*group, row)]
                    group = []
            if late:
                yield out_of(late)
                late = []
        if len(group) > 1:
            ready += group
        if ready:
            yield solve(ready)

    return map_arrow(pieces.repartition("f").sortWithinPartitions("f"), work, "f long, v long, content long, a int, b int, piece binary")


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", group_bytes: float = GROUP_BYTES) -> DataFrame:
    """``doc_id, tag, a, b``: byte ranges covered by repeated windows (``tag`` hashes the text)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    rows = rows.filter(F.octet_length("text") >= LENGTH)
    filed = materialize(_file(rows), "segments")
    values = filed.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    # written, so that the join with it is a plain one, which adaptive execution splits where a value is frequent
    values = materialize(values.filter("n > 1").select("v", (F.col("low") == F.col("high")).alias("alike")), "repeated-values")
    shared = materialize(filed.join(values, "v"), "shared-segments")
    mixed = shared.filter("not alike")
    copies = mixed.groupBy("v", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tag", "start", "size")).alias("one"))
    copies = materialize(copies, "different-segments")
    wanted = copies.select("one.doc_id", "one.tag", F.struct("one.start", "one.size", "v", "content").alias("w"))
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list("w").alias("wanted"))
    pieces, merged = _cut(_by_row(rows, wanted, "inner").select("text", "wanted")), None
    for turn in range(2, TURNS + 1):
        done = materialize(_merge_pieces(pieces, group_bytes if turn < TURNS else float("inf")), "repeated-windows")
        windows = done.filter("piece is null").select("v", "content", "a", "b")
        merged = windows if merged is None else merged.unionAll(windows)
        large = done.filter("piece is not null").select("f", "v", "content", F.col("a").alias("shift"), "piece")
        if turn == TURNS or large.isEmpty():
            break
        pieces = _finer(large, turn)

    whole = shared.filter("alike").select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("size") + LENGTH - 1).alias("b"))
    again = copies.filter("n > 1").select("v", "content")
    again = mixed.join(again, ["v", "content"], "left_semi").select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("size") + LENGTH - 1).alias("b"))
    part = mixed.join(merged, ["v", "content"]).select("doc_id", "tag", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b") + LENGTH - 1).alias("b"))
    return whole.unionAll(again).unionAll(part)


def _by_row(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    o = other.withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    return rows.join(o, rows["doc_id"].eqNullSafe(o["_doc"]) & (rows["tag"] == o["_tag"]), how).drop("_doc", "_tag")


@tidied
def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", group_bytes: float = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept`` (the bytes left) of every row."""
    found = find_repeats(docs, doc_id=doc_id, text=text, group_bytes=group_bytes)
    lists = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))  # equal rows give the same ranges
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    joined = _by_row(rows, lists, "left").select("doc_id", "text", "ranges")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                out = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                    raw, spans = text.encode(), []
                    for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1])
                        else:
                            spans.append([*r])
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    left = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(left), len(spans), spans, hashlib.sha256(left).hexdigest(), left))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", *names])

    out = map_arrow(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
