"""Token ids as Parquet list columns with delta or dictionary encoding, bounded row
groups and page indexes, and selective reads of them.

Texts are range-partitioned by document id, encoded inside Arrow batches and written by
Spark's Parquet writer, one sorted shard per partition.  Readers prune columns (metadata
without tokens), row groups and pages (by ``doc_id``).  Null texts are empty and hold
the end id only; a null id sorts first; rows that share an id follow each other ordered
by a digest of their text; columns other than the id and the text are not stored.  Each
row keeps its place in its shard in ids (``offset``), so starts never depend on how ties were ordered.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, map_arrow, prefix_hash, scratch_path, span_hash, sub_batches, text_buffer

END_ID = 2
CACHE = 800_000  # distinct pieces (about 60 bytes each) a worker remembers before it starts afresh; dropped when it does other work

# Classes of bytes for the vocabulary's own split into pieces, in text of ASCII and two-byte letters.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:256] = _LETTER
#: Bytes that send a row to the library as a whole: controls, the apostrophe (contractions), "<" (special
#: tokens may follow) and lead bytes of characters that are not letters from U+00C0 to U+027F.
_WHOLE = np.zeros(256, bool)
_WHOLE[0:9] = _WHOLE[14:32] = _WHOLE[0xCA:] = True
_WHOLE[[39, 60, 127, 0xC2]] = True


class _Grown:
    """An array that grows at its end by doubling."""

    def __init__(self, kind):
        self.room, self.n = np.empty(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            bigger = np.empty(max(2 * len(self.room), self.n + len(x)), self.room.dtype)
            bigger[: self.n] = self.room[: self.n]
            self.room = bigger
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans ``begin``, ``size`` of ``flat``, one after the other."""
    stop = np.cumsum(size)
    return flat[np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]


class PieceEncoder:
    """Ids of texts from a byte-level ``tokenizers`` file.

    The split into pieces does not depend on the vocabulary and a piece is encoded alike
    alone and in a text, so each distinct piece goes through the library once.  Known pieces are found
    by a hash and compared byte by byte; rows with anything unusual go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a task has one core: threads of the library's own only wait for each other (twice the CPU time for the same pieces)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known = [none, none]  # sorted hashes and their entries: most of them, and the latest
        self.n = 0
        self.begin, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32)
        self.byte_begin, self.byte_size, self.bytes = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint8)

    def _find(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of the pieces ``data[begin : begin + size]``, -1 where there is none with the same bytes."""
        out = np.full(len(hashes), -1, np.int64)
        for have, entry in self.known:
            if len(have):
                at = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
                out = np.where(have[at] == hashes, entry[at], out)
        hit = np.flatnonzero(out >= 0)
        out[hit[self.byte_size.room[out[hit]] != size[hit]]] = -1
        hit = hit[out[hit] >= 0]
        differs = _gather(data, begin[hit], size[hit]) != _gather(self.bytes.room, self.byte_begin.room[out[hit]], size[hit])
        out[np.repeat(hit, size[hit])[differs]] = -1
        return out

    def _learn(self, hashes: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New entries for pieces; of pieces with one hash only the first is found again later."""
        raw = data.tobytes()
        pieces = [raw[a : a + n].decode() for a, n in zip(begin.tolist(), size.tolist())]
        got = [x.ids for at in range(0, len(pieces), 4096) for x in self.tokenizer.encode_batch(pieces[at : at + 4096], add_special_tokens=False)]
        lengths = np.array([len(x) for x in got], np.int32)
        self.begin.add(self.ids.n + np.cumsum(lengths, dtype=np.int64) - lengths)
        self.size.add(lengths)
        self.ids.add(np.fromiter((i for x in got for i in x), np.int32, int(lengths.sum())))
        self.byte_begin.add(self.bytes.n + np.cumsum(size) - size)
        self.byte_size.add(size)
        self.bytes.add(_gather(data, begin, size))
        entry = np.arange(self.n, self.n + len(pieces))
        self.n += len(pieces)
        fresh = np.zeros(len(hashes), bool)
        fresh[np.unique(hashes, return_index=True)[1]] = True
        for have, _ in self.known:
            if len(have):
                fresh &= have[np.minimum(np.searchsorted(have, hashes), len(have) - 1)] != hashes
        late = np.append(self.known[1][0], hashes[fresh]), np.append(self.known[1][1], entry[fresh].astype(np.int32))
        self.known[1] = tuple(x[np.argsort(late[0])] for x in late)
        if len(late[0]) > len(self.known[0][0]) // 4:  # merge now and then, not each time
            both = [np.append(a, b) for a, b in zip(*self.known)]
            order = np.argsort(both[0])
            self.known = [tuple(x[order] for x in both), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        return entry

    def encode_rows(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end_id`` after each row, and the number of ids of each row."""
        data, offsets = text_buffer(col)
        n = len(offsets) - 1
        odd = _WHOLE[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs for times and divided by
        whole = np.zeros(n, bool)
        whole[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        start, end = _pieces(data, offsets)
        row = np.searchsorted(offsets, start, side="right") - 1
        # equal pieces by their bytes: the pieces tile the buffer, so its bounds are the offsets of an Arrow array
        tiles = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        back = tiles.indices.to_numpy(zero_copy_only=False)
        keep = ~whole[row]
        back, row = back[keep], row[keep]
        distinct, bounds = text_buffer(tiles.dictionary)
        used = np.zeros(len(bounds) - 1, bool)
        used[back] = True
        used = np.flatnonzero(used)
        begin, size = bounds[used], np.diff(bounds)[used]
        if self.n + len(used) > CACHE:
            self._forget()
        hashes = span_hash(prefix_hash(distinct), begin, begin + size)
        entry = self._find(hashes, distinct, begin, size)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._learn(hashes[new], distinct, begin[new], size[new])
        place = np.zeros(len(bounds) - 1, np.int64)
        place[used] = entry
        entry = place[back]
        size, begin = self.size.room[entry].astype(np.int64), self.begin.room[entry]
        # the end id is a piece of one id after each row's pieces
        per_row = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        others = {int(i): self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in zip(np.flatnonzero(whole), col.take(pa.array(np.flatnonzero(whole))).to_pylist())}
        for i, ids in others.items():
            per_row[i] = len(ids)
        stop = np.cumsum(per_row + 1)
        out = np.empty(int(stop[-1]) if n else 0, np.int32)
        if len(size):
            ends = np.cumsum(size)
            seq = np.arange(int(ends[-1]))
            shift = (stop - 1 - per_row) - (np.cumsum(np.where(whole, 0, per_row)) - np.where(whole, 0, per_row))
            out[np.repeat(shift[row], size) + seq] = _gather(self.ids.room, begin, size)
        for i, ids in others.items():
            out[stop[i] - 1 - per_row[i] : stop[i] - 1] = ids
        out[stop - 1] = end_id
        return out, per_row + 1


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pieces: a run of letters, digits or other signs with the blank before
    it; of a run of white space before one, all but the last character, and that character
    by itself unless it is such a blank; white space at a row's end whole."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[rows] = True
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(data))
    last_of_row = np.zeros(len(data) + 1, bool)
    last_of_row[offsets[1:]] = True
    split = (kind[start] == _SPACE) & ~last_of_row[stop]  # white space that something follows in its row
    tail = stop[split] - 1  # its last character starts a piece of its own or joins what follows
    begins[tail] = True
    begins[tail[data[tail] == 32] + 1] = False
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    encoding: str = "delta", row_group_bytes: int = 32 << 20, page_rows: int = 2000, shards: int | None = None,
) -> None:
    """Encode ``docs`` and write shards in ascending ``doc_id`` order.

    ``encoding``: "delta" (Parquet v2, DELTA_BINARY_PACKED ids) or "dictionary".
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions(*keys).withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written = held(f"tokens {tokenizer}", lambda: PieceEncoder(tokenizer)), 0
        for batch in batches:
            for part in sub_batches(batch, most=1 << 20):
                flat, sizes = encoder.encode_rows(part.column("text"), end_id)
                at = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("shard"), pa.array(at[:-1] + written), pa.array(sizes.astype(np.int32)), tokens], ["doc_id", "shard", "offset", "n_tokens", "tokens"]
                )
                written += int(at[-1])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = map_arrow(rows, encode, f"doc_id {kind}, shard int, offset long, n_tokens int, tokens array<int>", keeps=f"tokens {tokenizer}")
    (
        out.write.option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Token rows, optionally of ids from ``low`` to ``high`` (row groups and pages are
    skipped by their statistics)."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Metadata only: the token column is not read."""
    return spark.read.parquet(path).select("doc_id", "shard", "n_tokens")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``start`` (ids before it), ``n_tokens``, ``ids_crc32``.

    A start is the row's place in its shard plus the totals of the shards before; that sum
    is over one row per shard."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            raw = flat.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.parquet(path).select("doc_id", "shard", "offset", "tokens")
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(stored, check, f"doc_id {kind}, shard int, offset long, n_tokens long, ids_crc32 long")
    totals = read_lengths(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(
        "shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to the shared folder and index what was written."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return token_index(docs.sparkSession, path)
