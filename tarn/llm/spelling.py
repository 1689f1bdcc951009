"""Spelling variants of the words of a corpus by a symmetric-delete join.

1. Words are counted by Arrow batch where the texts lie, then summed.
2. Every word emits itself and its distinct single deletions as 64-bit keys; words that share a key are
   candidates (an equi-join).  Two words at distance one always share one: the shorter word itself, or what both are
   without the replaced letter.  A key has at most one row for each letter and place, so no key is hot.
3. Candidates are verified: distance exactly one, on the words themselves.
4. A word's form is its near word with the largest count, if that is ``ratio`` times its own; roots are found by
   joining forms to forms until nothing changes (counts grow by ``ratio`` a step, so the chains are short and have no rings).

A run is made of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased.  One run in ``typo`` (by the CRC of id and run) loses
a letter, which plants variants in a corpus; ``typo=0`` leaves texts as they are.  Null texts have no words; a null id is an
empty text.  Repeated rows count again; an empty table gives an empty result.  Words longer than LONG letters travel as
digests and are fetched for verification only, so a word's rows grow with its length, not with its square.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P_INV, _power, as_signed, map_arrow, materialize, mix, prefix_hash, sub_batches, text_buffer, tidied

LONG = 100
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the usual reflected polynomial
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and letters of the runs.  In UTF-8 the letters beyond ASCII are 0xC3 and any one byte more."""
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _ASCII[data] | lead | tail
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # texts end runs
    begins, stops = inside[1:] & (~inside[:-1] | cut), inside[:-1] & (~inside[1:] | cut)
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    letters = np.concatenate([[0], np.cumsum(~tail)])
    return start, end, np.searchsorted(offsets, start, side="right") - 1, letters[end] - letters[start]


def _crc(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] carried on from the CRC ``state`` of what stands before."""
    state = ~state.astype(np.uint32)
    order = np.argsort(start - end, kind="stable")  # longest first: those that go on are a prefix
    state, at, left = state[order], start[order], (start - end)[order]
    for i in range(-int(left[0]) if len(left) else 0):
        on = np.searchsorted(left, -i, side="left")  # those with more than i bytes
        state[:on] = _CRC[(state[:on] ^ data[at[:on] + i]) & 0xFF] ^ (state[:on] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _counted(typo: int, least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, most=2 << 20):
                data, offsets = text_buffer(part.column("text"))
                data = _LOWER[data]
                start, end, row, size = _runs(data, offsets)
                some = size >= least
                start, end, row, size = start[some], end[some], row[some], size[some]
                if not len(start):
                    continue
                slips = np.zeros(len(start), bool)
                if typo:
                    seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column("id").to_pylist()], np.uint32)
                    crc = _crc(seeds[row], data, start, end)
                    slips = crc % np.uint32(typo) == 0
                whole = np.flatnonzero(~slips)
                bounds = np.concatenate([[0], np.cumsum((end - start)[whole])]).astype(np.int64)
                at = np.repeat(start[whole] - bounds[:-1], (end - start)[whole]) + np.arange(bounds[-1])
                found = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(bounds), pa.py_buffer(data[at]))
                short = []
                for i in np.flatnonzero(slips):
                    if size[i] > least:
                        run = data[start[i] : end[i]].tobytes().decode()
                        k = int(crc[i]) % len(run)
                        short.append(run[:k] + run[k + 1 :])
                found = pa.chunked_array([found, pa.array(short, pa.large_string())]).combine_chunks()
                counts = found.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])

    return work


def words_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 7, at_least: int = 2, typo: int = 31) -> DataFrame:
    """``word, n``: words of at least ``least`` letters that occur ``at_least`` times or more."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counts = map_arrow(rows, _counted(typo, least), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, word, n, size``: a word by itself and by its distinct single deletions."""
    for batch in batches:
        for part in sub_batches(batch, "word", 1 << 18):
            text = [w.encode("latin-1") for w in part.column("word").to_pylist()]  # one byte for each letter
            size = np.array([len(w) for w in text], np.int64)
            data = np.frombuffer(b"".join(text), np.uint8)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            h = prefix_hash(data)
            scale = _power("i", _P_INV, len(h))
            of = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(data))
            # a deletion is the part before it and the part behind it, moved up by one
            value = (h[at] - h[begin[of]]) + (h[(begin + size)[of]] - h[at + 1]) * _P_INV
            new = np.ones(len(data), bool)
            new[1:] = (data[1:] != data[:-1]) | (of[1:] != of[:-1])  # within a row of equal letters all deletions are the same text
            row = np.concatenate([np.arange(len(size)), of[new]])
            value = np.concatenate([h[begin + size] - h[begin], value[new]]) * scale[begin[row]]
            length = size[row] - np.concatenate([np.zeros(len(size), np.int64), np.ones(int(new.sum()), np.int64)])
            key = mix(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), part.column("name").take(pick), part.column("n").take(pick)], ["key", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: all pairs of different words at distance one, both ways round."""
    name = F.when(F.length("word") > LONG, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word"))
    named = words.select("word", name.alias("name"), "n")
    keys = materialize(map_arrow(named, _emitted, "key long, word string, n long"), "word-keys")
    pairs = keys.join(keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key").filter("word < other").drop("key")
    short = ~F.col("word").startswith("#") & ~F.col("other").startswith("#")
    near = pairs.filter(short & (F.levenshtein("word", "other", 1) == 1))
    # words that travel as digests: their pairs are few and distinct before the words are fetched
    long = named.filter(F.length("word") > LONG).select("name", F.col("word").alias("text"))
    far = pairs.filter(~short).distinct()
    for c in ("word", "other"):
        far = far.join(long.withColumnsRenamed({"name": c, "text": f"{c}_text"}), c, "left").withColumn(c, F.coalesce(f"{c}_text", c)).drop(f"{c}_text")
    far = far.filter(F.levenshtein("word", "other", 1) == 1)
    both = near.unionByName(far).distinct()
    return both.unionAll(both.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``word, root`` from ``word, form``: where following forms ends.  Each round joins the roots with themselves, so a chain is
    halved; a round is written to the shared folder."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found
    raise RuntimeError(f"forms still lead on after {max_rounds} rounds")


@tidied
def group_spellings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 7, at_least: int = 2, ratio: int = 10, typo: int = 31) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word: the number of near words, the form it is a variant of (null if
    none) and the root that forms lead to (itself without one)."""
    words = materialize(words_of(docs, doc_id=doc_id, text=text, least=least, at_least=at_least, typo=typo), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select("word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n"))
    rows = materialize(rows, "near-words")
    led = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
