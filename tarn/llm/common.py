"""Shared helpers: scratch tables in the shared folder, connected components and
numpy kernels that shingle whole Arrow batches at once."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# ------------------------------------------------------------------ storage
def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a local
    master gets one of its own (tests); on a cluster it is an error, as executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tarn-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tarn-{name}-{uuid.uuid4().hex}"


_recorders: list[list[str]] = []


@contextmanager
def recording(made: list[str]) -> Iterator[list[str]]:
    """Paths of the tables that are materialized meanwhile are added to ``made``."""
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [x for x in _recorders if x is not made]


def discard(made: list[str], unless: DataFrame) -> None:
    """Delete the tables ``made`` that ``unless`` does not read; those it reads stay in the list."""
    read = {part for f in unless.inputFiles() for part in f.split("/")}
    gone = [p for p in made if p.rsplit("/", 1)[-1] not in read]
    made[:] = [p for p in made if p not in gone]
    spark = unless.sparkSession
    for p in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose intermediate tables are deleted as soon as it returns, but for those its result reads."""

    @wraps(operator)
    def run(*args, **options) -> DataFrame:
        with recording([]) as made:
            out = operator(*args, **options)
        discard(made, unless=out)
        return out

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that later
    jobs neither recompute it nor depend on any executor's disk."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    for made in _recorders:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------ Python workers
ARROW_BYTES = 4 << 20  # of an Arrow batch, so that rows of any length cost a worker and its JVM a few times this
_held: dict[str, object] = {}  # what this worker keeps from task to task, by name


def held(name: str, make: Callable[[], object]) -> object:
    """The object ``name`` of this worker, made once; it lasts until another kernel starts here."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def _begin(keeps: str | None) -> None:
    for name in [n for n in _held if n != keeps]:
        del _held[name]


def _end() -> None:
    """Freed memory goes back to the system, so that idle workers are small."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def relieve(spark: SparkSession) -> None:
    """Plans that nothing refers to any more, with their broadcasts and shuffles, and freed memory are let go of on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _end()


def map_arrow(rows: DataFrame, work: Callable, schema, keeps: str | None = None) -> DataFrame:
    """``rows.mapInArrow`` in batches of at most ARROW_BYTES (a session setting; a row is never cut).  A task first
    drops what other kernels left in its worker, but for ``keeps``, and gives freed memory back at its end."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keeps)
        try:
            yield from work(batches)
        finally:
            _end()

    return rows.mapInArrow(kernel, schema)


# -------------------------------------------------------------------- graphs
def _digest(pairs: DataFrame) -> tuple:
    """Count and order-free hash of distinct rows, to tell two sets apart in one scan."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id of each component, by alternating large-star and small-star.

    ``edges`` has long columns ``a``, ``b``; the result has ``node``, ``comp`` for every
    node with an edge to another node.  Each round is one grouped minimum and one join
    and is written to the shared folder; only a digest of it reaches the driver.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "cc")
    digest = _digest(pairs)
    for _ in range(max_rounds):
        if not digest[0]:
            break
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        )
        pairs = materialize(small.filter("u <> v").distinct(), "cc")
        before, digest = digest, _digest(pairs)
        if digest == before:
            break
    else:
        if digest[0]:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(tops)


# ------------------------------------------------------------- numpy kernels
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n+1 row offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(col) else np.zeros(1, np.int64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[e]-H[s] = sum of byte * P**position over data[s:e], modulo 2**64."""
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("p", _P, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], independent of the position; long structured strings may collide (:func:`word_hash`)."""
    raw = (h[end] - h[start]) * _power("i", _P_INV, len(h))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PRIME, _P31 = np.uint64((1 << 31) - 1), 0x3C6EF372  # a Mersenne prime, and a base below it
_P31_INV = pow(_P31, -1, int(_PRIME))


def _mod_prime(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, _mod_prime(have * np.uint64(pow(base, len(have), int(_PRIME))))])
        _powers[kind] = have
    return have[:n]


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] from sums modulo 2**64 and modulo a prime: structured strings that
    collide in the first (whatever its base) do not in the second."""
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(_mod_prime((data.astype(np.uint64) + np.uint64(1)) * _prime_power("q", _P31, len(data))), out=h[1:])
    other = _mod_prime(_mod_prime(h[end] - h[start]) * _prime_power("r", _P31_INV, len(h))[start])
    return mix(span_hash(prefix_hash(data), start, end) ^ (other * np.uint64(0x9E3779B97F4A7C15)))


def gram_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` bytes in a row from the prefix hash, by slices only."""
    raw = h[width:] - h[:-width]
    raw *= _power("i", _P_INV, len(h))[: len(raw)]
    raw *= np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    raw ^= raw >> np.uint64(32)
    raw *= np.uint64(0xBF58476D1CE4E5B9)
    return raw


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``inside`` marks bytes of words (default: no white space)."""
    if inside is None:
        inside = ~_SPACE
    mark = np.zeros(len(data) + 2, bool)
    mark[1:-1] = inside[data]
    begins = mark[1:] & ~mark[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a row's first byte starts a word even if the row before ended in one
    begins[first] |= mark[1:][first]
    stops = mark[:-1] & ~mark[1:]
    cut = first[(first > 0)]
    stops[cut] |= mark[:-1][cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``width``-word shingle, in order.  A row with 1 to width-1
    words has one shingle of all its words; one without words has none."""
    start, end, row = words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = word_hash(data, start, end)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    take = np.arange(len(w))
    left = n[row] - (take - first[row])  # words from here to the row's end
    use = (left >= width) | ((n[row] < width) & (take == first[row]))
    at = take[use]
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        ok = left[at] > j
        out = mix(out * np.uint64(0xD1342543DE82EF95) + np.where(ok, w[np.minimum(at + j, len(w) - 1)], np.uint64(j)))
    return out, row[at]


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sub_batches(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 19):
    """Slices of ``batch`` whose ``name`` column holds about ``most`` bytes at most (one row at least)."""
    size = np.frombuffer(text_buffer(batch.column(name))[1], np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
