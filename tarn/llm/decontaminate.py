"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

A window of a document, as many words long as a benchmark item, is contaminated when its
weighted five-word-shingle similarity to the item (sum of minimum over sum of maximum
counts) reaches ``threshold``.  A document shorter than the item is one window, whole.

1. Which windows are worth a fingerprint: one at the threshold shares a shingle with its
   item, so windows are opened around positions that hold the shingle of any item of their
   size.  Which item that is plays no part.  The shingles of the items are broadcast while
   there are ``broadcast_rows`` of them at most; beyond, positions alone (no words) are joined
   with them by hash and the texts with hits are read again.
2. Candidates.  Windows and items get 64-bit SimHashes over words and word pairs.  Multi-index
   search: the fingerprint is cut into ``BLOCKS`` blocks; two fingerprints within ``RADIUS`` bits
   differ in at most RADIUS // BLOCKS = 2 bits of some block, so every item is filed under all block
   values within that distance (380 in all) and every window looks up its own six block values.  This finds
   all pairs within the radius; of unrelated pairs about a fifth meet in some block.  A word changed within a
   window of n words moves about 3 of its 2n - 1 features; the edits that 0.8 leaves room for turn 5 to 8 bits on
   average (spread 2.5), so a pair at just 0.8 lies beyond 17 bits with a probability of about 1e-4.
   A window shorter than its item is not sought by bits, as the words it lacks move it
   further: it needs threshold times the item's shingles, so of its own shingles, taken by the
   number of items that hold them, one of the first (its count less that need, plus one)
   is the item's; it is paired with the items that hold any of those.  That is exact.
3. The similarity of the pairs found is computed exactly.

Words are lower-cased runs of non-white-space.  Items of fewer than five words use one
shingle of all their words; items without words match nothing.  Null texts are empty.
Items are told apart by a digest of their words, so items that share an id or have none are all sought, and
repeated items keep their own ids.  Texts are told apart by a digest, so equal texts are searched
once, and rows that share an id or have none are all judged; the result has one row for each
id (or null) and item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidied

BLOCKS, RADIUS = 6, 17
_EDGES = [0, 11, 22, 33, 44, 54, 64]  # five of the blocks could be one bit wider; the first four are
BROADCAST_ROWS = 2_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingle(hashes: str, at: str, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(hashes), F.col(at) + j) for j in range(k)])


def _fingerprint(bits_of: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of each group ``keys`` from rows with a feature hash ``f``."""
    sums = [F.sum((F.shiftright("f", j).bitwiseAND(F.lit(1)) * 2 - 1).cast("int")).alias(f"b{j}") for j in range(64)]
    summed = bits_of.groupBy(*keys).agg(*sums)
    one = [F.when(F.col(f"b{j}") > 0, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")) for j in range(64)]
    value = one[0]
    for x in one[1:]:
        value = value.bitwiseOR(x)
    return summed.select(*keys, value.alias("fp"))


def _block(fp: Column, b: int) -> Column:
    width = _EDGES[b + 1] - _EDGES[b]
    return F.shiftrightunsigned(fp, _EDGES[b]).bitwiseAND(F.lit((1 << width) - 1))


def _near_values(fp: Column, b: int) -> Column:
    """All values of block ``b`` within RADIUS // BLOCKS bits."""
    bits = [1 << i for i in range(_EDGES[b + 1] - _EDGES[b])]
    masks = [0]
    for _ in range(RADIUS // BLOCKS):
        masks = sorted({m | x for m in masks for x in [0, *bits]})
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: _block(fp, b).bitwiseXOR(m))


def _features(rows: DataFrame, keys: list[str], hashes: str, start: str, n: str) -> DataFrame:
    """Feature hashes, one row each: every word and every pair of neighbours of the window."""
    rows = rows.select(*keys, hashes, n, start, F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1)).alias("_i"))
    single, pair = F.xxhash64(F.get(hashes, F.col("_i"))), F.xxhash64(F.get(hashes, F.col("_i")), F.get(hashes, F.col("_i") + 1))
    last = F.col("_i") == F.col(start) + F.col(n) - 1
    return rows.select(*keys, F.explode(F.when(last, F.array(single)).otherwise(F.array(single, pair))).alias("f"))


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _hashes(text: str) -> Column:
    return F.transform(_words(F.col(text)), lambda w: F.xxhash64(w))


def _by_k(rows: DataFrame, sizes: list[int], part) -> DataFrame:
    out = part(rows, sizes[0])
    for k in sizes[1:]:
        out = out.unionAll(part(rows, k))
    return out


def _opened(docs: DataFrame, keys: DataFrame, sizes: list[int], text: str, small: bool) -> DataFrame:
    """``tid, dh, len, n, k, i``: the positions ``i`` of texts that hold a shingle of an item of ``n`` words."""
    texts = docs.select(_digest(text).alias("tid"), F.col(text).alias("text"))
    hashed = texts.select("tid", _hashes("text").alias("dh")).withColumn("len", F.size("dh"))

    def positions(rows: DataFrame, k: int, *more: str) -> DataFrame:
        at = rows.filter(F.col("len") >= k).select("tid", "dh", "len", F.posexplode(F.slice("dh", F.lit(1), F.col("len") - k + 1)).alias("i", "_h"))
        return at.select("tid", *more, "len", F.lit(k).alias("k"), "i", _shingle("dh", "i", k).alias("s"))

    if small:
        return _by_k(hashed, sizes, lambda rows, k: positions(rows, k, "dh").join(F.broadcast(keys.filter(F.col("k") == k)), ["s", "k"]).select("tid", "dh", "len", "n", "k", "i"))
    hits = _by_k(hashed, sizes, positions).join(keys, ["s", "k"]).select("tid", F.struct("n", "k", "i").alias("hit")).distinct()
    hits = hits.groupBy("tid").agg(F.collect_list("hit").alias("hits"))  # at most a few for each word of one text
    found = texts.join(hits, "tid").select("tid", "hits", _hashes("text").alias("dh"))
    return found.select("tid", "dh", F.size("dh").alias("len"), F.explode("hits").alias("h")).select("tid", "dh", "len", "h.n", "h.k", "h.i")


def _contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame | None:
    """``tid, item_id, similarity, start_word`` of contaminated texts by their digest; None without any item."""
    named = benchmark.select(F.col(item_id).alias("item_id"), F.md5(F.array_join(_words(F.col(item_text)), " ").cast("binary")).alias("item"), _hashes(item_text).alias("ih"))
    named = materialize(named.withColumn("n", F.size("ih")).filter("n > 0"), "named-items")
    items = named.drop("item_id").dropDuplicates(["item"]).withColumn("k", F.least(F.lit(width), F.col("n")))
    items = materialize(items, "items")
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # 1 to `width`: at most that many rows
    if not sizes:
        return None
    zero = F.lit(0)

    def shingled(rows: DataFrame, k: int) -> DataFrame:
        part = rows.filter(F.col("k") == k).select("item", "n", "k", "ih", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("_i"))
        return part.select("item", "n", "k", _shingle("ih", "_i", k).alias("s"))

    item_shingles = _by_k(items, sizes, shingled).groupBy("item", "n", "k", "s").agg(F.count(F.lit(1)).alias("c"))
    item_shingles = materialize(item_shingles, "item-shingles")
    keys = materialize(item_shingles.select("s", "n", "k").distinct(), "item-keys")

    hit = _opened(docs, keys, sizes, text, keys.count() <= broadcast_rows)
    first, last = F.greatest(zero, F.col("i") - F.col("n") + F.col("k")), F.least(F.col("i"), F.col("len") - F.col("n"))
    # a shorter document is one window; with fewer shingles than this it cannot reach the threshold
    short = F.col("len") < F.col("n")
    enough = F.col("len") - F.col("k") + 1 >= threshold * (F.col("n") - F.col("k") + 1) - 1e-9
    # what a hit keeps of its document: the words that windows around it can reach
    a, z = F.when(short, 0).otherwise(first), F.when(short, 0).otherwise(last)
    reach = F.when(short, F.col("len")).otherwise(last - first + F.col("n"))
    opened = hit.filter(~short | enough).select("tid", "n", "k", a.alias("a"), z.alias("z"), F.slice("dh", a + 1, reach).alias("part"))
    windows = opened.filter("a <= z").select("tid", "n", "k", "a", "part", F.explode(F.sequence("a", "z")).alias("start"))
    windows = windows.select("tid", "n", "k", "start", F.slice("part", F.col("start") - F.col("a") + 1, F.col("n")).alias("wh"))
    # the same window is opened by each shingle in it, and by equal texts
    windows = windows.groupBy("tid", "n", "k", "start").agg(F.first("wh").alias("wh"))
    windows = materialize(windows.withColumn("wid", F.xxhash64("n", "wh")), "windows")
    texts = windows.groupBy("wid", "n", "k").agg(F.first("wh").alias("wh")).withColumn("m", F.size("wh"))  # m = n but for short documents
    texts = materialize(texts, "window-texts")

    w_fp = _fingerprint(_features(texts.filter("m = n").withColumn("z", zero), ["wid", "n"], "wh", "z", "n"), ["wid", "n"])
    i_fp = _fingerprint(_features(items.withColumn("z", zero), ["item", "n"], "ih", "z", "n"), ["item", "n"])
    filed = i_fp.select("item", "n", F.col("fp").alias("ifp"), F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _near_values(F.col("fp"), b).alias("vs")) for b in range(BLOCKS)])).alias("e"))
    filed = filed.select("item", "n", "ifp", F.col("e.b").alias("b"), F.explode("e.vs").alias("v"))
    asked = w_fp.select("wid", "n", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), _block(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("e"))
    asked = asked.select("wid", "n", "fp", F.col("e.b").alias("b"), F.col("e.v").alias("v"))
    found = asked.join(filed.hint("merge"), ["n", "b", "v"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)

    def in_windows(rows: DataFrame, k: int) -> DataFrame:
        part = rows.filter(F.col("k") == k).select("wid", "n", "k", "m", "wh", F.explode(F.sequence(zero, F.col("m") - k)).alias("_i"))
        return part.select("wid", "n", "k", "m", _shingle("wh", "_i", k).alias("s"))

    w_sh = _by_k(texts, sizes, in_windows).groupBy("wid", "n", "k", "m", "s").agg(F.count(F.lit(1)).alias("cw"))

    # short documents: the shingles that fewest items hold, as many as must hold one of the item's
    rare = item_shingles.groupBy("n", "k", "s").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("wid", "n").orderBy(F.coalesce("held", zero), "s").rowsBetween(Window.unboundedPreceding, -1)
    rarest = w_sh.filter("m < n").join(rare, ["n", "k", "s"], "left").withColumn("before", F.coalesce(F.sum("cw").over(order), zero))
    need = F.ceil(F.lit(threshold) * (F.col("n") - F.col("k") + 1) - 1e-9)
    rarest = rarest.filter(F.col("before") <= F.col("m") - F.col("k") + 1 - need).select("wid", "n", "k", "s")
    found = found.select("wid", "item", "n").unionAll(rarest.join(item_shingles, ["n", "k", "s"]).select("wid", "item", "n")).distinct()

    # exact similarity of the pairs found
    both = found.join(w_sh.select("wid", "n", "m", "s", "cw"), ["wid", "n"]).join(item_shingles, ["item", "n", "s"])
    common = both.groupBy("wid", "item", "n", "k", "m").agg(F.sum(F.least("c", "cw")).alias("common"))
    scored = common.withColumn("total", F.col("n") + F.col("m") - 2 * F.col("k") + 2)  # shingles of window and item
    scored = scored.withColumn("similarity", F.col("common") / (F.col("total") - F.col("common")))
    hits = windows.select("tid", "wid", "start").join(scored.filter(F.col("similarity") >= threshold), "wid")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("m"))).alias("best")
    names = named.select("item_id", "item").distinct()
    out = hits.groupBy("tid", "item").agg(best).join(names, "item").groupBy("tid", "item_id").agg(F.max("best").alias("best"))
    return materialize(out.select("tid", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.m")).alias("start_word")), "contaminated")


@tidied
def find_contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, similarity, start_word``: for each contaminated pair the best window (the first of equals)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _digest(text).alias("tid"))
    bad = _contaminated_texts(docs, benchmark, text=text, **options)
    if bad is None:
        return rows.limit(0).select("doc_id", F.lit(None).cast(benchmark.schema[options.get("item_id", "item_id")].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("m"))).alias("best")
    out = rows.join(bad, "tid").groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.m")).alias("start_word"))


@tidied
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text is contaminated, whatever their id."""
    options.pop("doc_id", None)
    bad = _contaminated_texts(docs, benchmark, text=text, **options)
    if bad is None:
        return docs
    bad = bad.select("tid").distinct()
    return docs.join(bad, _digest(text) == bad["tid"], "left_anti")
