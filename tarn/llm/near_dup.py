"""MinHash near-deduplication with ProbMinHash over weighted five-word shingles.

Signatures.  Every shingle, weighted by its count, is a Poisson process of that rate whose
arrivals fall on random registers; a register keeps the shingle of its first arrival.
A document stops as soon as no later arrival can come first anywhere (early termination),
which leaves about m ln m arrivals however long the text.  Two registers agree with the
probability Jaccard similarity J_P of the weighted sets.

Candidates.  ``BANDS`` bands of ``ROWS`` registers: a pair at 0.8 misses all of them with
probability 3e-7.  Within a band bucket every text is paired with the smallest and the
largest id only; the links that hold give components.  Buckets that still hold several
components are searched further: signatures first, which gives families of components with
candidate pairs, then the texts of a family's nodes.  A bucket's nodes are cut into blocks of about
``block`` and searched in pairs of blocks, so what is found does not depend on a bucket's size; the blocks of
its most frequent component meet those of the others only.  Tasks give out only which components join, never pairs of documents.

Verification.  J_P of each candidate pair is computed exactly from the texts' shingles
(64-bit hashes stand for shingles); pairs at ``threshold`` or more are links and
documents joined by links form a class, named by its smallest id.  Ids are integers.

Equal texts form one node before any pairing.  Words are runs of anything but ASCII white
space; texts of 1 to 4 words have one shingle; texts without words are near duplicates
of texts without words only, and null is empty.  Rows that share an id share a class; a
row with a null id has a null class and joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_signed, connected_components, map_arrow, materialize, mix, shingles, sub_batches, text_buffer, tidied

ROWS, BANDS = 3, 21
M = ROWS * BANDS
BLOCK, TEXT_BLOCK, TEXT_BYTES = 2048, 512, 2 << 20  # nodes of a block by signatures; nodes and bytes of one by texts
AGREE = 36  # of 63 registers; a pair at 0.8 has fewer with probability 1e-5


def _counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and their counts, by row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def prob_min_hash(h: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x M shingle hashes) of weighted shingles; rows without shingles are 0."""
    best = np.full(n * M, np.inf)
    who = np.zeros(n * M, np.uint64)
    limit = np.full(n, np.inf)
    time = np.zeros(len(h))
    turn = 0
    while len(h):
        turn += 1
        r = mix(h + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / count
        live = time < limit[row]
        h, row, count, time, r = h[live], row[live], count[live], time[live], r[live]
        if not len(h):
            break
        slot = row * M + (mix(r) % np.uint64(M)).astype(np.int64)
        better = time < best[slot]
        s, t, x = slot[better], time[better], h[better]
        order = np.lexsort((t, s))  # the first arrival of each register
        s, t, x = s[order], t[order], x[order]
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        best[s[first]], who[s[first]] = t[first], x[first]
        touched = np.unique(row)
        limit[touched] = best.reshape(n, M)[touched].max(1)
    return who.reshape(n, M)


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest`` (of the text), ``sig`` (M 32-bit registers) and ``bands`` (BANDS hashes)."""
    clean = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), clean.alias("text"), F.md5(clean.cast("binary")).alias("digest"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                n = part.num_rows
                h, row, count = _counted(*shingles(*text_buffer(part.column("text"))))
                sig = prob_min_hash(h, row, count, n)
                bands = np.zeros((n, BANDS), np.uint64)
                for i in range(ROWS):
                    bands = mix(bands * np.uint64(0xD1342543DE82EF95) + sig[:, i::ROWS])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                small = (sig >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(list(as_signed(bands)), pa.list_(pa.int64()))],
                    ["doc_id", "digest", "sig", "bands"],
                )

    return map_arrow(rows, work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, digest string, sig binary, bands array<long>")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _agreeing(pairs: DataFrame, sigs: DataFrame, agree: int) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in at least ``agree`` registers."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, M) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(_agreement(sa, sb) >= agree))

    return map_arrow(both.select("a", "b", "sa", "sb"), work, "a long, b long").distinct()


def prob_jaccard(x: np.ndarray, xc: np.ndarray, y: np.ndarray, yc: np.ndarray) -> float:
    """Exact J_P of two weighted sets, given as sorted hashes and counts: over common elements i,
    the sum of 1 / sum_j max(x_j / x_i, y_j / y_i), in one sweep by the ratio y / x."""
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = xc[i].astype(float), yc[j].astype(float)
    only_x, only_y = float(xc.sum() - a.sum()), float(yc.sum() - b.sum())
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    ratio = b / a
    lower = np.searchsorted(ratio, ratio, side="left")  # elements with a smaller ratio count by x, the others by y
    ax, by = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    return float((1.0 / ((only_x + ax[lower]) / a + (only_y + by[-1] - by[lower]) / b)).sum())


def verify(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` with their exact ``similarity``, where it reaches ``threshold``.  ``docs``: ``node, text``."""
    both = pairs.join(docs.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(docs.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in sub_batches(batch, "ta"):
                for part in sub_batches(whole, "tb"):
                    n, sides = part.num_rows, []
                    for c in ("ta", "tb"):
                        h, row, count = _counted(*shingles(*text_buffer(part.column(c))))
                        sides.append((h, count, np.searchsorted(row, np.arange(n + 1))))
                    (h, c, u), (g, d, v) = sides
                    s = [1.0 if u[i] == u[i + 1] and v[i] == v[i + 1] else prob_jaccard(h[u[i] : u[i + 1]], c[u[i] : u[i + 1]], g[v[i] : v[i + 1]], d[v[i] : v[i + 1]]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return map_arrow(both.select("a", "b", "ta", "tb"), work, "a long, b long, similarity double").filter(F.col("similarity") >= threshold)


class _Forest:
    """Union-find over the few labels of one group; keeps the unions that joined something."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((min(x, y), max(x, y)))


def _block_pairs(rows: DataFrame, group: str, blocks: Column, *payload: str) -> DataFrame:
    """Rows ``i, j, xs`` with the members of blocks i and j of each group, for all i <= j.  A group is
    cut into ``blocks`` (an aggregate) by a hash, so no row grows with the group."""
    sizes = rows.groupBy(group).agg(F.ceil(blocks).cast("int").alias("blocks"))
    rows = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select(group, "block", *payload, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    rows = rows.select(group, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.struct("block", *payload).alias("x"))
    return rows.groupBy(group, "i", "j").agg(F.collect_list("x").alias("xs")).select("i", "j", "xs")


def _sides(i: int, j: int, xs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    block, comp = np.array([x["block"] for x in xs]), np.array([x["comp"] for x in xs])
    return np.flatnonzero(block == i), np.flatnonzero(block == j), comp


def _open(members: DataFrame, least: int) -> DataFrame:
    """``members`` (``bucket, node, comp``) of buckets with at least ``least`` nodes and two components, with the size ``n``."""
    state = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return materialize(members.join(state.filter(f"n >= {least} and low < high").select("bucket", "n"), "bucket"), "open-buckets")


def _bucket_pairs(members: DataFrame, block: int, *payload: str) -> DataFrame:
    """Rows ``i, j, xs`` of :func:`_block_pairs` for buckets, without those that hold one component only: a bucket's most frequent component
    has blocks of its own, which meet the others and not each other.  So a family of copies moves once for each block of the rest."""
    counts = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("_most"), F.max("n").alias("_held"), F.sum("n").alias("_all"))
    sizes = sizes.select("bucket", "_most", *[F.ceil(x / block).cast("int").alias(c) for c, x in (("_own", F.col("_held")), ("_rest", F.col("_all") - F.col("_held")))])
    most = F.col("comp") == F.col("_most")
    at = F.when(most, F.col("_rest") + F.pmod(F.xxhash64("node"), F.col("_own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("_rest"))).cast("int")
    rows = members.join(sizes, "bucket").withColumn("block", at)
    meets = F.sequence(F.lit(0), F.col("_rest") - 1 + F.when(most, 0).otherwise(F.col("_own")))
    rows = rows.select("bucket", "block", *payload, F.explode(meets).alias("o"))
    rows = rows.select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.struct("block", *payload).alias("x"))
    return rows.groupBy("bucket", "i", "j").agg(F.collect_list("x").alias("xs")).select("i", "j", "xs")


def _families(members: DataFrame, sigs: DataFrame, comps: DataFrame, block: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """Edges between components that hold candidate pairs, and the nodes that were looked at.

    A candidate pair lies in a common bucket and its signatures agree in ``agree`` registers.  ``members``:
    ``bucket, node``.  Each row of members that meet gives a spanning forest of its components only.  Buckets of one component are
    done, and stars have compared all of two nodes."""
    labelled = members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = _open(labelled, 3)
    nodes = materialize(open_.select("node", "comp").distinct(), "open-nodes")
    met = _bucket_pairs(open_.join(sigs.select("node", "sig"), "node"), block, "node", "comp", "sig")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, xs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                u, v, comp = _sides(i, j, xs)
                sig = np.frombuffer(b"".join(x["sig"] for x in xs), np.uint32).reshape(-1, M)
                forest = _Forest()
                for p in u:
                    q = v[comp[v] != comp[p]]
                    for c in np.unique(comp[q[_agreement(sig[q], sig[p]) >= agree]]).tolist():
                        forest.join(int(comp[p]), c)
                found += forest.edges
            yield _pairs(found)

    return map_arrow(met, work, "a long, b long").distinct(), nodes


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _links_between(xs: list[dict], u: np.ndarray, v: np.ndarray, comp: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the components that exact similarity joins, between rows ``u`` and ``v``.

    Common shingles of all pairs are one matrix product over the shingles that several rows have.  Of
    rows without repeated shingles that gives the similarity itself; for others the part of each
    row's weight that is common bounds it, and pairs within the bound are computed one by one."""
    n = len(xs)
    h, row, count = _counted(*shingles(*text_buffer(pa.array([x["text"] for x in xs], pa.string()))))
    cut = np.searchsorted(row, np.arange(n + 1))
    names, back, seen = np.unique(h, return_inverse=True, return_counts=True)
    total = np.bincount(row, weights=count, minlength=n)
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(names), -1)
    place[shared] = np.arange(len(shared))
    column, weight = place[back], count / total[row]
    common, part = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 2048):
        use = (column >= at) & (column < at + 2048)
        has, heavy = np.zeros((n, min(2048, len(shared) - at)), np.float32), None
        heavy = has.copy()
        has[row[use], column[use] - at] = 1
        heavy[row[use], column[use] - at] = weight[use]
        common += has @ has.T
        part += heavy @ has.T  # of a row's weight, what another row has too
    size = np.diff(cut).astype(np.float32)
    plain = total == size
    forest = _Forest()
    empty = size == 0
    for p in u:
        q = v[comp[v] != comp[p]]
        bound = np.minimum(part[p, q], part[q, p])
        near = (common[p, q] / np.maximum(size[p] + size[q] - common[p, q], 1) >= threshold - 1e-6) | (empty[p] & empty[q])
        for k in np.flatnonzero(np.where(plain[p] & plain[q], near, bound >= threshold - 1e-4)).tolist():
            r = int(q[k])
            if forest.top(int(comp[p])) != forest.top(int(comp[r])) and (
                (plain[p] and plain[r]) or prob_jaccard(h[cut[p] : cut[p + 1]], count[cut[p] : cut[p + 1]], h[cut[r] : cut[r + 1]], count[cut[r] : cut[r + 1]]) >= threshold
            ):
                forest.join(int(comp[p]), int(comp[r]))
    return forest.edges


def _join_components(families: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Edges between components with a pair at ``threshold``: the nodes of a family meet in pairs of blocks
    with their texts, and only the joins leave a task, so rows grow with the nodes."""
    rows = nodes.join(families, "comp").join(texts, "node")
    blocks = F.greatest(F.count(F.lit(1)) / TEXT_BLOCK, F.sum(F.octet_length("text")) / TEXT_BYTES)
    met = _block_pairs(rows, "family", blocks, "node", "comp", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, xs = (batch.column(c)[k].as_py() for c in range(3))
                yield _pairs(_links_between(xs, *_sides(i, j, xs), threshold))

    return map_arrow(met, work, "a long, b long").distinct()


@tidied
def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, block: int = BLOCK, agree: int = AGREE) -> DataFrame:
    """``doc_id, class_id`` for every row.  Pairs whose signatures agree in fewer than ``agree`` registers are not compared; 0 compares all of a bucket."""
    kind = docs.schema[doc_id].dataType
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialize(signatures(base), "signatures")
    named = found.filter("doc_id is not null")
    # equal texts: one node, the smallest id
    equal = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "equal-texts")
    nodes = materialize(named.join(equal, "digest").filter("doc_id = node").dropDuplicates(["digest"]).select("node", "sig", "bands"), "nodes")

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = materialize(members.join(buckets, "bucket").select("bucket", "node", "low", "high"), "buckets")
    stars = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p"))
    stars = stars.select("p.a", "p.b").filter("a < b").distinct()
    # the texts that are compared, moved once; a node that reads different texts under one id keeps all of them
    texts = base.withColumnRenamed("doc_id", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = materialize(texts, "bucket-texts")
    links = materialize(verify(materialize(_agreeing(stars, nodes, agree), "stars"), texts, threshold), "links").select("a", "b")
    comps = materialize(connected_components(links), "components")
    between, open_nodes = _families(members.select("bucket", "node").distinct(), nodes, comps, block, agree)
    families = connected_components(between).select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    joined = materialize(_join_components(families, open_nodes, texts, threshold), "joined")

    # components joined later, and rows that share an id
    same = named.join(equal, "digest").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comps = connected_components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(joined).unionAll(same))
    rows = base.select("doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), F.coalesce("comp", "doc_id").cast(kind).alias("class_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class (its smallest id) and rows with a null id."""
    classes = near_duplicates(docs, doc_id=doc_id, **options).filter("doc_id is not null")
    go = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("_go")).distinct()
    left = docs.join(go, F.col(doc_id) == F.col("_go"), "left_anti")
    unique = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return left if unique else left.filter(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(left.filter(F.col(doc_id).isNull()))
