"""Ancestry over a table of commits: ``repo, hash, parents`` (an array; null is none).

A commit is known by (``repo``, ``hash``), so one table holds any number of repositories and all are walked at
once.  Histories are mostly straight, so commits are first folded into runs: maximal chains in which each commit is the only
child of the one below and has it as its only parent.  Runs are found by doubling pointers, in as many joins
as the logarithm of the longest run; the walks then go from run to run, with one join for each step and a
written table between steps, so that lineage stays short and a lost executor costs one step.

Most repositories are small.  Those of at most LOCAL commits (and questions) are moved once, packed to a row each, and answered
where they are, with ancestors as bits; only larger ones are walked in steps, and those with a cycle.  Both give the same rows.

Parents that the table does not hold are left out (shallow histories).  Repeated rows count once; a null ``repo`` or
``hash`` is no commit.  Commits on or above a cycle, which no sound history has, get no generation; a cycle of single
parents is in no walk either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from ..sources.tables import shared_folder

MOST_STEPS = 100_000
LOCAL = 2048  # commits of a repository that is answered as one row, at most; bits of their ancestors take half a megabyte
COMMIT = ["repo", "hash"]


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: the next step reads it and recomputes nothing."""
    path = f"{shared_folder(df.sparkSession)}/tarn-ancestry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class History:
    """``nodes``: ``repo, hash, parents``, as given; repositories of more than ``local`` commits are walked in steps.  Steps use
    ``place``: ``repo, hash, run, at``, the run of each commit (named by its newest one) and how far below it lies;
    ``links``: ``repo, run, to_run``, from the last commit of a run to the newest one of each run that it comes from
    (others have their only child above them); ``edges``: ``repo, hash, parent``."""

    nodes: DataFrame
    local: int = LOCAL

    @cached_property
    def _runs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return _folded(self.nodes)

    @property
    def place(self) -> DataFrame:
        return self._runs[0]

    @property
    def links(self) -> DataFrame:
        return self._runs[1]

    @property
    def edges(self) -> DataFrame:
        return self._runs[2]


def fold(commits: DataFrame, local: int = LOCAL) -> History:
    """A commit table, written; its runs and how they meet are found when a walk needs them."""
    return History(_written(commits.filter("repo is not null and hash is not null").select(*COMMIT, "parents")), local)


def _folded(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = _written(rows.groupBy(*COMMIT).agg(F.max("parents").alias("parents")))
    every = nodes.select("repo", "hash", F.explode(F.array_distinct("parents")).alias("parent"))
    known = nodes.select("repo", F.col("hash").alias("parent"))
    edges = _written(every.join(known, ["repo", "parent"]).select("repo", "hash", "parent"))
    single = edges.groupBy("repo", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent")).filter("n = 1")
    only = edges.groupBy("repo", "parent").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("repo", "parent")
    up = single.join(only, ["repo", "parent"]).select("repo", F.col("parent").alias("hash"), F.col("hash").alias("run"))
    at = nodes.select(*COMMIT).join(up, COMMIT, "left")
    at = _written(at.select(*COMMIT, F.coalesce("run", "hash").alias("run"), F.when(F.col("run").isNull(), 0).otherwise(1).cast("long").alias("at")))
    moved, left = at.filter("at > 0").count(), None
    while moved and moved != left:  # each turn doubles the way that every pointer has gone; on a cycle some never end
        left = moved
        there = at.select("repo", F.col("hash").alias("run"), F.col("run").alias("_run"), F.col("at").alias("_at"))
        at = _written(at.join(there, ["repo", "run"]).select(*COMMIT, F.col("_run").alias("run"), (F.col("at") + F.col("_at")).alias("at")))
        open_ = at.join(at.filter("at > 0").select("repo", F.col("hash").alias("run")), ["repo", "run"], "left_semi")
        moved = open_.count()
    if moved:
        at = _written(at.join(at.filter("at > 0").select("repo", F.col("hash").alias("run")), ["repo", "run"], "left_anti"))
    tops = at.filter("at = 0").select("repo", F.col("hash").alias("parent"))
    links = edges.join(tops, ["repo", "parent"]).join(at, COMMIT).select("repo", "run", F.col("parent").alias("to_run"))
    return at, _written(links), edges


Walk = tuple[list, dict, list[list[int]]]  # hashes, parents first; the place of each; places of each one's parents


def _walk(commits: list[dict]) -> Walk | None:
    """The commits of one repository in an order; None where they hold a cycle."""
    at = {c["hash"]: i for i, c in enumerate(commits)}
    up = [[at[p] for p in dict.fromkeys(c["parents"] or ()) if p in at] for c in commits]
    down: list[list[int]] = [[] for _ in up]
    for i, parents in enumerate(up):
        for p in parents:
            down[p].append(i)
    waits = [len(x) for x in up]
    order = [i for i, n in enumerate(waits) if not n]
    for i in order:  # grows
        for child in down[i]:
            waits[child] -= 1
            if not waits[child]:
                order.append(child)
    if len(order) < len(up):
        return None
    rank = [0] * len(up)
    for r, i in enumerate(order):
        rank[i] = r
    hashes = [commits[i]["hash"] for i in order]
    return hashes, {h: r for r, h in enumerate(hashes)}, [[rank[p] for p in up[i]] for i in order]


def _reach(walk: Walk) -> list[int]:
    """A bit for each commit that a commit reaches, itself included."""
    out: list[int] = []
    for r, parents in enumerate(walk[2]):
        out.append(reduce(or_, (out[p] for p in parents), 1 << r))
    return out


def _in_repositories(
    history: History, asked: DataFrame | None, names: dict[str, str], answer: Callable[[Walk, list[tuple]], Iterator[tuple]], steps: Callable[[History, DataFrame | None], DataFrame]
) -> DataFrame:
    """``repo`` and columns ``names`` (with their types): ``answer`` of the commits and the questions (``repo`` and two columns) of each
    repository of at most ``history.local`` of either; ``steps`` for the others."""
    spark, nodes = history.nodes.sparkSession, history.nodes
    counts = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    if asked is not None:
        asked = asked.filter("repo is not null")
        counts = counts.unionByName(asked.groupBy("repo").agg(F.count(F.lit(1)).alias("n")))
    large = _written(counts.filter(F.col("n") > history.local).select("repo").distinct())
    some = large.isEmpty()
    small = lambda rows: rows if some else rows.join(F.broadcast(large), "repo", "left_anti")  # noqa: E731 (a row for each LOCAL commits or questions, at most)
    one = small(nodes).repartition("repo").groupBy(*COMMIT).agg(F.max("parents").alias("parents"))
    packed = one.groupBy("repo").agg(F.collect_list(F.struct("hash", "parents")).alias("commits"))
    if asked is None:
        packed = packed.withColumn("asked", F.lit(None).cast("array<string>"))
    else:
        questions = small(asked).repartition("repo").groupBy("repo").agg(F.collect_list(F.struct(*[c for c in asked.columns if c != "repo"])).alias("asked"))
        packed = packed.join(questions, "repo")
    schema = StructType().add("repo", nodes.schema["repo"].dataType).add("sound", BooleanType())
    for name, kind in names.items():
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, rows = None, []
            for i in range(batch.num_rows):
                repo, commits, questions = (batch.column(c)[i].as_py() for c in ("repo", "commits", "asked"))
                walk = _walk(commits)
                if walk is None:
                    rows.append((repo, False, *[None] * len(names)))
                else:
                    rows += [(repo, True, *r) for r in answer(walk, list(dict.fromkeys(tuple(q.values()) for q in questions or ())))]
                if len(rows) >= 20_000 or i == batch.num_rows - 1:
                    kinds = kinds or [batch.schema.field("repo").type, pa.bool_(), *[pa.int64() if k == "long" else batch.schema.field("commits").type.value_type.field("hash").type for k in names.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], schema.names)
                    rows = []

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    out = _written(packed.mapInArrow(work, schema))
    settled = out.filter("sound").select("repo", *names)
    unsound = out.filter("not sound").select("repo")
    if some and unsound.isEmpty():
        return settled
    rest = large.unionByName(unsound).distinct()
    left = History(_written(nodes.join(rest, "repo", "left_semi")), history.local)
    return settled.unionByName(steps(left, None if asked is None else asked.join(rest, "repo", "left_semi")).select("repo", *names))


def ancestors(history: History, starts: DataFrame) -> DataFrame:
    """``repo, start, hash``: every commit that ``starts`` (``repo, hash``) reach by parents, themselves included.

    A step goes from the runs that the last one reached for the first time to those they come from."""
    spark, key = starts.sparkSession, ["repo", "start", "run"]
    path = f"{shared_folder(spark)}/tarn-ancestry/{uuid.uuid4().hex}"
    front = _written(starts.select(*COMMIT).distinct().join(history.place, COMMIT).select("repo", F.col("hash").alias("start"), "run", "at"))
    for _ in range(MOST_STEPS):
        front.write.mode("append").parquet(path)
        seen = spark.read.schema(front.schema).parquet(path)
        reached = front.join(history.links, ["repo", "run"]).select("repo", "start", F.col("to_run").alias("run"), F.lit(0).cast("long").alias("at")).distinct()
        front = _written(reached.join(seen, key, "left_anti"))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"a history is deeper than {MOST_STEPS} runs")
    inside = history.place.select("repo", "run", "hash", F.col("at").alias("_at"))
    return seen.join(inside, ["repo", "run"]).filter("_at >= at").select("repo", "start", "hash")


def commit_range(history: History, ranges: DataFrame) -> DataFrame:
    """``repo, old, new, hash`` for each row ``repo, old, new`` of ``ranges``: what ``new`` reaches and ``old`` does not.  An
    ``old`` that is null or unknown hides nothing."""
    kind = history.nodes.schema["hash"].dataType.simpleString()

    def answer(walk: Walk, questions: list[tuple]) -> Iterator[tuple]:
        hashes, at, reach = walk[0], walk[1], _reach(walk)
        for old, new in questions:
            inside = (reach[at[new]] if new in at else 0) & ~(reach[at[old]] if old in at else 0)
            while inside:
                low = inside & -inside
                yield old, new, hashes[low.bit_length() - 1]
                inside ^= low

    return _in_repositories(history, ranges.select("repo", "old", "new"), {"old": kind, "new": kind, "hash": kind}, answer, _range_by_steps)


def _range_by_steps(history: History, ranges: DataFrame) -> DataFrame:
    asked = ranges.select("repo", "old", "new").distinct()
    ends = asked.select("repo", F.explode(F.array("old", "new")).alias("hash")).filter("hash is not null")
    reach = _written(ancestors(history, ends))
    new = asked.join(reach.withColumnRenamed("start", "new"), ["repo", "new"])
    hidden = asked.join(reach.withColumnRenamed("start", "old"), ["repo", "old"])
    return new.join(hidden, ["repo", "old", "new", "hash"], "left_anti").select("repo", "old", "new", "hash")


def merge_bases(history: History, pairs: DataFrame) -> DataFrame:
    """``repo, left, right, base`` for each row ``repo, left, right``: common ancestors that no other one has among its own.

    What two commits share holds all its ancestors, so its best members are those without a child in it.  Within a repository, the
    newest of what is shared is one; the next is the newest of what remains without its ancestors."""
    kind = history.nodes.schema["hash"].dataType.simpleString()

    def answer(walk: Walk, questions: list[tuple]) -> Iterator[tuple]:
        hashes, at, reach = walk[0], walk[1], _reach(walk)
        for left, right in questions:
            common = reach[at[left]] & reach[at[right]] if left in at and right in at else 0
            while common:
                top = common.bit_length() - 1
                yield left, right, hashes[top]
                common &= ~reach[top]

    return _in_repositories(history, pairs.select("repo", "left", "right"), {"left": kind, "right": kind, "base": kind}, answer, _bases_by_steps)


def _bases_by_steps(history: History, pairs: DataFrame) -> DataFrame:
    asked = pairs.select("repo", "left", "right").distinct()
    reach = _written(ancestors(history, asked.select("repo", F.explode(F.array("left", "right")).alias("hash")).filter("hash is not null")))
    names = ["repo", "left", "right"]
    common = asked.join(reach.withColumnRenamed("start", "left"), ["repo", "left"]).join(reach.withColumnRenamed("start", "right"), ["repo", "right", "hash"])
    common = _written(common.select(*names, "hash"))
    below = common.join(history.edges, COMMIT).select(*names, F.col("parent").alias("hash"))
    return common.join(below, [*names, "hash"], "left_anti").select(*names, F.col("hash").alias("base"))


def generations(history: History) -> DataFrame:
    """``repo, hash, generation``: 1 for a commit without parents, else one more than the largest of its parents.

    In steps, runs are settled once all that their last commits link to are; each step settles every run that can be."""

    def answer(walk: Walk, questions: list[tuple]) -> Iterator[tuple]:
        out: list[int] = []
        for h, parents in zip(walk[0], walk[2], strict=True):
            out.append(1 + max((out[p] for p in parents), default=0))
            yield h, out[-1]

    return _in_repositories(history, None, {"hash": history.nodes.schema["hash"].dataType.simpleString(), "generation": "long"}, answer, lambda left, _: _generations_by_steps(left))


def _generations_by_steps(history: History) -> DataFrame:
    ends = history.place.groupBy("repo", "run").agg(F.max("at").alias("size"))
    waits = history.links.groupBy("repo", "run").agg(F.count(F.lit(1)).alias("n"))
    todo = _written(ends.join(waits, ["repo", "run"], "left").select("repo", "run", "size", F.coalesce("n", F.lit(0)).alias("n")))
    base = lambda d, low: d.select("repo", "run", "size", low.alias("low"))
    done = base(todo.filter("n = 0"), F.lit(1).cast("long"))  # ``low``: generation of a run's last commit
    for _ in range(MOST_STEPS):
        done = _written(done)
        known = done.select("repo", F.col("run").alias("to_run"), (F.col("low") + F.col("size")).alias("top"))
        ready = history.links.join(known, ["repo", "to_run"]).groupBy("repo", "run").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("top") + 1).alias("low"))
        fresh = todo.join(ready, ["repo", "run"]).filter("n = _n").join(done.select("repo", "run"), ["repo", "run"], "left_anti")
        fresh = _written(base(fresh, F.col("low")))
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
    else:
        raise RuntimeError(f"a history is deeper than {MOST_STEPS} runs")
    return history.place.join(done, ["repo", "run"]).select("repo", "hash", (F.col("low") + F.col("size") - F.col("at")).alias("generation"))
