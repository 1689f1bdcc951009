"""Walks over commit tables against plain graph searches, and rows of merges and comparisons."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import ancestry
from tarn.sources import history

SCHEMA = "repo string, hash string, parents array<string>"


def made(seed: int, n: int, repo: str = "r") -> list[tuple]:
    """A history with straight runs, forks, merges of up to three parents, several roots and a parent that is not there."""
    pick, rows = random.Random(seed), []
    for i in range(n):
        kind = pick.random()
        if i == 0 or kind < 0.03:
            parents = [] if i % 2 else None
        elif kind < 0.75:
            parents = [f"c{i - 1}"]
        elif kind < 0.88:
            parents = [f"c{pick.randrange(i)}"]
        else:
            parents = [f"c{j}" for j in pick.sample(range(i), min(i, pick.choice((2, 2, 3))))]
        rows.append((repo, f"c{i}", parents + ["gone"] if parents and kind > 0.97 else parents))
    return rows


def plain(rows: list[tuple]) -> dict[str, set[str]]:
    known = {h for _, h, _ in rows}
    out: dict[str, set[str]] = {}
    for _, h, parents in rows:  # parents come first
        out[h] = {h}.union(*(out[p] for p in parents or [] if p in known))
    return out


@pytest.mark.parametrize("seed", (1,))
def test_walks_equal_a_plain_search(spark, seed):
    rows = made(seed, 60)
    other = [("s", h, p) for _, h, p in made(seed + 10, 25)]
    h = ancestry.fold(spark.createDataFrame(rows + rows[:9] + other + [("r", None, ["c1"]), (None, "c1", None)], SCHEMA))
    for repo, table in (("r", rows), ("s", other)):
        want, have = plain(table), {}
        starts = [x for _, x, _ in table][::3]
        for r in ancestry.ancestors(h, spark.createDataFrame([(repo, x) for x in starts], "repo string, hash string")).collect():
            have.setdefault(r.start, []).append(r.hash)
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(want[k]) for k in starts}
    want = plain(rows)
    pick = random.Random(seed)
    pairs = [tuple(f"c{pick.randrange(60)}" for _ in "ab") for _ in range(25)]
    got: dict = {}
    for r in ancestry.merge_bases(h, spark.createDataFrame([("r", *p) for p in pairs + pairs[:3]], "repo string, left string, right string")).collect():
        got.setdefault((r.left, r.right), []).append(r.base)
    for a, b in set(pairs):
        common = want[a] & want[b]
        best = sorted(c for c in common if not any(c in want[d] and c != d for d in common))
        assert sorted(got.get((a, b), [])) == best
    asked = spark.createDataFrame([("r", *p) for p in pairs] + [("r", None, "c5"), ("r", "nowhere", "c6")], "repo string, old string, new string")
    ranges: dict = {}
    for r in ancestry.commit_range(h, asked).collect():
        ranges.setdefault((r.old, r.new), set()).add(r.hash)
    assert all(ranges.get(p, set()) == want[p[1]] - want[p[0]] for p in pairs)
    assert ranges[None, "c5"] == want["c5"] and ranges["nowhere", "c6"] == want["c6"]
    depth: dict = {}
    for _, x, parents in rows:
        depth[x] = 1 + max((depth[p] for p in parents or [] if p in depth), default=0)
    assert {r.hash: r.generation for r in ancestry.generations(h).filter("repo = 'r'").collect()} == depth


def test_long_runs_take_few_steps(spark, monkeypatch):
    """A straight history of 3,000 commits is one run: the walk ends at once."""
    monkeypatch.setattr(ancestry, "MOST_STEPS", 3)
    rows = [("r", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(3000)]
    h = ancestry.fold(spark.createDataFrame(rows, SCHEMA))
    assert ancestry.ancestors(h, spark.createDataFrame([("r", "c2500")], "repo string, hash string")).count() == 2501
    assert ancestry.generations(h).agg(F.max("generation")).first()[0] == 3000


def test_empty_and_unsound_histories(spark):
    none = ancestry.fold(spark.createDataFrame([], SCHEMA))
    assert ancestry.ancestors(none, spark.createDataFrame([("r", "x")], "repo string, hash string")).count() == 0
    assert ancestry.generations(none).count() == 0
    loop = [("r", "a", ["b"]), ("r", "b", ["c"]), ("r", "c", ["a"]), ("r", "top", ["d"]), ("r", "d", [])]
    h = ancestry.fold(spark.createDataFrame(loop, SCHEMA))
    assert {r.hash: r.generation for r in ancestry.generations(h).collect()} == {"d": 1, "top": 2}


@pytest.mark.parametrize("local", (0, 30, ancestry.LOCAL))
def test_repositories_as_rows_and_in_steps_agree(spark, monkeypatch, local):
    """Two sound repositories and one with a cycle, all in steps, some of them, or as rows; rows need no steps."""
    rows = made(3, 40) + [("s", h, p) for _, h, p in made(4, 25)]
    loop = [("u", "a", ["b"]), ("u", "b", ["a"]), ("u", "d", []), ("u", "top", ["d"])] if local != ancestry.LOCAL else []
    if local == ancestry.LOCAL:
        monkeypatch.setattr(ancestry, "_folded", None)
    h = ancestry.fold(spark.createDataFrame(rows + loop + rows[:5], SCHEMA), local)
    want = {repo: plain([r for r in rows if r[0] == repo]) for repo in "rs"}
    pairs = [(repo, f"c{i}", f"c{(7 * i) % 23}") for repo in "rs" for i in range(20)]
    got = {tuple(r) for r in ancestry.commit_range(h, spark.createDataFrame(pairs, "repo string, old string, new string")).collect()}
    assert got == {(r, a, b, x) for r, a, b in pairs for x in want[r][b] - want[r][a]}
    bases = {tuple(r) for r in ancestry.merge_bases(h, spark.createDataFrame(pairs, "repo string, left string, right string")).collect()}
    shared = {(r, a, b): want[r][a] & want[r][b] for r, a, b in pairs}
    assert bases == {(*k, x) for k, c in shared.items() for x in c if not any(x in want[k[0]][y] and x != y for y in c)}
    depth = {}
    for repo, x, parents in rows:
        depth[repo, x] = 1 + max((depth[repo, p] for p in parents or [] if (repo, p) in depth), default=0)
    if loop:
        depth |= {("u", "d"): 1, ("u", "top"): 2}
    assert {(r.repo, r.hash): r.generation for r in ancestry.generations(h).collect()} == depth


def test_comparisons_of_long_ranges(spark):
    """Subjects, files and sums of a range of 400 commits; a range without commits has a row too."""
    t = "timestamp_ntz '2024-01-01 00:00:00'"
    rows = spark.range(400).selectExpr("'r' AS repo", "'a' AS old", "'b' AS new", "concat('c', id) AS hash", f"{t} + make_interval(0, 0, 0, 0, 0, 0, id) AS time", "concat('s', id, '\nbody') AS message", "array(concat('f', id % 70), 'x') AS files", "2L AS insertions", "1L AS deletions")
    asked = spark.createDataFrame([("r", "a", "b"), ("r", "b", "b")], "repo string, old string, new string")
    full, empty = (r for _, r in sorted(((r.from_ref, r) for r in history.compare_ranges(rows, asked).collect())))
    assert full.summary == "s399\ns398\ns397\ns396\ns395\n… and 395 more commits" and full.importance == "high"
    assert tuple(full.diff_stats) == (800, 400, 71, 400) and full.files_changed == sorted({f"f{i}" for i in range(70)} | {"x"})[:50]
    assert tuple(empty.diff_stats) == (0, 0, 0, 0) and empty.files_changed == [] and empty.summary == ""
