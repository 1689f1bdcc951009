"""Segmented tables against a plain model, and what a change of a project writes."""

from __future__ import annotations

import os
import random

import pytest

from tarn.api import SEGMENTED, Project
from tarn.operators.segments import KEEP, TIER, Segments

SCHEMA = "id long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_changes_give_the_model(spark, tmp_path):
    table, model, rng = Segments(spark, str(tmp_path / "t"), SCHEMA, "id", ("v",)), {}, random.Random(4)
    assert rows(table.read()) == []
    for step in range(12):
        new = {rng.randrange(30): [f"{step}-{j}" for j in range(rng.randrange(1, 3))] for _ in range(rng.randrange(0, 5))}
        gone = set(new) | {rng.randrange(30) for _ in range(2)}
        table.add(spark.createDataFrame([(i, v) for i, vs in new.items() for v in vs], SCHEMA), spark.createDataFrame([(i,) for i in gone] + [(None,)], "id long"))
        model = {i: v for i, v in model.items() if i not in gone} | new
        assert rows(table.read()) == sorted((i, v) for i, vs in model.items() for v in vs)
    state = table.state()
    assert len(state["segments"]) < 2 * TIER and len(state["gone"]) <= 2 * TIER
    named = {x["path"] for x in state["segments"] + state["gone"]} | {p for _, p in state["retired"]}
    assert {d for d in os.listdir(tmp_path / "t") if d != "commits"} == named  # nothing else is left
    assert len(table.versions()) <= KEEP
    table.replace(spark.createDataFrame([(1, "x")], SCHEMA))
    assert rows(table.read()) == [(1, "x")]


def test_what_a_broken_off_writer_left_is_not_read(spark, tmp_path):
    table = Segments(spark, str(tmp_path / "t"), SCHEMA, "id")
    table.add(spark.createDataFrame([(1, "a")], SCHEMA))
    table._written(spark.createDataFrame([(2, "b", 9)], f"{SCHEMA}, _seq long"))
    (tmp_path / "t" / "commits" / ".half").write_text("{")
    assert rows(table.read()) == [(1, "a")]
    late, now = table.state(), table.state()
    table._commit(late | {})
    with pytest.raises(RuntimeError):
        table._commit(now)
    before = table.read()
    table.add(spark.createDataFrame([(1, "c")], SCHEMA), spark.createDataFrame([(1,)], "id long"))
    assert rows(before) == [(1, "a")] and rows(table.read()) == [(1, "c")]  # a reader keeps what it began with
    assert rows(table.read(table.state()["version"] - 1)) == [(1, "a")]


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_change_writes_in_proportion(spark, tmp_path):
    """One file of 40 changes, one goes: little is written, and all tables and searches are those of a new index."""
    source = tmp_path / "src"
    source.mkdir()
    rng = random.Random(1)
    words = [f"name{i}" for i in range(400)]
    for i in range(40):
        body = "\n\n\n".join(f"def f{i}_{j}(a, b):\n    {rng.choice(words)} = {rng.choice(words)}(a)\n    return {rng.choice(words)}" + "".join(f"\n    # {' '.join(rng.choice(words) for _ in range(9))}" for _ in range(12)) for j in range(6))
        (source / f"m{i}.py").write_text(body)
    project = Project(spark, str(tmp_path / "index"))
    project.index(str(source))
    root = tmp_path / "index"
    held = {t: set(os.listdir(root / t)) for t in SEGMENTED}
    total = sum(size(root / t) for t in SEGMENTED)
    (source / "m7.py").write_text("def altered(x):\n    return unheard_of(x)\n")
    os.remove(source / "m9.py")
    os.utime(source / "m11.py", (1, 1))
    assert sorted((r.file_path.rsplit("/", 1)[-1], r.change) for r in project.index(str(source)).collect() if r.change != "same") == [("m7.py", "changed"), ("m9.py", "deleted")]
    written = sum(size(root / t / d) for t in SEGMENTED for d in set(os.listdir(root / t)) - held[t] if d != "commits")
    assert written < total / 6
    assert project.search("altered", 1, mode="lexical").first().file_path.endswith("m7.py") and project.search("unheard", 3, mode="lexical").count() >= 1

    new = Project(spark, str(tmp_path / "new"))
    new.index(str(source))
    for name, columns in (("postings", ["term", "field", "pos", "dl"]), ("lengths", ["dl"]), ("vectors", ["embedding"])):
        assert rows(project.table(name).select(*columns)) == rows(new.table(name).select(*columns)), name
    hits = [rows(p.search("name7 name8", 5, mode="lexical").select("uri", "score")) for p in (project, new)]
    assert [u for u, _ in hits[0]] == [u for u, _ in hits[1]] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(*hits, strict=True))
    assert {r.change for r in project.index(str(source)).collect()} == {"same"}
    assert project.table("manifest").filter("file_path like '%m11.py'").first().mtime == 1
