"""A project from ingest to upkeep."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tarn import api, cli
from tarn.api import Project
from tarn.operators import maintain


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "math_utils.py").write_text("def add(a, b):\n    return a + b\n\n\ndef multiply(a, b):\n    return a * b\n")
    (root / "main.py").write_text("from math_utils import add\n\n\ndef main():\n    return add(1, 2)\n")
    return root


def test_index_search_update_compact(spark, tmp_path, source, capsys):
    project = Project(spark, str(tmp_path / "index"))
    assert {r.change for r in project.index(str(source)).collect()} == {"new"}
    n = project.table("chunks").count()
    assert n > 0 and project.table("postings").count() > 0 and project.table("vectors").count() == n
    for mode in ("lexical", "hybrid"):
        assert "multiply" in project.search("multiply", 1, mode=mode).first().code
    assert project.search_files("multiply", 1).first().file_path.endswith("math_utils.py")
    assert {r.change for r in project.index(str(source)).collect()} == {"same"}

    (source / "math_utils.py").write_text("\n\ndef divide(a, b):\n    return a / b\n")
    os.remove(source / "main.py")
    project.index(str(source))
    assert {r.file_path.rsplit("/", 1)[-1] for r in project.chunks().collect()} == {"math_utils.py"}
    assert project.search("multiply", 3, mode="lexical").count() == 0 and project.search("divide", 3, mode="lexical").count() == 1
    assert project.status().first().n_stale > 0
    assert project.compact(0.0) and project.status().first().n_stale == 0
    cli.main(["--root", str(tmp_path / "index"), "--format", "csv", "search", "divide", "-k", "1", "--mode", "lexical"])
    assert "math_utils.py" in capsys.readouterr().out


def test_decisions(spark, tmp_path):
    project = Project(spark, str(tmp_path / "index"))
    a, b = project.add_decision("use parquet", "columnar files"), project.add_decision("use csv", "rows")
    project.decide(a, "storage")
    project.decide(b, None)
    assert {r.id: r.status for r in project.table("decisions").collect()} == {a: "approved", b: "rejected"}
    with pytest.raises(ValueError):
        project.decide(a, "again")
    project.export(str(tmp_path / "out"))
    assert '"version":"1.0"' in spark.read.text(str(tmp_path / "out")).first().value


def test_strict_search_finds_what_lies_below_dependencies(spark, tmp_path):
    project = Project(spark, str(tmp_path / "index"))
    rows = [(None, f"u{i}", f"s{i}", "function", f"{'own' if i >= 40 else 'deps'}/{i}.py", 1, 2, "python", "target " * 4 if i < 40 else "target and many other words that make it score less", {}, "project" if i >= 40 else "dependency", None) for i in range(43)]
    rows += [(None, f"v{i}", f"t{i}", "function", f"other/{i}.py", 1, 2, "python", f"something else {i}", {}, "stdlib", None) for i in range(60)]
    project._save("chunks", maintain.upsert(project.table("chunks"), spark.createDataFrame(rows, api.CHUNKS)))
    manifest = [("all", "h", 0.0, 0, [r[1] for r in rows], [])]
    project._save("manifest", spark.createDataFrame(manifest, api.MANIFEST))
    project._derive(project.table("chunks").select("chunk_id"))
    for mode in ("lexical", "semantic", "hybrid"):
        got = project.search("target", 2, mode=mode, include_deps=False, strict=True)
        assert [r.tier for r in got.collect()] == ["project"] * 2, mode
        assert project.search("target", 3, mode=mode, strict=True, where=F.col("file_path").startswith("own")).count() == 3, mode
    assert project.search("target", 1, mode="lexical", strict=True, boosts={"project": 50.0}).first().tier == "project"


def test_memory_is_written_searched_exported_and_imported(spark, tmp_path):
    project = Project(spark, str(tmp_path / "index"))
    a = project.add_event("merge", "feature", "main", "Adds caching", files_changed=["a.py"], importance="high")
    assert project.add_event("tag", "v1", "v2", "Second version") == a + 1
    project.add_changelog("v1.2.0", "First caching release", features=["cache"])
    with pytest.raises(ValueError):
        project.add_changelog("v1.2.0", "again")
    with pytest.raises(ValueError):
        project.add_event("merge", "x", "y", "z", importance="huge")
    one = project.add_decision("use caching", "keep results")
    project.add_decision("drop it", "nothing")
    project.decide(one, "design")
    assert [r.title for r in project.search_memory("CACHING").collect()] == ["use caching"]
    assert {r.kind for r in project.search_memory("caching", decisions_only=False).collect()} == {"decision", "timeline", "changelog"}
    assert project.table("changelogs").first().version == "1.2.0"

    project.export(str(tmp_path / "out"))
    other = Project(spark, str(tmp_path / "other"))
    other.add_event("merge", "v1", "v2", "known under other words")
    assert other.import_memory(str(tmp_path / "out")) == {"added": 3, "skipped": 1}
    assert other.import_memory(str(tmp_path / "out")) == {"added": 0, "skipped": 4}
    got = other.table("decisions").collect()
    assert [(r.title, r.status, r.category, r.session_id) for r in got] == [("use caching", "approved", "design", "imported")]
    assert sorted(r.id for r in other.table("timeline").collect()) == [1, 2] and other.table("timeline").filter("from_ref = 'feature'").first().files_changed == ["a.py"]


def test_settings_are_typed_and_used(spark, tmp_path, source, capsys):
    project = Project(spark, str(tmp_path / "index"))
    assert project.get("chunking.max_chunk_size") == 1200
    assert project.set("chunking.greedy_merge", "no") is False and project.set("search.vector_weight", "0") == 0.0
    for name, value, error in (("chunking.nothing", "1", KeyError), ("chunking.max_chunk_size", "many", ValueError)):
        with pytest.raises(error):
            project.set(name, value)
    project.set("indexing.exclude_patterns", "main.py")
    (source / "node_modules").mkdir()
    (source / "node_modules" / "dep.py").write_text("def dep():\n    return 1\n")
    (source / ".gitignore").write_text("*_skipped.py\n")
    (source / "one_skipped.py").write_text("def skipped():\n    return 1\n")
    project.index(str(source))
    assert {r.file_path.rsplit("/", 1)[-1] for r in project.chunks().collect()} <= {"math_utils.py", ".gitignore"}
    cli.main(["--root", str(tmp_path / "index"), "config", "chunking.greedy_merge"])
    assert capsys.readouterr().out.strip() == "false"
    row = project.status().first()
    assert row.n_files >= 1 and row.n_bytes > 0 and row.age_hours == 0 and row.advice == "No action needed"
    cli.main(["--root", str(tmp_path / "index"), "--format", "table", "--output", str(tmp_path / "status.txt"), "status"])
    assert "│" in (tmp_path / "status.txt").read_text()


def test_only_changed_files_are_read(spark, tmp_path, source, monkeypatch):
    from tarn.sources import files

    project = Project(spark, str(tmp_path / "index"))
    project.index(str(source))
    read = []
    plain = files.with_content
    monkeypatch.setattr(files, "with_content", lambda rows, **o: (read.extend(r.file_path for r in rows.collect()), plain(rows, **o))[1])
    (source / "main.py").write_text("def main():\n    return 'changed'\n")
    project.index(str(source))
    assert [p.rsplit("/", 1)[-1] for p in read] == ["main.py"]


def test_watching_indexes_again(spark, tmp_path, source):
    import json

    project = Project(spark, str(tmp_path / "index"))
    project.index(str(source))
    events, reports = tmp_path / "events", []
    events.mkdir()
    query = project.watch(str(events), str(source), checkpoint=str(tmp_path / "checkpoint"), trigger="1 second", report=reports.append)
    try:
        (source / "fresh.py").write_text("def fresh_function():\n    return 3\n")
        os.remove(source / "main.py")
        for i, second in enumerate((0, 1, 3600)):  # the last one lets the watermark pass the session of the others
            (events / f"{i}.json").write_text(json.dumps({"root": "r", "file_path": "fresh.py", "change": "modified", "ts": f"2024-01-01T{second // 3600:02}:00:{second % 3600:02}"}) + "\n")
            query.processAllAvailable()
        assert {r.file_path.rsplit("/", 1)[-1] for r in project.chunks().collect()} == {"math_utils.py", "fresh.py"}
        assert reports[0] == {"new": 1, "same": 1, "deleted": 1}
    finally:
        query.stop()


def test_chunks_of_rows_that_share_a_path(spark):
    from tarn.operators import chunking

    rows = spark.createDataFrame([("p", "l1\nl2\nl3"), ("p", "m1\nm2\nm3")], "file_path string, text string")
    assert sorted(r.code for r in chunking.fixed_chars(rows, 1200).collect()) == ["l1\nl2\nl3", "m1\nm2\nm3"]
    long = spark.createDataFrame([("q", "\n".join(f"line {i}" for i in range(60_000)))], "file_path string, text string")
    got = chunking.fixed_chars(long, 1200).agg(F.count("*").alias("n"), F.max("end_line").alias("last")).first()
    assert got.last == 60_000 and got.n > 400


def test_code_query_words(spark):
    from tarn.functions import text

    cases = {
        "def loadConfig(file_name): return json.loads(data)": "load Config loadConfig file name file_name json loads data json loads",
        "HTTPServer self x": "HTTP Server HTTPServer", "": "",
    }
    rows = spark.createDataFrame(list(cases), "string")
    got = {r.value: r.q for r in rows.select("value", text.code_query(F.col("value")).alias("q")).collect()}
    assert got[""] == "" and got["HTTPServer self x"] == cases["HTTPServer self x"]
    words = got["def loadConfig(file_name): return json.loads(data)"].split()
    assert {"load", "Config", "loadConfig", "file", "name", "file_name", "json", "loads", "data"} <= set(words) and not {"def", "return"} & set(words)


def test_code_and_memory_in_one_list(spark, tmp_path, source):
    project = Project(spark, str(tmp_path / "index"))
    project.index(str(source))
    for i in range(4):
        project.add_decision(f"return {i}", "about return")
    code = [r.uri for r in project.search("return", 3).collect()]
    found = project.search_all("return", 3).collect()
    assert [r.ref for r in found if r.kind == "code"] == code and [r.kind for r in found[: len(code)]] == ["code"] * len(code)
    assert [r.title for r in found if r.kind == "decision"] == ["return 3", "return 2", "return 1"]
    assert [r["rank"] for r in found] == list(range(1, len(code) + 4))


def test_timeline_and_changelog_forms(spark, tmp_path, capsys):
    root = str(tmp_path / "index")
    project = Project(spark, root)
    project.add_event("merge", "feature", "main", "Adds caching", files_changed=["a.py", "b.py"], importance="high")
    project.add_event("tag", "v1", "v2", "Second version")
    project.add_changelog("v1.0.0", "First", features=["cache"])
    project.add_changelog("v2.0.0", "Second", breaking=["no cache"])

    def said(*args):
        cli.main(["--root", root, *args])
        return capsys.readouterr().out

    page = said("timeline", "--as", "markdown", "--event-type", "merge")
    assert page.startswith("# Project Timeline\n\n## ") and "feature → main\n**Type:** merge | **Importance:** high\n\nAdds caching\n\n**Files changed:** 2" in page and "v2" not in page
    assert [e["summary"] for e in json.loads(said("timeline", "--as", "json", "--importance", "medium"))] == ["Second version"]
    assert json.loads(said("timeline", "--as", "json", "--since", "2999-01-01")) == []
    assert "[HIGH] " in said("timeline") and "From → To" in said("timeline", "--as", "table")
    assert said("changelog", "v1.5..v3").count("## v") == 1 and "### Breaking Changes\n- no cache" in said("changelog")
    assert said("changelog", "--as", "text").splitlines()[1] == "  Second"
    with pytest.raises(SystemExit):
        cli.main(["--root", root, "search", "x", "--no-deps", "--deps-only"])


def test_search_of_dependencies_only(spark, tmp_path, source, capsys):
    root = str(tmp_path / "index")
    Project(spark, root).index(str(source), tier="dependency")
    cli.main(["--root", root, "--format", "json", "search", "return", "--deps-only"])
    assert "Preview" in capsys.readouterr().out
    cli.main(["--root", root, "--format", "json", "search", "return", "--no-deps"])
    assert capsys.readouterr().out.strip() == ""
