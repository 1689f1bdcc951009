"""Operators on small fixtures with known results."""

from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from tarn.functions import embed, languages, text, vectors
from tarn.operators import chunking, evaluate, graph, lexical, maintain, memory, retrieve
from tarn.sources import code, files, history
from tarn.streaming.watch import debounced, watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("question", "words"), [
    ("How does chip counting work?", "chip counting work"), ("What is the authentication flow?", "authentication flow"), ("where is load_config", "load_config"), ("", ""), ("IS the API_KEY ok", "IS API_KEY ok"),
])
def test_keywords(spark, question, words):
    assert one(spark, text.keywords(F.lit(question))) == words


def test_query_text(spark):
    assert one(spark, text.sanitize_query(F.lit("load_config Load_Config ab x1y2"))) == "load_config* OR x1y2*"
    assert one(spark, text.sanitize_query(F.lit("a b"))) == '""'
    assert one(spark, text.code_query(F.lit("def getUserData(self): return np.array(my_var)"))) == "get User Data getUserData array my var my_var np array"
    assert one(spark, text.doc_symbols(F.lit("see `load_config`, `the`, `Foo.bar` and `word`"))) == ["Foo.bar", "load_config"]
    assert one(spark, F.struct(*text.merge_branches(F.lit("Merge branch 'x' into 'main'")))) == ("x", "main")
    assert one(spark, text.version(F.lit("v1.2.3-rc"))) == "1.2.3"


def test_vectors(spark):
    a, b, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, vectors.cosine(a, z)) == 0.0
    assert one(spark, vectors.l2(a, b)) == pytest.approx(2**0.5)
    v = one(spark, embed.hashed(F.lit("alpha beta alpha"), 16))
    assert sum(x * x for x in v) == pytest.approx(1.0, abs=1e-5)
    assert one(spark, languages.language_of(F.lit("a/B.HPP"))) == "cpp"


def test_search_phrases_and_fields(spark):
    rows = spark.createDataFrame([(1, "alpha", "load_config(x)"), (2, "beta", "load the config"), (3, "résumé", "other words"), (4, "z", "")], "chunk_id long, symbol string, code string")
    index = lexical.build_index(rows)
    assert [r.chunk_id for r in lexical.search_one(index, "load_config").collect()] == [1]
    assert [r.chunk_id for r in lexical.search_one(index, "resume").collect()] == [3]
    assert lexical.search_one(index, "x").count() == 0


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "alpha beta"), (2, "b", "alpha")], "chunk_id long, symbol string, code string")
    lexical.build_index(rows).save(str(tmp_path / "i"))
    index = lexical.TextIndex.load(spark, str(tmp_path / "i"))
    assert {r.chunk_id for r in lexical.search_one(index, "alpha").collect()} == {1, 2}


def test_fusion_and_tiers(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "chunk_id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "chunk_id long, score double")
    got = [(r.chunk_id, round(r.score, 6)) for r in retrieve.fuse(a, b, 3).collect()]
    assert got == [(2, round(0.7 / 61 + 0.3 / 60, 6)), (1, round(0.7 / 60, 6)), (3, round(0.3 / 61, 6))]
    rows = spark.createDataFrame([(1, 1.0, "dependency"), (2, 0.8, None), (3, 0.9, "odd")], "chunk_id long, score double, tier string")
    assert [r.chunk_id for r in retrieve.weigh_tiers(rows, 5).collect()] == [3, 2, 1]
    assert [r.chunk_id for r in retrieve.weigh_tiers(rows, 5, include_deps=False).collect()] == [2]


CHUNK = "file_path string, symbol string, chunk_type string, language string, parent_header string, start_line int, end_line int, code string"


def test_split_keeps_lines_and_bounds(spark):
    body = "\n".join(f"    x = {i}" for i in range(50))
    rows = spark.createDataFrame([("f", "big", "function", "python", None, 10, 59, body)], CHUNK)
    got = chunking.split_oversized(rows, 100).orderBy("start_line").collect()
    assert got[0].symbol == "big_part1" and got[0].start_line == 10 and got[-1].end_line == 59
    assert "\n".join(r.code for r in got) == body
    assert all(len(r.code.replace(" ", "").replace("\n", "")) <= 100 for r in got)


def test_greedy_merge(spark):
    rows = [("f", s, "function", "python", None, a, b, c) for s, a, b, c in (("a", 1, 3, "x"), ("b", 4, 4, "y"), ("c", 12, 14, "z"), ("d", 15, 16, "w" * 90))]
    got = chunking.greedy_merge(spark.createDataFrame(rows, CHUNK), 100).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.symbol) for r in got] == [(1, 4, "a+b"), (12, 14, "c"), (15, 16, "d")]


def test_metrics(spark):
    run = spark.createDataFrame([("s", "q", i, r) for r, i in enumerate("abcd", 1)], "system string, query_id string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, item string")
    m = {r.k: r for r in evaluate.metrics(run, rel, (1, 5)).collect()}
    assert (m[1].recall, m[5].recall, m[5].precision, m[5].mrr, m[1].hit, m[5].hit) == (0.0, 0.5, 0.2, 0.5, False, True)


def test_memory(spark, tmp_path):
    rows = spark.sql("SELECT id, 'pending' AS status, CAST('2024-01-01' AS TIMESTAMP_NTZ) AS created_at FROM range(1, 102)")
    kept = [r.id for r in memory.retain_pending(rows).collect()]
    assert len(kept) == 100 and 1 not in kept
    memory.save_snapshot(rows, str(tmp_path / "t"), 1)
    memory.save_snapshot(rows.limit(5), str(tmp_path / "t"), 2)
    schema = "id long, status string, created_at timestamp_ntz"
    assert memory.load_snapshot(spark, str(tmp_path / "t"), schema).count() == 5
    assert memory.load_snapshot(spark, str(tmp_path / "none"), schema).count() == 0


def test_upkeep(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "chunk_id long, uri string, n int")
    new = spark.createDataFrame([(None, "b", 20), (None, "d", 4), (None, "c", 3)], "chunk_id long, uri string, n int")
    assert sorted(map(tuple, maintain.upsert(old, new).collect())) == [(1, "a", 1), (2, "b", 20), (3, "c", 3), (4, "d", 4)]
    m = spark.createDataFrame([("f", "h", 1.0, 1, ["1", "2"], []), ("g", "h", 1.0, 1, ["3"], [])], "file_path string, hash string, mtime double, size long, valid_chunks array<string>, stale_chunks array<string>")
    fresh = m.filter("file_path = 'f'").select("file_path", "hash", "mtime", "size", F.array(F.lit("2"), F.lit("9")).alias("valid_chunks"))
    m = maintain.update_manifest(m, fresh)
    s = maintain.staleness(m).first()
    assert (s.n_valid, s.n_stale, s.n_files_stale, s.status) == (3, 1, 1, "degraded")
    assert maintain.compact(spark.createDataFrame([("1",), ("2",), ("9",), ("3",)], "uri string"), m)[0].count() == 3


CODE = {
    "app/main.py": "import os\nfrom app.load import load_config\n\nX = 1\n\n\nclass Main:\n    # note\n    def run(self, c: Config):\n        return load_config(c)\n",
    "app/load.py": "def load_config(path):\n    return parse_file(path)\n\n\ndef parse_file(path):\n    return open(path)\n",
    "web/a.ts": "export class Store {\n  get() {\n    return 1\n  }\n}\nexport const go = (x) => {\n  return x\n}\n",
    "skip/b.py": "x = 1\n",
    "README.md": "Use `load_config` first.\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in CODE.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(body)
    return str(tmp_path / "src")


def test_files_are_cut_in_their_task(spark):
    """As by the operators on rows of chunks, but no text is shuffled or sorted (a task's memory grew with its share of the table)."""
    long = "class Big:\n" + "\n".join(f"    def m{i}(self):\n        return {i} * {i}  # note" for i in range(40)) + "\n\n\nx = 1\n"
    texts = [
        ("a", "python", long), ("b", "python", "import os\n\n\ndef f():\n    return 1\n\n\nclass A:\n    def f(self):\n        return 1\n\n\nimport os\n"), ("c", "python", "def ("), ("d", "python", " \n\t\n"), ("e", "python", None),
        ("f", "typescript", "export function a(b) {\n  return b;\n}\n// a\nclass C {\n  m() {\n    return 1;\n  }\n}"), ("g", "go", "func A() {\n}\nfunc B() {\n}\n"), ("h", "text", "x"), ("i", None, "x"), ("j", "python", "\n\nx = '" + "y" * 300 + "'\nz = 2\n"),
    ]
    sources = spark.createDataFrame(texts, "file_path string, language string, text string")
    names = ["file_path", "symbol", "chunk_type", "language", "parent_header", "start_line", "end_line", "code"]
    found = code.concepts(sources)
    lines = sources.select("file_path", F.split("text", "\n").alias("_lines"))
    own = found.join(lines, "file_path").withColumn("code", F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    own = own.withColumnsRenamed({"concept": "chunk_type", "parent": "parent_header"}).select(*names)
    python = sources.filter("language = 'python'")
    gaps = chunking.coverage_gaps(found.filter("language = 'python'"), python).selectExpr("file_path", "symbol", "'unknown' AS chunk_type", "'python' AS language", "CAST(NULL AS STRING) AS parent_header", "start_line", "end_line", "code")
    for most in (1200, 100, 20):
        want = chunking.deduplicate(chunking.split_oversized(chunking.not_blank(own.unionByName(gaps)), most)).select(*names)
        got = code.chunk_files(sources, most=most, merge=False)
        assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_files_to_research(spark, tree):
    listed = files.list_files(spark, tree, patterns=["skip/"], content=True)
    assert {r.rel_path for r in listed.collect()} == set(CODE) - {"skip/b.py"}
    assert files.documentation(listed).count() == 1
    sources = listed.filter("language <> 'markdown'").select(F.col("rel_path").alias("file_path"), "language", files.text_of(F.col("content")).alias("text"))
    raw = code.concepts(sources)
    names = {(r.symbol, r.concept) for r in raw.collect()}
    assert {("Main", "class"), ("run", "method"), ("load_config", "function"), ("Store", "class"), ("go", "function")} <= names
    chunks = code.chunk_files(sources, merge=False).withColumn("chunk_id", F.xxhash64("uri"))
    assert "module_gap_1_6" in {r.symbol for r in chunks.collect()}
    assert code.chunk_files(sources).count() < chunks.count()
    index = lexical.build_index(chunks)
    start = lexical.search_one(index, "Main", 1)
    found, edges = graph.research(spark, index, chunks, code.entities(chunks), start)
    assert found.count() > 1 and {r.relationship_type for r in edges.collect()} <= {"function_call", "import", "class_reference"}
    assert graph.entry_points(edges).count() >= 1


def test_ignore_patterns():
    assert files.nested_patterns("lib", ["# x", "", "*.log", "!keep.log", "/top"]) == ["lib/*.log", "!lib/keep.log", "/top"]


def test_project_profile(spark):
    names = spark.createDataFrame([("pyproject.toml",), ("go.mod",), ("x.csproj",)], "name string")
    found = {r.language: r.confidence for r in files.detect_languages(names).collect()}
    assert found["python"] == 0.9 and found["go"] == 0.95 and 0 < found["csharp"] < 0.8
    assert files.profile(files.detect_languages(names)).first().primary_languages == ["go", "python"]


def test_uri(spark):
    rows = spark.createDataFrame([("pci:///tmp/e.py#10-20",), ("odd",)], "u string")
    assert [tuple(r) for r in rows.select(*files.parse_uri(F.col("u"))).collect()] == [("/tmp/e.py", 10, 20), ("unknown", 1, 1)]


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "a").write_text("1\n2\n")
    git("add", "."), git("commit", "-qm", "feat: one"), git("tag", "-a", "v1.0.0", "-m", "feat: first\nfix: bug"), git("checkout", "-qb", "side")
    (tmp_path / "b").write_text("x\n")
    git("add", "."), git("commit", "-qm", "fix: two"), git("checkout", "-q", "main"), git("merge", "-q", "--no-ff", "side", "-m", "Merge branch 'side' into 'main'")
    tag = history.tags(spark, str(tmp_path)).first()
    assert (tag.version, tag.features, tag.fixes) == ("1.0.0", ["feat: first"], ["fix: bug"])
    m = history.merges(spark, str(tmp_path)).collect()
    assert [(r.from_ref, r.to_ref, r.files_changed, r.diff_stats.insertions) for r in m] == [("side", "main", ["b"], 1)]
    c = history.compare(spark, str(tmp_path), "v1.0.0", "main").first()
    assert c.diff_stats.commits == 2 and c.files_changed == ["b"]


def test_streamed_debounce(spark, tmp_path):
    rows = [("r", f"f{i}", f"2024-01-01 00:00:0{i}") for i in (0, 1, 5)] + [("r", "late", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "root string, file_path string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    query = watch(spark, str(tmp_path / "in"), "root string, file_path string, ts timestamp", lambda df, n: got.extend(df.collect()), checkpoint=str(tmp_path / "c"), trigger="1 second")
    query.processAllAvailable()
    query.stop()
    assert [r.paths for r in sorted(got, key=lambda r: r.start)] == [["f0", "f1"], ["f5"]]
    table = spark.read.schema("root string, file_path string, ts timestamp").json(str(tmp_path / "in"))
    assert debounced(table).count() == 3


def test_loaders(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"queries": [{"id": "1", "query_text": "q", "relevant_docs": ["a", "b"]}]}')
    queries, relevant = files.load_benchmark(spark, str(tmp_path / "b.json"))
    assert queries.count() == 1 and {r.item for r in relevant.collect()} == {"a", "b"}
    (tmp_path / "t.jsonl").write_text('{"prompt": "' + "x" * 600 + '", "metadata": {"task_id": "repo/1"}}\n')
    task = files.load_queries(spark, str(tmp_path / "t.jsonl"), repository="repo").first()
    assert len(task["query"]) == 500
    rows = spark.createDataFrame([("@types/a", [], "{}"), ("b", ["b.d.ts"], "{}"), ("c", [], '{"types": "x.d.ts", "version": "1.0"}'), ("d", [], "{}")], "name string, entries array<string>, manifest string")
    assert {r.name: r.kind for r in files.classify_script_packages(rows).collect()} == {"@types/a": "types", "b": "named", "c": "manifest"}
    stubs = spark.createDataFrame([("types_x", []), ("y-stubs", []), ("z", ["py.typed"]), ("w", [])], "name string, entries array<string>")
    versions = spark.createDataFrame([("x", "2.0"), ("y-stubs", "1.0")], "package string, version string")
    assert {r.name: r.version for r in files.classify_stubs(stubs, versions).collect()} == {"types_x": "2.0", "y-stubs": "1.0", "z": None}


def test_line_search_and_links(spark):
    rows = spark.createDataFrame([("a", "x\nfoo one\ny"), ("b", "foo\nfoo\nfoo\nfoo")], "file_path string, text string")
    assert {r.file_path: r.n_matches for r in files.matching_lines(rows, ["foo"]).collect()} == {"a": 1, "b": 3}
    docs = spark.createDataFrame([("docs/api/load.md", ["load_config"]), ("README.md", [])], "doc_path string, symbols array<string>")
    sources = spark.createDataFrame([("src/api/load.py",), ("main.py",), ("lib/x.py",)], "file_path string")
    symbols = spark.createDataFrame([("lib/x.py", "load_config")], "file_path string, symbol string")
    links = {(r.doc_path, r.file_path, r.kind) for r in graph.document_links(docs, sources, symbols).collect()}
    assert links == {("docs/api/load.md", "lib/x.py", "symbol"), ("docs/api/load.md", "src/api/load.py", "hierarchy"), ("README.md", "main.py", "proximity"), ("README.md", "lib/x.py", "proximity")}


def test_cached_embeddings(spark):
    import numpy as np

    from tarn.functions import embed

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    cache = spark.createDataFrame([], "key string, embedding array<float>")
    rows = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None)], "id int, text string")
    out, cache = embed.embed_cached(rows, "text", load, cache)
    assert {r.id: list(r.embedding) for r in out.collect()} == {1: [3.0, 1.0], 2: [5.0, 1.0], 3: [3.0, 1.0], 4: [0.0, 1.0]}
    assert cache.count() == 3

    def refuse():
        def run(texts):
            assert texts == ["new"]
            return np.array([[9.0, 9.0]] * len(texts))

        return run

    again, grown = embed.embed_cached(rows.unionAll(spark.createDataFrame([(5, "new")], "id int, text string")), "text", refuse, cache)
    assert {r.id: list(r.embedding) for r in again.collect()}[5] == [9.0, 9.0] and grown.count() == 4


def test_package_directories(spark, tmp_path):
    from tarn.sources import files

    for name in ("types_x/__init__.pyi", "plain/a.py", "plain/inner/b.py", "@types/node/index.d.ts", "top.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["name"]: r.entries for r in files.package_directories(spark, str(tmp_path)).collect()}
    assert got == {"types_x": ["__init__.pyi"], "plain": ["a.py", "inner"], "@types/node": ["index.d.ts"]}
    stubs = files.classify_stubs(files.package_directories(spark, str(tmp_path)), spark.createDataFrame([("x", "1.0")], "package string, version string"))
    assert [(r["name"], r.kind, r.version) for r in stubs.collect()] == [("types_x", "prefix", "1.0")]


def test_script_concepts_read_strings_comments_and_methods():
    from tarn.sources.code import script_concepts

    code = 'const a = "{ // no comment";\n/* two\nlines */\nexport default function () {\n  return `}`;\n}\nclass K {\n  get v() { return 1; }\n  async *walk(x) {\n    if (x) { go(); }\n  }\n  f = (y) => { return y; };\n}\ntype T = { a: string };\nconst later = async function () {};\n'
    got = {(s, k, a, b, p) for s, k, a, b, p in script_concepts(code)}
    assert got == {("comment_2", "comment", 2, 3, None), ("anonymous", "function", 4, 6, None), ("K", "class", 7, 13, None), ("v", "method", 8, 8, "K"), ("walk", "method", 9, 11, "K"), ("f", "method", 12, 12, "K"), ("T", "class", 14, 14, None), ("later", "function", 15, 15, None)}
