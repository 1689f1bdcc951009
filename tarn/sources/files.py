"""Source files: listing, ignore patterns, languages, documentation and project markers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.languages import language_of

MAX_MB = 5


def glob_regex(pattern: str) -> str:
    """Regular expression of an ignore pattern over paths relative to the root: ``*`` and ``?`` stay within a
    name, ``**`` spans directories, a pattern without a slash holds at any depth, a trailing slash means directories."""
    directory, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    body, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            body, i = body + "[" + p[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + body + ("/" if directory else "(?:/|$)")


def nested_patterns(directory: str, lines: list[str]) -> list[str]:
    """Patterns of an ignore file: blanks and comments dropped, those of a nested directory prefixed with
    it unless they start with a slash; a negation keeps its mark in front."""
    out = []
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            mark = "!" if line.startswith("!") else ""
            rest = line[len(mark) :]
            out.append(line if not directory or rest.startswith("/") else f"{mark}{directory}/{rest}")
    return out


# What is left out unless a later pattern takes it back in.
DEFAULT_EXCLUDES = "node_modules/ __pycache__/ .git/ venv/ *venv build dist .venv/ *.pyc *.pyo *.so *.dylib .pci/".split()


def patterns_of(own: list[str], ignore_files: dict[str, list[str]] | None = None) -> list[str]:
    """Default patterns, a project's own, and those of its ignore files (``directory: lines``), each once, in this order."""
    found = [p for directory in sorted(ignore_files or {}) for p in nested_patterns(directory, ignore_files[directory])]
    return list(dict.fromkeys([*DEFAULT_EXCLUDES, *own, *found]))


def repo_relative(path: Column, root: str) -> Column:
    """A path relative to the repository: forward slashes, without the root and leading dots."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(plain, rf"^{re.escape(root.rstrip('/'))}/", ""), r"^(?:\./)+", "")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: the last pattern that matches decides."""
    out = F.lit(False)
    for p in patterns:
        hit = path.rlike(glob_regex(p[1:] if p.startswith("!") else p))
        out = F.when(hit, F.lit(not p.startswith("!"))).otherwise(out)
    return out


def _at(name: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name, with or without a scheme."""
    plain = re.sub(r"^file:/+", "/", name)
    return (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)


def _below(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int, float]]:
    """Path, size and time in whole seconds of every file below a folder but for version control's own; links to folders are not followed."""
    if isinstance(system, fs.LocalFileSystem):
        for here, inner, names in os.walk(folder):
            inner[:] = [d for d in inner if d != ".git"]
            for name in names:
                path = f"{here.rstrip('/')}/{name}"
                if os.path.isfile(path):
                    found = os.stat(path)
                    yield path, found.st_size, float(int(found.st_mtime))
    else:
        for x in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            if x.type == fs.FileType.File and "/.git/" not in x.path:
                yield x.path, x.size, float((x.mtime_ns or 0) // 10**9)


def list_files(spark: SparkSession, root: str, *, patterns: list[str] = (), max_mb: float = MAX_MB, content: bool = False, glob: str | None = None) -> DataFrame:
    """``file_path, rel_path, mtime, size, language`` and ``content`` if asked for (it is not read otherwise).

    The driver lists the root alone; tasks walk the folders in it.  Names with a leading dot or underscore are
    files like others, which Spark's own readers would skip."""
    system, top = _at(root)
    top = top.rstrip("/")
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else root.rstrip("/").removesuffix(top)
    entries = system.get_file_info(fs.FileSelector(top))
    starts = [(x.path, x.type == fs.FileType.Directory) for x in entries if x.base_name != ".git"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _at(root)
        for batch in batches:
            for path, folder in zip(*(batch.column(i).to_pylist() for i in range(2))):
                found = _below(system, path) if folder else ((x.path, x.size, float((x.mtime_ns or 0) // 10**9)) for x in system.get_file_info([path]))
                while part := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.string(), pa.int64(), pa.float64()))], ["path", "size", "mtime"])

    rows = spark.createDataFrame(starts, "path string, folder boolean").repartition(max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism)))
    rows = rows.mapInArrow(walk, "path string, size long, mtime double").withColumn("rel_path", F.substring("path", len(top) + 2, 1 << 20))
    rows = rows.filter((F.col("size") > 0) & (F.col("size") <= int(max_mb * 1024 * 1024))).filter(~ignored(F.col("rel_path"), list(patterns)))
    if glob:
        rows = rows.filter(F.element_at(F.split("rel_path", "/"), -1).rlike(glob_regex(glob)))
    out = rows.select(F.concat(F.lit(prefix), "path").alias("file_path"), "rel_path", "mtime", "size", language_of(F.col("path")).alias("language"))
    return with_content(out) if content else out


def with_content(rows: DataFrame, path: str = "file_path") -> DataFrame:
    """``rows`` with the bytes of each file as ``content``, read where the rows are; null where a file is gone."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for at in range(batch.num_rows):  # one file at a time: files are up to some megabytes each
                part = batch.slice(at, 1)
                system, inner = _at(part.column(path)[0].as_py())
                try:
                    with system.open_input_file(inner) as file:
                        content = file.read()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content], pa.binary())], [*part.schema.names, "content"])

    return rows.mapInArrow(read, StructType([*rows.schema.fields]).add("content", "binary"))


def ignore_files(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Lines of every ``.gitignore`` below ``root`` by its directory, relative to the root; only these few short files are collected."""
    found = with_content(list_files(spark, root, glob=".gitignore")).filter("content is not null")
    directory = F.regexp_replace("rel_path", r"/?\.gitignore$", "")
    return {r.d: r.lines for r in found.select(directory.alias("d"), F.split(text_of(F.col("content")), "\n").alias("lines")).collect()}


def text_of(content: Column) -> Column:
    """UTF-8 text of a file; malformed bytes become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def documentation(files: DataFrame) -> DataFrame:
    """Readme, contributing and changelog files of the root, and markdown anywhere."""
    name = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    top = ~F.contains("rel_path", F.lit("/")) & name.rlike(r"^(readme|contributing|changelog)(\.|$)")
    return files.filter(top | name.endswith(".md")).dropDuplicates(["file_path"])


def matching_lines(files: DataFrame, words: list[str], *, per_file: int = 3, context: int = 5, most: int = 10, path: str = "file_path", text: str = "text") -> DataFrame:
    """Line search: up to ``per_file`` matching lines of each word and file with lines around them, files with most
    matches first: ``file_path, n_matches, snippets``."""
    rows = files.select(F.col(path).alias("file_path"), F.split(F.col(text), "\n").alias("_lines"))
    probes = F.array(*[F.lit(w) for w in words])
    hits = rows.select("file_path", "_lines", F.explode(probes).alias("word"))
    # the first few matching line numbers of each word, as an array within the row
    at = F.slice(F.filter(F.transform("_lines", lambda x, i: F.when(F.contains(F.lower(x), F.lower(F.col("word"))), i)), lambda i: i.isNotNull()), 1, per_file)
    hits = hits.select("file_path", "_lines", "word", F.explode(at).alias("i"))
    start = F.greatest(F.col("i") - context, F.lit(0))
    snippet = F.array_join(F.slice("_lines", start + 1, F.col("i") - start + context + 1), "\n")
    out = hits.select("file_path", F.struct((F.col("i") + 1).alias("line"), "word", snippet.alias("code")).alias("s"))
    out = out.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_matches"), F.array_sort(F.collect_list("s")).alias("snippets"))
    return out.orderBy(F.desc("n_matches"), "file_path").limit(most)


# Marker files of languages, and the least confidence that some of them give.
MARKERS = {
    "python": ["requirements.txt", "setup.py", "pyproject.toml", "Pipfile", "poetry.lock", "setup.cfg", "tox.ini", "pytest.ini"],
    "typescript": ["tsconfig.json", "package.json"],
    "javascript": ["package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".eslintrc", ".prettierrc"],
    "go": ["go.mod", "go.sum", "Gopkg.toml"],
    "rust": ["Cargo.toml", "Cargo.lock"],
    "java": ["pom.xml", "build.gradle", "settings.gradle", "build.gradle.kts", "gradle.properties"],
    "cpp": ["CMakeLists.txt", "Makefile", "configure.ac", "meson.build"],
    "csharp": ["*.csproj", "*.sln", "*.fsproj", "paket.dependencies"],
    "ruby": ["Gemfile", "Gemfile.lock", ".ruby-version", "Rakefile"],
    "php": ["composer.json", "composer.lock"],
}
LEAST_CONFIDENCE = {"pyproject.toml": 0.90, "setup.py": 0.85, "tsconfig.json": 0.95, "Cargo.toml": 0.95, "go.mod": 0.95, "pom.xml": 0.90}


def detect_languages(root_files: DataFrame, name: str = "name") -> DataFrame:
    """``language, confidence, evidence`` from the names of a root directory, best first."""
    spark = root_files.sparkSession
    rows = [(lang, m, LEAST_CONFIDENCE.get(m, 0.0), i, len(ms)) for lang, ms in MARKERS.items() for i, m in enumerate(ms)]
    markers = spark.createDataFrame(rows, "language string, marker string, least double, pos int, total int")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.col("marker"), F.lit("."), F.lit(r"\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    hits = root_files.select(F.col(name).alias("_name")).join(F.broadcast(markers), F.rlike("_name", pattern))
    found = hits.groupBy("language", "total").agg(F.countDistinct("marker").alias("n"), F.max("least").alias("least"), F.array_sort(F.collect_set(F.struct("pos", "_name"))).alias("e"))
    share = F.greatest(F.least(F.lit(1.0), F.col("n") / F.col("total")), F.col("least"))
    return found.select("language", share.alias("confidence"), F.slice(F.col("e._name"), 1, 5).alias("evidence")).orderBy(F.desc("confidence"), "language")


def profile(languages: DataFrame) -> DataFrame:
    """One row: languages of at least 0.8, whether there are several, and the tier weights that follow."""
    main = F.array_sort(F.collect_list(F.when(F.col("confidence") >= 0.8, F.col("language"))))
    rows = languages.agg(main.alias("primary_languages")).withColumn("multi", F.size("primary_languages") > 1)
    pick = lambda a, b: F.when(F.col("multi"), a).otherwise(b)
    return rows.select("primary_languages", "multi", F.lit(1.0).alias("project"), pick(0.5, 0.7).alias("dependency"), pick(0.3, 0.5).alias("stdlib"), pick(0.8, 0.9).alias("documentation"))


def package_directories(spark: SparkSession, root: str) -> DataFrame:
    """``name, entries``: the packages in a directory of installed ones (two levels for names with ``@``) and the names in each."""
    parts = F.split("rel_path", "/")
    scoped = F.startswith(parts[0], F.lit("@"))
    rows = list_files(spark, root).select(F.when(scoped, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1))).otherwise(parts[0]).alias("name"), F.when(scoped, F.get(parts, 2)).otherwise(F.get(parts, 1)).alias("entry"))
    return rows.filter("entry is not null").groupBy("name").agg(F.array_sort(F.collect_set("entry")).alias("entries"))


def classify_stubs(directories: DataFrame, versions: DataFrame) -> DataFrame:
    """Type-stub packages among directories ``name, entries``: prefix ``types_`` or ``types-``, suffix ``-stubs`` or ``_stubs``, or
    marker files inside; versions by their name, else by the package they are for."""
    n = F.col("name")
    kind = F.when(n.rlike("^types[_-]"), "prefix").when(n.rlike("[-_]stubs$"), "suffix").when(F.arrays_overlap("entries", F.array(F.lit("__init__.pyi"), F.lit("py.typed"))), "typed")
    rows = directories.withColumn("kind", kind).filter("kind is not null").withColumn("target", F.regexp_replace(F.regexp_replace(n, "^types[_-]", ""), "[-_]stubs$", ""))
    v = versions.select(F.col("package").alias("_p"), F.col("version").alias("_v"))
    own, other = v.withColumnsRenamed({"_p": "_p1", "_v": "_v1"}), v.withColumnsRenamed({"_p": "_p2", "_v": "_v2"})
    rows = rows.join(own, F.col("name") == F.col("_p1"), "left").join(other, F.col("target") == F.col("_p2"), "left")
    return rows.select("name", "target", "kind", F.coalesce("_v1", "_v2").alias("version"))


def parse_uri(uri: Column) -> list[Column]:
    """File path and lines of ``pci://path#a-b``; malformed parts give ``unknown`` and line 1."""
    path = F.nullif(F.regexp_extract(uri, r"^pci://([^#]+)", 1), F.lit(""))
    line = lambda g: F.coalesce(F.regexp_extract(uri, "#([0-9]+)-([0-9]+)$", g).try_cast("int"), F.lit(1))
    return [F.coalesce(path, F.lit("unknown")).alias("file_path"), line(1).alias("start_line"), line(2).alias("end_line")]


def load_queries(spark: SparkSession, path: str, *, repository: str | None = None, most: int | None = None) -> DataFrame:
    """Completion tasks from JSON lines: the query is the last 500 characters of the prompt."""
    rows = spark.read.json(path)
    meta = "metadata." if "metadata" in rows.columns else ""
    out = rows.select(F.col(f"{meta}task_id").alias("task_id"), F.substring_index(F.col(f"{meta}task_id"), "/", 1).alias("repository"), F.expr("right(prompt, 500)").alias("query"))
    if repository:
        out = out.filter(F.col("repository") == repository)
    return out.limit(most) if most else out


def load_benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (``id, query_text``) and relevant documents (``query_id, item``) of a retrieval set in one JSON document."""
    schema = "queries array<struct<id:string,query_text:string,relevant_docs:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("queries").alias("q"))
    return rows.select("q.id", "q.query_text"), rows.select(F.col("q.id").alias("query_id"), F.explode("q.relevant_docs").alias("item"))


def classify_script_packages(packages: DataFrame) -> DataFrame:
    """Typed script packages among ``name, entries, manifest`` (the package file as JSON text): those under ``@types``, with a
    declaration file named index or like the package, or that name their types in the manifest."""
    bare = F.element_at(F.split("name", "/"), -1)
    typed = F.coalesce(F.get_json_object("manifest", "$.types"), F.get_json_object("manifest", "$.typings"))
    kind = (
        F.when(F.col("name").startswith("@types/"), "types").when(F.array_contains("entries", "index.d.ts"), "index")
        .when(F.array_contains("entries", F.concat(bare, F.lit(".d.ts"))), "named").when(typed.isNotNull(), "manifest")
    )
    return packages.withColumn("kind", kind).filter("kind is not null").select("name", "kind", F.get_json_object("manifest", "$.version").alias("version"))
