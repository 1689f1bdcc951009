"""Command line: python -m tarn.cli --root INDEX COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Project
from .functions import render
from .functions.text import preview
from .operators.memory import changelogs, timeline, with_status
from .operators.retrieve import dependencies_only


def emit(out: str, output: str | None) -> None:
    if output:
        with open(output, "w") as file:
            file.write(out)
    else:
        print(out, end="" if out.endswith("\n") else "\n")


def show(rows: DataFrame, form: str, output: str | None = None) -> None:
    """Print a bounded result, or write it to a file, as text, a table, JSON lines or CSV."""
    if form == "json":
        out = "\n".join(rows.toJSON().collect()) + "\n"
    elif form == "csv":
        out = rows.toPandas().to_csv(index=False)
    elif form == "table":
        out = table(rows.columns, [["" if v is None else str(v) for v in r] for r in rows.limit(100).collect()])
    else:
        out = rows._show_string(100, 80, False)
    emit(out, output)


def timeline_of(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The newest 100 events, then those of a type, an importance and since a time among them."""
    since = F.lit(a.since).cast("timestamp_ntz") if a.since else None
    rows = timeline(rows, n=100, event_type=a.event_type, since=since)
    return rows.filter(F.col("importance") == a.importance) if a.importance else rows


def pages(rows: DataFrame, name: str, form: str, title: str) -> str:
    """At most 100 events or changelogs in a form: a JSON array, markdown under a title, or text."""
    if form == "json":
        return json.dumps([json.loads(x) for x in rows.toJSON().collect()], indent=2, ensure_ascii=False) + "\n"
    if name == "timeline":
        parts = ("event_type", "from_ref", "to_ref", "summary", "importance")
        page = render.timeline_page(*map(F.col, parts), F.col("files_changed"), F.col("created_at")) if form == "markdown" else render.timeline_text(*map(F.col, parts), F.col("created_at"))
    elif form == "markdown":
        page = render.changelog_markdown(F.coalesce("tag", F.lit("")), F.col("date"), F.col("summary"), F.col("breaking_changes"), F.col("features"), F.col("fixes"))
    else:
        page = render.changelog_text(F.col("tag"), F.col("date"), F.col("summary"))
    found = [r.page for r in rows.select(page.alias("page")).collect()]
    return "\n".join([f"# {title}\n", *found] if form == "markdown" else found) + "\n"


def table(names: list[str], rows: list[list[str]], most: int = 60) -> str:
    """Rows between rules, each column as wide as its longest value."""
    cut = [[v.replace("\n", " ")[:most] for v in r] for r in [names, *rows]]
    wide = [max(len(r[i]) for r in cut) for i in range(len(names))]
    lines = [" │ ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in cut]
    return "\n".join([lines[0], "─┼─".join("─" * w for w in wide), *lines[1:]]) + "\n"


def results(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("file_path").alias("File"), F.col("start_line").alias("Start Line"), F.col("end_line").alias("End Line"), F.col("symbol").alias("Symbol"), F.format_string("%.3f", "score").alias("Score"), preview(F.col("code")).alias("Preview"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tarn")
    parser.add_argument("--root", required=True)
    parser.add_argument("--format", choices=("text", "table", "json", "csv"), default="text")
    parser.add_argument("--output")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [commands.add_parser(name)] and [commands.choices[name].add_argument(*a, **k) for a, k in args]
    add("index", (["path"], {}), (["--ignore"], {"action": "append", "default": []}), (["--tier"], {"default": "project"}), (["--git"], {}))
    add("search", (["query"], {}), (["-k"], {"type": int, "default": 10}), (["--mode"], {"choices": ("hybrid", "lexical", "semantic"), "default": "hybrid"}), (["--no-deps"], {"action": "store_true"}), (["--deps-only"], {"action": "store_true"}))
    add("files", (["query"], {}), (["-k"], {"type": int, "default": 10}), (["--how"], {"choices": ("sum", "max"), "default": "sum"}))
    add("research", (["question"], {}), (["--hops"], {"type": int, "default": 2}))
    add("status")
    add("init")
    add("config", (["name"], {"nargs": "?"}), (["value"], {"nargs": "?"}))
    add("watch", (["path"], {}), (["events"], {}), (["--checkpoint"], {"required": True}), (["--seconds"], {"type": int}))
    add("search-memory", (["words"], {}), (["-k"], {"type": int, "default": 10}), (["--all"], {"action": "store_true"}))
    add("search-all", (["query"], {}), (["-k"], {"type": int, "default": 10}))
    add("interactive", (["-k"], {"type": int, "default": 5}))
    add("add-event", (["type"], {}), (["from_ref"], {}), (["to_ref"], {}), (["summary"], {}), (["--importance"], {"choices": ("high", "medium", "low"), "default": "medium"}))
    add("add-changelog", (["tag"], {}), (["summary"], {}))
    add("import", (["path"], {}))
    add("compact", (["--threshold"], {"type": float, "default": 0.2}))
    add("decide", (["title"], {}), (["description"], {}))
    add("approve", (["id"], {"type": int}), (["category"], {}))
    add("reject", (["id"], {"type": int}))
    add("memory", (["table"], {"choices": ("decisions", "timeline", "changelogs")}), (["--status"], {"choices": ("pending", "approved", "rejected")}), (["--limit"], {"type": int, "default": 20}))
    add(
        "sync-git", (["repo"], {}), (["--since"], {}), (["--limit"], {"type": int, "default": 50}), (["--dry-run"], {"action": "store_true"}), (["--tags-only"], {"action": "store_true"}), (["--merges-only"], {"action": "store_true"}),
        (["--min-importance"], {"choices": ("high", "medium", "low"), "default": "low"}),
    )
    form = (["--as"], {"dest": "form", "choices": ("text", "json", "markdown", "table"), "default": "text"})
    add("timeline", (["--event-type"], {}), (["--importance"], {"choices": ("high", "medium", "low")}), (["--since"], {}), form)
    add("changelog", (["range"], {"nargs": "?"}), (["--as"], {"dest": "form", "choices": ("text", "json", "markdown"), "default": "markdown"}))
    add("export", (["path"], {}))
    a = parser.parse_args(argv)
    if a.command == "search" and a.no_deps and a.deps_only:
        parser.error("--no-deps and --deps-only exclude each other")
    project = Project(SparkSession.builder.appName("tarn").getOrCreate(), a.root)
    out = lambda rows: show(rows, a.format, a.output)
    if a.command == "index":
        out(project.index(a.path, patterns=a.ignore, tier=a.tier, repo=a.git).groupBy("change").count())
    elif a.command == "watch":
        query = project.watch(a.events, a.path, checkpoint=a.checkpoint, report=lambda counts: print(json.dumps(counts), flush=True))
        query.awaitTermination(*([a.seconds] if a.seconds else []))
        query.stop()
    elif a.command == "search":
        own = project.settings()["search"]
        boosts = {"project": own["project_boost"], "dependency": own["dependency_boost"], "stdlib": own["stdlib_boost"]}
        found = project.search(a.query, a.k, mode=a.mode, vector_weight=own["vector_weight"], include_deps=not a.no_deps, boosts=boosts)
        out(results(dependencies_only(found) if a.deps_only else found))
    elif a.command == "search-memory":
        out(project.search_memory(a.words, a.k, decisions_only=not a.all))
    elif a.command == "search-all":
        out(project.search_all(a.query, a.k))
    elif a.command == "interactive":
        while query := input("search> ").strip():
            out(results(project.search(query, a.k)))
    elif a.command == "files":
        out(project.search_files(a.query, a.k, a.how))
    elif a.command == "research":
        found, edges = project.research(a.question, a.hops)
        show(found, a.format)
        show(edges, a.format)
    elif a.command == "status":
        out(project.status())
    elif a.command == "init":
        print(json.dumps(project.settings()))
    elif a.command == "config":
        print(json.dumps(project.set(a.name, a.value) if a.value is not None else project.get(a.name) if a.name else project.settings()))
    elif a.command == "compact":
        print("compacted" if project.compact(a.threshold) else "healthy, nothing done")
    elif a.command == "decide":
        print(project.add_decision(a.title, a.description))
    elif a.command in ("approve", "reject"):
        project.decide(a.id, getattr(a, "category", None))
    elif a.command == "memory":
        rows = project.table(a.table)
        if a.table == "decisions":
            out(with_status(rows, a.status).limit(a.limit))
        else:
            out(timeline(rows, n=a.limit) if a.table == "timeline" else changelogs(rows, a.limit))
    elif a.command == "timeline":
        rows = timeline_of(project.table("timeline"), a)
        if a.form == "table":
            route = F.concat("from_ref", F.lit(" → "), "to_ref")
            day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("Unknown"))
            show(rows.select(day.alias("Date"), F.col("event_type").alias("Type"), route.alias("From → To"), F.substring("summary", 1, 40).alias("Summary"), F.col("importance").alias("Importance")), "table", a.output)
        else:
            emit(pages(rows, "timeline", a.form, "Project Timeline"), a.output)
    elif a.command == "changelog":
        first, _, last = (a.range or "").partition("..")
        emit(pages(changelogs(project.table("changelogs"), 100, *((first, last) if last else ())), "changelogs", a.form, "Changelog"), a.output)
    elif a.command == "add-event":
        print(project.add_event(a.type, a.from_ref, a.to_ref, a.summary, importance=a.importance))
    elif a.command == "add-changelog":
        print(project.add_changelog(a.tag, a.summary))
    elif a.command == "import":
        print(json.dumps(project.import_memory(a.path)))
    elif a.command == "sync-git":
        print(json.dumps(project.sync_history(a.repo, since=a.since, limit=a.limit, dry_run=a.dry_run, tags=not a.merges_only, merges=not a.tags_only, least=a.min_importance)))
    else:
        project.export(a.path)


if __name__ == "__main__":
    main()
