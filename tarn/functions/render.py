"""Text and markdown renderings of memory rows, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _section(title: str, items: Column) -> Column:
    listed = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"\n\n### {title}\n"), listed)).otherwise("")


def changelog_markdown(tag: Column, date: Column, summary: Column, breaking: Column, features: Column, fixes: Column) -> Column:
    head = F.concat(F.lit("## "), tag, F.lit(" ("), F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("Unknown")), F.lit(")\n\n"), F.coalesce(summary, F.lit("")))
    return F.concat(head, _section("Breaking Changes", breaking), _section("Features", features), _section("Fixes", fixes))


def timeline_line(kind: Column, from_ref: Column, to_ref: Column, importance: Column, at: Column) -> Column:
    return F.format_string("[%s] %s: %s → %s (%s)", F.date_format(at, "yyyy-MM-dd"), kind, from_ref, to_ref, importance)


def timeline_markdown(kind: Column, from_ref: Column, to_ref: Column, summary: Column, at: Column) -> Column:
    return F.concat(F.format_string("- **%s** %s: %s → %s", F.date_format(at, "yyyy-MM-dd"), kind, from_ref, to_ref), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("\n  "), summary)).otherwise(""))


def decision_line(number: Column, title: Column, status: Column, description: Column) -> Column:
    return F.format_string("#%d [%s] %s: %s", number, status, title, F.substring(F.replace(description, F.lit("\n"), F.lit(" ")), 1, 80))


def timeline_page(kind: Column, from_ref: Column, to_ref: Column, summary: Column, importance: Column, files: Column, at: Column) -> Column:
    """An event as a section of a page."""
    none = lambda c: F.coalesce(c, F.lit(""))
    head = F.format_string("## %s - %s → %s\n**Type:** %s | **Importance:** %s\n\n%s\n", F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit("Unknown")), none(from_ref), none(to_ref), none(kind), none(importance), none(summary))
    n = F.size(F.coalesce(files, F.array().cast("array<string>")))
    return F.concat(head, F.when(n > 0, F.format_string("\n**Files changed:** %d\n", n)).otherwise(""))


def timeline_text(kind: Column, from_ref: Column, to_ref: Column, summary: Column, importance: Column, at: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    when = F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("Unknown"))
    return F.format_string("[%s] %s\n  %s: %s → %s\n  %s\n", F.upper(none(importance)), when, none(kind), none(from_ref), none(to_ref), none(summary))


def changelog_text(tag: Column, date: Column, summary: Column) -> Column:
    return F.format_string("%s (%s)\n  %s\n", F.coalesce(tag, F.lit("")), F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("Unknown")), F.coalesce(summary, F.lit("")))
