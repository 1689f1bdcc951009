"""Query and text functions as column expressions (no Python in the plan)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never search terms of code.
CODE_KEYWORDS = (
    "def class import from return if else elif for while try except with as self true false none null var let const function this super new"
).split()
# Words dropped from questions in natural language.
STOP_WORDS = (
    "how what where when why which who whom does do is are was were be been being have has had can could would should will "
    "the a an in on at to for of with by from as into through about and or but if then else this that these those it its"
).split()


def _folding() -> tuple[str, str]:
    """Letters with diacritics below U+0250 and from U+1E00 to U+1EFF, and their base letters, by decomposition."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and unicodedata.category(base[1]) == "Mn" and base[0].isalpha():
            pairs.append((chr(cp), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _FROM, _TO)


def tokens(text: Column) -> Column:
    """Full-text tokens: folded runs of letters and digits (an underscore separates)."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def first_distinct(words: Column, most: int) -> Column:
    """The first ``most`` words that differ ignoring case, in order, in one pass over the words."""
    none = F.array().cast("array<string>")

    def step(s: Column, w: Column) -> Column:
        new = (F.size(s["low"]) < most) & ~F.array_contains(s["low"], F.lower(w))
        return F.when(new, F.struct(F.concat(s["low"], F.array(F.lower(w))).alias("low"), F.concat(s["words"], F.array(w)).alias("words"))).otherwise(s)

    return F.aggregate(words, F.struct(none.alias("low"), none.alias("words")), step, lambda s: s["words"])


def search_terms(query: Column, most: int = 20) -> Column:
    """The first ``most`` identifiers of three or more characters that differ ignoring case."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"), F.lit(0))
    return first_distinct(found, most)


def sanitize_query(query: Column) -> Column:
    """Full-text query text: prefix terms joined by OR; two double quotes if there is no term."""
    terms = search_terms(query)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(t, F.lit("*"))), " OR ")).otherwise(F.lit('""'))


def code_query(code: Column, most: int = 30) -> Column:
    """Search words of a piece of code: parts of camel-case and snake-case names and the names
    themselves, then calls of the form a.b as words."""
    code = F.coalesce(code, F.lit(""))
    names = F.regexp_extract_all(code, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"), F.lit(0))
    names = F.filter(names, lambda w: ~F.array_contains(F.array(*map(F.lit, CODE_KEYWORDS)), F.lower(w)))

    def spread(w: Column) -> Column:
        camel = F.regexp_extract_all(w, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"), F.lit(0))
        snake = F.filter(F.split(w, "_"), lambda x: F.length(x) > 1)
        none = F.array().cast("array<string>")
        return F.concat(
            F.when(F.size(camel) > 1, camel).otherwise(none),
            F.when(F.contains(w, F.lit("_")) & (F.size(F.split(w, "_")) > 1), snake).otherwise(none),
            F.array(w),
        )

    calls = F.regexp_extract_all(code, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    called = F.flatten(F.transform(calls, lambda c: F.array(F.replace(c, F.lit("."), F.lit(" ")), F.substring_index(c, ".", -1))))
    words = F.filter(F.concat(F.flatten(F.transform(names, spread)), called), lambda w: F.length(w) > 1)
    return F.array_join(first_distinct(words, most), " ")


def keywords(question: Column) -> Column:
    """A question without its stop words; a stop word written like code stays unless it is in Title Case."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(question, F.lit("")), r"[^\w\s]", " "), r"\s+"), lambda w: w != "")
    stop = F.array(*map(F.lit, STOP_WORDS))

    def stays(w: Column) -> Column:
        mixed = w.rlike("[A-Z]") & w.rlike("[a-z]")
        code = F.contains(w, F.lit("_")) | mixed | (w.rlike("[A-Z]") & ~w.rlike("[a-z]") & (F.length(w) > 1))
        title = w.rlike("^[A-Z][a-z]*$")
        return ~F.array_contains(stop, F.lower(w)) | (code & ~title)

    return F.array_join(F.filter(words, stays), " ")


# Words in inline code of documentation that name no symbol.
NOT_SYMBOLS = (
    "true false null undefined int str bool void const let var function class import from return note warning example usage description parameters returns"
).split()


def doc_symbols(text: Column) -> Column:
    """Code-like references between backquotes, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`([a-zA-Z_][a-zA-Z0-9_.\-/]*)`"), F.lit(1))
    likely = lambda w: (
        ~F.array_contains(F.array(*map(F.lit, NOT_SYMBOLS)), F.lower(w)) & w.rlike("[A-Za-z]") & (w.rlike(r"[_./\-]") | w.rlike("[a-z][A-Z]") | (w.rlike("[A-Z]") & ~w.rlike("[a-z]") & (F.length(w) > 2)))
    )
    return F.array_sort(F.array_distinct(F.filter(found, likely)))


def _lines(message: Column) -> Column:
    return F.split(F.coalesce(message, F.lit("")), "\n")


# The patterns of lines and merge messages below.
BREAKING, FEATURE, FIX = r"(?i)breaking|^!:", r"(?i)^(feat|feature|add):", r"(?i)^(fix|bug):"
MERGE_BRANCH, MERGE_REQUEST = r"Merge\s+branch\s+'([^']+)'(?:\s+into\s+'([^']+)')?", r"Merge\s+pull\s+request.*from\s+(\S+)"
VERSION = r"^v?(\d+\.\d+\.\d+)"


def breaking_changes(message: Column) -> Column:
    return F.transform(F.filter(_lines(message), lambda x: x.rlike(BREAKING)), lambda x: F.trim(x))


def feature_lines(message: Column) -> Column:
    return F.transform(F.filter(_lines(message), lambda x: x.rlike(FEATURE)), lambda x: F.trim(x))


def fix_lines(message: Column) -> Column:
    return F.transform(F.filter(_lines(message), lambda x: x.rlike(FIX)), lambda x: F.trim(x))


def merge_branches(message: Column) -> tuple[Column, Column]:
    """Source and target branch of a merge message; null where it names none."""
    part = lambda pattern, g: F.nullif(F.regexp_extract(message, pattern, g), F.lit(""))
    return F.coalesce(part(MERGE_BRANCH, 1), part(MERGE_REQUEST, 1)), part(MERGE_BRANCH, 2)


def version(tag: Column) -> Column:
    return F.nullif(F.regexp_extract(tag, VERSION, 1), F.lit(""))


def char_count(code: Column) -> Column:
    """Characters that are neither blank, newline nor tab."""
    return F.length(F.translate(code, " \n\t", ""))


def preview(code: Column, n: int = 100) -> Column:
    return F.replace(F.substring(code, 1, n), F.lit("\n"), F.lit(" "))


def changelog_summary(original: Column, generated: Column) -> Column:
    """A tag's own summary if there is no other or it says something; else the generated one."""
    telling = (F.length(original) > 50) & ~F.contains(F.lower(original), F.lit("bump")) & ~F.contains(F.lower(original), F.lit("release"))
    return F.when(generated.isNull() | (generated == "") | telling, original).otherwise(generated)


def timeline_summary(original: Column, generated: Column) -> Column:
    """The generated summary for a short merge message, else both."""
    merge = F.contains(F.lower(original), F.lit("merge")) & (F.length(original) < 100)
    return F.when(generated.isNull() | (generated == ""), original).when(merge, generated).otherwise(F.concat(original, F.lit(" — "), generated))


# Words that a line search leaves out.
GREP_STOP_WORDS = (
    "what how when where why who which does do did is are was were the a an and or but in on at to for of from by with"
).split()


def grep_keywords(question: Column) -> Column:
    """Quoted phrases, then words of more than two characters in lower case that are no stop words."""
    quoted = F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1))
    words = F.split(F.trim(F.lower(F.regexp_replace(question, '"[^"]+"', ""))), r"\s+")
    return F.concat(quoted, F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*map(F.lit, GREP_STOP_WORDS)), w)))
