"""Settings of a project: defaults, typed values from text, nested names."""

from __future__ import annotations

import copy

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are read as booleans.
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")

DEFAULTS: dict[str, dict[str, object]] = {
    "indexing": {"exclude_patterns": [], "max_file_size_mb": 5},
    "chunking": {"max_chunk_size": 1200, "merge_threshold": 0.8, "greedy_merge": True},
    "search": {"default_limit": 10, "vector_weight": 0.7, "include_dependencies": True, "project_boost": 1.0, "dependency_boost": 0.7, "stdlib_boost": 0.5},
    "embedding": {"dimensions": 64},
}


def typed(value: Column) -> list[Column]:
    """``kind`` of a setting given as text (boolean, integer, float or string, in this order) and its ``value`` as that kind shows it."""
    low = F.lower(value)
    whole, real = value.try_cast("long"), value.try_cast("double")
    is_true, is_false = low.isin(*TRUE), low.isin(*FALSE)
    kind = F.when(is_true | is_false, "boolean").when(whole.isNotNull() & value.rlike(r"^\s*[+-]?\d+\s*$"), "integer").when(real.isNotNull(), "float").otherwise("string")
    shown = F.when(is_true, "true").when(is_false, "false").when(kind == "integer", whole.cast("string")).when(kind == "float", real.cast("string")).otherwise(value)
    return [kind.alias("kind"), shown.alias("value")]


def parse(value: str) -> bool | int | float | str:
    if value.lower() in TRUE or value.lower() in FALSE:
        return value.lower() in TRUE
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def merged(own: dict) -> dict:
    """The defaults with a project's own settings over them."""
    out = copy.deepcopy(DEFAULTS)
    for section, values in own.items():
        out.setdefault(section, {}).update(values)
    return out


def changed(own: dict, name: str, value: object) -> dict:
    """A project's own settings with ``section.name`` set; the name must be one of the defaults and the kind theirs."""
    section, _, key = name.partition(".")
    if key not in DEFAULTS.get(section, {}):
        raise KeyError(f"no setting {name}")
    default = DEFAULTS[section][key]
    if isinstance(default, float) and isinstance(value, int):
        value = float(value)
    if isinstance(default, list) and isinstance(value, str):
        value = [x for x in value.split(",") if x]
    if type(value) is not type(default):
        raise ValueError(f"{name} is of kind {type(default).__name__}")
    out = copy.deepcopy(own)
    out.setdefault(section, {})[key] = value
    return out
