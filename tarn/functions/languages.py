"""Languages by file extension, and index tiers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of each file extension.
EXTENSIONS = {
    "py": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript",
    "jsx": "jsx",
    "tsx": "tsx",
    "java": "java",
    "kt": "kotlin", "kts": "kotlin",
    "groovy": "groovy",
    "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp",
    "go": "go",
    "rs": "rust",
    "hs": "haskell",
    "swift": "swift",
    "sh": "bash", "bash": "bash",
    "m": "matlab",
    "makefile": "makefile", "mk": "makefile",
    "objc": "objective_c",
    "php": "php",
    "rb": "ruby",
    "vue": "vue",
    "svelte": "svelte",
    "zig": "zig",
    "json": "json",
    "yaml": "yaml", "yml": "yaml",
    "toml": "toml",
    "hcl": "hcl", "tf": "hcl",
    "md": "markdown", "markdown": "markdown",
    "txt": "text",
    "pdf": "pdf",
}
TIER_BOOST = {"project": 1.0, "dependency": 0.7, "stdlib": 0.5}


def _map(pairs: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def language_of(path: Column) -> Column:
    """Language of a path's extension whatever its case; ``unknown`` without a known one."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(_map(EXTENSIONS), extension), F.lit("unknown"))


def boost_of(tier: Column, boosts: dict[str, float] | None = None) -> Column:
    """Weight of a tier: a missing one is ``project``, an unknown one weighs 1."""
    return F.coalesce(F.try_element_at(_map(boosts or TIER_BOOST), F.coalesce(tier, F.lit("project"))), F.lit(1.0))
