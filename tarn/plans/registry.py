"""All registered queries with their SQL."""

from . import chunks, commits, project, search, source_code, upkeep

QUERIES = search.QUERIES | chunks.QUERIES | project.QUERIES | upkeep.QUERIES | source_code.QUERIES | commits.QUERIES
ORACLES = search.ORACLES | chunks.ORACLES | project.ORACLES | upkeep.ORACLES | source_code.ORACLES | commits.ORACLES
