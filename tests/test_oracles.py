"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from tarn.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(map(plain, value))
    kind = type(value).__name__
    if "float" in kind or kind == "Decimal":
        return round(float(value), 6)
    if "bool" in kind:
        return bool(value)
    return int(value) if "int" in kind else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    mine, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
