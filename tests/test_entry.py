"""Registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF



@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


# The queries of the optional subpackage have their own tests.
@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n not in E.LLM_QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = E.queries()[name](spark, SF)
    cursor = duck.execute(E.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted([tuple(plain(v) for v in r) for r in cursor.fetchall()])
    got = sorted([tuple(plain(r[c]) for c in columns) for r in frame.collect()])
    assert got == expected


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
