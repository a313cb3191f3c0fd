"""Every registered query outside the llm subpackage against DuckDB at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from unitscope.plans import registry
from unitscope.plans.views import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "isoformat"):
        return str(value)
    return plain(float(value)) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    rows = registry.QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name not in registry.ORACLE:
        assert got
        return
    answer = duck.sql(registry.ORACLE[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in answer.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)) for a, b in zip(g, w, strict=True)), (g, w)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
