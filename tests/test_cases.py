"""Rules on small stated inputs, whose results stand as VALUES."""

from __future__ import annotations

import cases
import duckdb
import pytest


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    df = cases.QUERIES[name](spark, "")
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    told = duckdb.sql(cases.ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    assert got == sorted(map(repr, told.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
