"""Registered queries with SQL, held against DuckDB on the given tables."""

import math
import os

import duckdb
import pytest

from caselattice.llm import registry

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
