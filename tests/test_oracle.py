"""Each query with SQL gives the rows that DuckDB gives."""

import os

import pytest

from caselattice.plans import registry

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def flat(v):
    if v is None or v != v:
        return None
    return round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(flat(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"stability", "versus_shuffled", "cop_kmeans"}))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_flagship(spark):
    assert registry.flagship(spark, DIR).count() > 0
