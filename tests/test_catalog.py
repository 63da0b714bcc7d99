"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rigspark import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    want = sorted(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(text(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    rows = registry.entry(spark, SF).collect()
    assert len(rows) == 15 and all(r.gaps > 0 and r.n > 0 for r in rows)
