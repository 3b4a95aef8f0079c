"""Every registered query that has SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from vellum.plans import all_oracles, all_queries

SKIP = set(all_queries()) - set(all_oracles())


def canon(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    got = sorted([canon(r[c]) for c in sorted(df.columns)] for r in df.collect())
    cur = duck.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([canon(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(SKIP))
def test_rows(spark, sf, name):
    assert all_queries()[name](spark, sf).count() > 0
