"""Every query of the library against its SQL, run by another engine on the same tables."""

import os

import duckdb
import pytest

from tracklake.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(round(float(v), 5) + 0.0) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    got, found = df.collect(), oracle.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns, at = sorted(df.columns), {c: i for i, c in enumerate(found.columns)}
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got) == sorted(tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall())
