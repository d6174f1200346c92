"""Registered queries against their SQL twins over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from sigmill.plans import registry

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.execute(SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == columns
    theirs = sorted((tuple(plain(x[at.index(c)]) for c in columns) for x in r.fetchall()), key=str)
    assert ours == theirs
