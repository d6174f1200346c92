"""Registered queries on small tables with rows that the supplied ones seldom have."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest

from sigmill.plans import registry

D = "/root/testdata/sf0.001"


def tables(where: Path, **own: str) -> str:
    """The supplied tables with some of them in other words."""
    for file in os.listdir(D):
        if file.removesuffix(".parquet") not in own:
            os.symlink(f"{D}/{file}", where / file)
    for name, sql in own.items():
        duckdb.sql(f"COPY ({sql}) TO '{where}/{name}.parquet'")
    return str(where)


def equal(spark, d: str, name: str) -> int:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in os.listdir(d):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{d}/{file}'")
    df = registry.queries()[name](spark, d)
    want = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return len(got)


def test_a_text_without_tokens_has_no_digest(spark, tmp_path):
    own = f"SELECT * REPLACE (CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '. a ! b' ELSE text END AS text) FROM '{D}/documents.parquet'"
    assert equal(spark, tables(tmp_path, documents=own), "flt5_tokenize")


@pytest.fixture(scope="module")
def midnight(tmp_path_factory):
    """Events in the last seconds of days, some of which arrive on the next."""
    t = datetime(2024, 1, 1, 23, 59, 53)
    rows = ", ".join(f"({7 * day + i}, TIMESTAMP '{t + timedelta(days=day, seconds=i)}', {i % 2 * 4}, '{'error' if i % 3 else 'view'}', {i}.5, '{{\"k\": {day + i}}}')" for day in range(25) for i in range(7))
    cols = "event_id, ts, user_id, event_type, value, props"
    own = f"SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS user_id, event_type, CAST(value AS DOUBLE) AS value, props FROM (VALUES {rows}) v({cols})"
    return tables(tmp_path_factory.mktemp("midnight"), events=own)


@pytest.mark.parametrize("name", ["src5_sealed_hours", "agg4_histogram_from_summaries", "agg21_measure_from_summaries"])
def test_minutes_that_arrive_in_two_days(spark, midnight, name):
    assert equal(spark, midnight, name)
