"""Appends, sealing and answers from what stands beside the rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sigmill.operators import aggregates as agg
from sigmill.operators import predicates as flt
from sigmill.operators import search as srt
from sigmill.plans.views import logs
from sigmill.sources import folders, sealed
from sigmill.sources.tables import HOUR
from sigmill.streaming import streams

D = "/root/testdata/sf0.001"
HALF = sealed.Layout(hours=6, buckets=3)
FROM, TO = "2024-01-10 00:00:00", "2024-01-13 00:00:00"


@pytest.fixture(scope="module")
def rows(spark):
    """Three days of logs, some of them arriving late, a few with no service or a common word."""
    few = logs(spark, D).filter(f"ts >= '{FROM}' and ts < '{TO}'")
    late = F.when(F.col("id") % 7 == 0, F.col("ts") + F.expr("interval 50 minutes")).otherwise(F.col("received_at"))
    odd = {"received_at": late, "service": F.when(F.col("id") % 11 > 0, F.col("service")), "message": F.concat(F.when(F.col("id") % 5 > 0, "common word ").otherwise(""), F.col("message"))}
    return few.withColumns(odd).cache()


@pytest.fixture(scope="module")
def root(spark, rows, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("store"))
    sealed.append_logs(rows.filter("id % 2 = 0"), where, "a", HALF)
    sealed.seal(spark, where, "2024-01-11-12", HALF)
    sealed.append_logs(rows.filter("id % 2 = 1"), where, "b", HALF)
    sealed.append_logs(rows.filter("id % 2 = 1"), where, "b", HALF)
    sealed.seal(spark, where, "2024-01-12-06", HALF)
    return where


def same(a, b):
    key = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert key(a) == key(b)


def spans(n):
    r = random.Random(5)
    for _ in range(n):
        s = datetime(2024, 1, 10) + timedelta(microseconds=r.randrange(3 * 86_400_000_000))
        e = s + timedelta(microseconds=r.choice([r.randrange(90_000_000), r.randrange(3 * 86_400_000_000)]))
        yield str(s), str(e)
    yield "2024-01-10 12:00:00", "2024-01-12 00:00:00"
    yield "2024-01-10 12:00:30", "2024-01-10 12:00:31"


def test_one_row_a_key_whatever_was_repeated(spark, rows, root):
    table = sealed.read(spark, root, "rows")
    assert sorted(r.id for r in table.select("id").collect()) == sorted(r.id for r in rows.select("id").collect())
    for name, keys in (("minutes", sealed.KEYS), ("dictionaries", ("column", "value"))):
        part = sealed.read(spark, root, name).filter(F.col(HOUR) < "2024-01-12-06")
        assert part.filter("append = 'sealed'").count() == part.count() == part.select(HOUR, *keys).distinct().count()
    # An append that was taken in doesn't come back.
    before = table.count()
    sealed.append_logs(rows.filter("id % 2 = 1"), root, "b", HALF)
    assert sealed.read(spark, root, "rows").count() == before


@pytest.mark.parametrize("at", ["before the mark", "after the mark", "half moved"])
def test_a_crash_while_sealing_loses_and_doubles_nothing(spark, rows, tmp_path, monkeypatch, at):
    where = str(tmp_path)
    for name, part in (("a", "id % 2 = 0"), ("b", "id % 2 = 1")):
        sealed.append_logs(rows.filter(part), where, name, sealed.Layout(24, 1))
    calls, move = [], folders.move

    def breaks(*args):
        calls.append(args)
        if at == "after the mark" or len(calls) > 4:
            raise OSError("lost")
        move(*args)

    if at == "before the mark":
        monkeypatch.setattr(folders, "_innermost", lambda *a: breaks() or 1 / 0)
        calls += [0] * 5
    else:
        monkeypatch.setattr(folders, "move", breaks)
    with pytest.raises(OSError):
        sealed.seal(spark, where, None, sealed.Layout(24, 1))
    monkeypatch.undo()
    sealed.seal(spark, where, None, sealed.Layout(24, 1))
    assert sorted(r.id for r in sealed.read(spark, where, "rows").select("id").collect()) == sorted(r.id for r in rows.select("id").collect())
    assert sealed.read(spark, where, "minutes").agg(F.sum("n")).first()[0] == rows.count()
    assert not sealed.open_hours(spark, where) and not [c for c in folders.children(spark, where) if c.startswith(folders.SIDE)]


def test_counts_equal_the_rows_for_any_span(spark, rows, root):
    for s, e in spans(5):
        inside = rows.filter((F.col("ts") >= F.lit(s).cast("timestamp")) & (F.col("ts") <= F.lit(e).cast("timestamp")))
        same(sealed.count_by_level(spark, root, s, e, env="staging"), agg.count_by_level(inside, env="staging"))
        same(sealed.count_by_service(spark, root, s, e), agg.count_by_service(inside))
        same(sealed.error_rate(spark, root, s, e, service="API"), agg.error_rate(inside, service="API"))
        same(sealed.distinct_values(spark, root, "error_class", s, e), agg.distinct_values(inside, "error_class"))
        if s != e:
            same(sealed.measure(spark, root, s, e), agg.measure(rows, s, e))
    for start, width in (("2024-01-10 00:07:00", 3600), ("2024-01-10 00:07:05", 1000)):
        same(sealed.histogram(spark, root, start, "2024-01-12 00:00:00", width), agg.histogram(rows, start, "2024-01-12 00:00:00", width))


def folders_read(df):
    return {f.split(f"{HOUR}=")[1].split("/")[0] for f in df.inputFiles() if "/rows/" in f}


def test_rows_are_read_of_the_edges_alone(spark, root):
    df = sealed.summaries(spark, root, "2024-01-10 03:14:15.5", "2024-01-12 21:45:30.25")
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    named = {h for h in (f"2024-01-{d}-{x:02}" for d in range(10, 13) for x in range(0, 24, 6)) if h in plan}
    assert len(named) <= 2 and "PartitionFilters" in plan


def test_postings_give_what_the_rows_give(spark, rows, root, monkeypatch):
    s, e = "2024-01-10 02:00:00.5", "2024-01-12 20:00:00"
    inside = rows.filter((F.col("ts") >= F.lit(s).cast("timestamp")) & (F.col("ts") <= F.lit(e).cast("timestamp")))
    for query in ("10 MS purchase", "common", "word common 10", "took", "nothing-like-it", "", "- _"):
        same(sealed.full_text_hours(spark, root, query, s, e, layout=HALF).select("id"), flt.full_text(inside, query).select("id"))
    assert sealed.read(spark, root, "postings").filter("token = 'took'").count() > 0


def test_common_words_leave_the_postings_and_no_row_is_lost(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sealed, "COMMON_LEAST", 5)
    where, day = str(tmp_path), sealed.Layout(24, 2)
    sealed.append_logs(rows.filter("id % 2 = 0"), where, "a", day)
    sealed.seal(spark, where, None, day)
    sealed.append_logs(rows.filter("id % 2 = 1"), where, "b", day)
    sealed.seal(spark, where, "2024-01-12-00", day)
    common = sealed.read(spark, where, "common")
    assert {"common", "word", "took"} <= {r.token for r in common.collect()}
    assert sealed.read(spark, where, "postings").filter(F.col(HOUR) < "2024-01-12-00").join(common, [HOUR, "token"], "left_semi").count() == 0
    for query in ("common word", "common purchase", "took 10 word", "error word"):
        found = sealed.full_text_hours(spark, where, query, FROM, TO, layout=day)
        same(found.select("id"), flt.full_text(rows, query).select("id"))
    hits = sealed.full_text_hours(spark, where, "common", "2024-01-11 00:00:00", "2024-01-11 20:00:00", 0, day)
    assert folders_read(hits) <= {f"2024-01-{d}-00" for d in (10, 11, 12)}


def test_pages_come_from_the_newest_folders(spark, rows, root):
    for params in ({"limit": 7}, {"limit": 30, "offset": 11}, {"limit": 5, "level": "fatal"}, {"limit": 500}, {"limit": 3, "end": "2024-01-11 05:00:00.5"}):
        page = sealed.search_newest(spark, root, "2024-01-13 00:00:00", FROM, layout=HALF, **params)
        want = srt.search_logs(rows, "2024-01-13 00:00:00", FROM, **params)
        assert [r.id for r in page.collect()] == [r.id for r in want.collect()]
    asked = sealed.search_newest(spark, root, "2024-01-13 00:00:00", FROM, limit=3, layout=HALF)._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-12" in asked and "2024-01-10" not in asked.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert sealed.search_newest(spark, root, "2025-01-01 00:00:00", layout=HALF).count() == 0


def test_hours_go_with_all_beside_them(spark, rows, tmp_path):
    where, day = str(tmp_path), sealed.Layout(24, 1)
    sealed.append_logs(rows, where, "a", day)
    gone = sealed.drop_hours(spark, where, "2024-01-11-00")
    assert gone == ["2024-01-10-00"]
    for table in ("rows", "minutes", "dictionaries", "postings"):
        assert {r[0] for r in sealed.read(spark, where, table).select(HOUR).distinct().collect()} <= {"2024-01-11-00", "2024-01-12-00", "2024-01-13-00"}
    with pytest.raises(ValueError):
        sealed.append_logs(rows, where, "sealed", day)


def test_sinks_hold_keys_not_history(spark, tmp_path):
    where, write = str(tmp_path / "sink"), streams.keep_updates(str(tmp_path / "sink"))
    for n in range(4):
        write(spark.createDataFrame([(k, n * 10 + k) for k in range(n, n + 3)], "key long, value long"), n)
    want = sorted(map(tuple, streams.latest_updates(spark.read.parquet(where), ("key",)).collect()))
    for _ in range(2):
        streams.compact_updates(spark, where, ("key",))
        assert folders.children(spark, where) == ["update=-1"]
        assert sorted(map(tuple, streams.latest_updates(spark.read.parquet(where), ("key",)).collect())) == want
    write(spark.createDataFrame([(2, 99), (9, 1)], "key long, value long"), 4)
    streams.compact_updates(spark, where, ("key",))
    got = dict(map(tuple, streams.latest_updates(spark.read.parquet(where), ("key",)).collect()))
    assert got == dict(want) | {2: 99, 9: 1} and spark.read.parquet(where).count() == len(got)
