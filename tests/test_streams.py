"""Bounded runs of streams keep their rows off the driver."""

from __future__ import annotations

import time
from datetime import datetime, timezone

import pytest
from pyspark.sql.streaming.readwriter import DataStreamWriter

from sigmill.plans import q_ingest
from sigmill.streaming import streams

NAMES = [n for n in q_ingest.QUERIES if n.startswith("str")]


@pytest.mark.parametrize("name", NAMES)
def test_no_sink_in_memory(spark, monkeypatch, name):
    used, form = [], DataStreamWriter.format
    monkeypatch.setattr(DataStreamWriter, "format", lambda self, kind: used.append(kind) or form(self, kind))
    q_ingest.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).collect()
    assert "memory" not in used


def silent_rows(spark, folder, rows, operator, done):
    """What an operator with a silence of one second gives out until `done` holds for its rows, a minute at most."""
    schema = "trace_id string, service string, level string, ts timestamp"
    spark.createDataFrame(rows, schema).selectExpr("trace_id", "service", "level", "ts").coalesce(1).write.parquet(f"{folder}/in")
    out = f"{folder}/out"
    stream = operator(spark.readStream.schema(schema).parquet(f"{folder}/in"), 1)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(processingTime="1 second").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).start()
    try:
        got, until = [], time.time() + 60
        while time.time() < until and not done(got):
            time.sleep(1)
            assert query.exception() is None
            try:
                got = spark.read.schema(stream.schema).parquet(out).collect()
            except Exception as missing:
                if "PATH_NOT_FOUND" not in str(missing):
                    raise
    finally:
        query.stop()
    return got


def moment(second):
    return datetime(2024, 1, 1, 0, 0, second, tzinfo=timezone.utc)


def test_a_silent_trace_comes_out_once_more_as_timed_out(spark, tmp_path):
    rows = [("a", "web", "info", moment(0)), ("a", "db", "error", moment(2)), ("b", "web", "info", moment(5)), (None, "web", "info", moment(6)), ("", "web", "info", moment(7))]
    got = silent_rows(spark, tmp_path, rows, streams.stream_trace_status, lambda g: sum(r.status == "timeout" for r in g) == 2)
    expected = {("a", 2, "db,web", 2000, True), ("b", 1, "web", 0, False)}
    for status in ("partial", "timeout"):
        found = [(r.trace_id, r.spans, r.services, r.duration_ms, r.has_errors) for r in got if r.status == status]
        assert len(found) == 2 and set(found) == expected


def test_a_silent_service_is_named_once(spark, tmp_path):
    rows = [("a", "web", "info", moment(0)), ("a", "web", "info", moment(9)), ("b", "db", "info", moment(3))]
    got = silent_rows(spark, tmp_path, rows, streams.stream_heartbeat, lambda g: sum(r.silent for r in g) == 2)
    last = {s: 1704067200000 + 1000 * n for s, n in (("web", 9), ("db", 3))}
    assert sorted((r.service, r.last_ms, r.silent) for r in got) == sorted((s, ms, silent) for s, ms in last.items() for silent in (False, True))
