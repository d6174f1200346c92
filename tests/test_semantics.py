"""Small frames for rules that the supplied tables don't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sigmill.functions import text
from sigmill.operators import aggregates, code_risk, errors, health, ingest, predicates, search, watches
from sigmill.sources import tables, wire

AS_OF = "2024-01-02 00:00:00"


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_normalize_and_scrub(spark):
    assert col(spark, ["User 12345 at 10.0.0.1:80 said 'hello there'", "/users/42 gone", "id 0123456789abcdef0"], text.normalize_message) == ["User <N> at <IP> said <STR>", "/<PATH>/<N> gone", "id <HEX>"]
    assert col(spark, ["mail a.b@c.org or 123-45-6789", "card 4111 1111 1111 1111"], text.scrub_text) == ["mail [FILTERED] or [FILTERED]", "card [FILTERED]"]


def test_byte_prefix_keeps_characters_whole(spark):
    got = col(spark, ["é" * 10, "abc", None], lambda c: text.byte_prefix(c, 5))
    assert got == ["éé", "abc", None]


def test_tokens(spark):
    assert col(spark, ["A b-c D_e é x, The the", ""], text.tokens) == [["b-c", "d_e", "é", "the"], []]


def test_fingerprint_ignores_numbers_and_needs_class_or_file(spark):
    df = spark.createDataFrame([("api", "E", None, "id 12"), ("api", "E", None, "id 99"), ("api", "", None, "id 12")], "s string, c string, f string, m string")
    a, b, c = [r[0] for r in df.select(text.fingerprint(F.col("s"), F.col("c"), F.col("f"), F.col("m"))).collect()]
    assert a == b and len(a) == 16 and c == ""


def test_scrub_body_reaches_every_leaf(spark):
    body = json.dumps({"a": [{"Token": {"x": 1}, "m": "to a@b.org"}], "n": 5})
    (got,) = col(spark, [body], ingest.scrub_body)
    assert json.loads(got) == {"a": [{"Token": "[FILTERED]", "m": "to [FILTERED]"}], "n": 5}
    assert col(spark, ["not json", None, ""], ingest.scrub_body) == ["not json", None, ""]


def test_wire_numbers_and_kinds(spark):
    rows = [('{"level":"WARNING","message":"m","duration_ms":"12.6","status":200,"ts":"2024-01-01T00:00:00Z"}',), ('[{"level":"info","message":"a","job_id":"7"},{"level":"loud","message":"b"}]',), ("nonsense",)]
    df = spark.createDataFrame(rows, "payload string")
    got = wire.normalize_logs(wire.parse_flat_logs(df), AS_OF, "dev").select("level", "kind", "duration_ms", "env").orderBy("kind").collect()
    assert [tuple(r) for r in got] == [("info", "job", None, "dev"), ("warn", "request", 13, "dev")]


def test_validate_report(spark):
    df = spark.createDataFrame([('{"level":"info","message":"m","servce":"x","duration_ms":"5","method":"GET","kind":"log","ts":"2023-12-01T00:00:00Z"}',), ("[1]",)], "payload string")
    a, b = ingest.validate_payload(df, AS_OF).collect()
    assert a.errors == ["duration_ms: expected a JSON number"] and a.unknown == ["servce"]
    assert "ts: older than 48 hours" in a.warnings and "method: kept on request rows only" in a.warnings
    assert b.errors == ["entry must be a JSON object"] and not b.valid
    assert col(spark, ["servce", "severity", "zzzzzz"], ingest.suggest_field) == ["service", "level", ""]


def test_files_of_backtraces(spark):
    trace = "app/a.rb:3:in `x'\nmain.go:7\n at f (web/b.js:1:2)\n  File \"c.py\", line 2\n/usr/gems/d.rb:1\nnode_modules/e.js:1"
    # The first style takes anything before a line number, so a frame in brackets is found with and without its bracket.
    assert sorted(col(spark, [trace], code_risk.extract_files)[0]) == ["(web/b.js", "app/a.rb", "c.py", "main.go", "node_modules/e.js", "web/b.js"]
    bodies = ['{"backtrace":["app/x.rb:1:in y"]}', '{"stack_trace":"Error: no\\n at f (a/b.js:1:2)"}', "{}", None]
    assert col(spark, bodies, ingest.source_file_from_backtrace) == ["app/x.rb", "a/b.js", "", ""]


def test_lifecycle_reopens_once(spark):
    logs = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00", "error", "f", "prod") for i in (1, 3, 4, 7)], "id long, ts string, level string, error_fingerprint string, env string").withColumn("ts", F.col("ts").cast("timestamp"))
    acts = spark.createDataFrame([("f", "prod", "2024-01-02 00:00:00", "resolved"), ("f", "prod", "2024-01-02 12:00:00", "resolved"), ("f", "prod", "2024-01-05 00:00:00", "ignored"), ("f", "prod", "2024-01-08 00:00:00", "reopened")], "fingerprint string, env string, at string, action string").withColumn("at", F.col("at").cast("timestamp"))
    got = errors.lifecycle_events(logs, acts).orderBy("at").select("event").collect()
    assert [r[0] for r in got] == ["resolved", "reopened", "ignored", "reopened"]


def test_breach_runs_alert_once_a_streak(spark):
    runs = spark.createDataFrame([("w", i, b) for i, b in enumerate([True, True, True, False, True, True])], "watch_id string, at int, breached boolean")
    got = watches.breach_runs(runs, 2).orderBy("at").collect()
    assert [r.consecutive for r in got] == [1, 2, 3, 0, 1, 2]
    assert [r.alert for r in got] == [False, True, False, False, False, True]


def test_conditions(spark):
    frame = spark.createDataFrame([(0.2, 0.1, 0.0), (None, None, 5.0)], "now_error_rate double, baseline_error_rate double, previous_error_rate double")
    tree = {"any": [{"type": "relative", "metric": "error_rate", "op": "gt", "multiple": 1.5}, {"not": {"type": "threshold", "metric": "error_rate", "op": "gt", "value": 0}}]}
    assert [r[0] for r in frame.select(watches.evaluate_condition(json.dumps(tree))).collect()] == [True, True]
    assert [r[0] for r in frame.select(watches.evaluate_condition({"type": "delta", "metric": "error_rate", "percent": 1})).collect()] == [False, False]
    with pytest.raises(ValueError):
        watches.evaluate_condition({"type": "threshold", "metric": "error_rate", "op": "about", "value": 1})


def test_probe_classes(spark):
    rows = [(200, 200, 10, 1000, True), (204, 200, 10, 1000, True), (500, 200, 10, 1000, True), (200, 200, 10, 1000, False), (200, 200, 600, 1000, True)]
    df = spark.createDataFrame(rows, "status_code int, expected_code int, response_ms long, timeout_ms long, body_found boolean")
    assert [r.status for r in health.classify_probe(df).collect()] == ["up", "degraded", "down", "down", "degraded"]


def test_change_from_nothing_is_ranked(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (1, 2)], "a int, b int")
    p, w = aggregates.change(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(p, w).collect()] == [(500.0, "new"), (0.0, "unchanged"), (-50.0, "decrease")]


def test_empty_env_matches_any_filter(spark):
    df = spark.createDataFrame([("",), (None,), ("Prod",), ("dev",)], "env string")
    assert df.filter(predicates.env_matches("prod")).count() == 3
    assert df.filter(predicates.env_matches("")).count() == 4
    assert search.clamp(0, 50, 500) == 50 and search.clamp(900, 50, 500) == 500


def test_full_text_needs_tokens(spark):
    df = spark.createDataFrame([(1, "The quick-fox"), (2, "quick")], "id long, message string")
    assert predicates.full_text(df, "QUICK-fox the").count() == 1
    assert predicates.full_text(df, " , ").count() == 0


def test_time_to_live(spark):
    assert tables.seconds_of("never") is None and tables.seconds_of("1h30m") == 5400 and tables.seconds_of("30d") == 2592000
    with pytest.raises(ValueError):
        tables.seconds_of("soon")
