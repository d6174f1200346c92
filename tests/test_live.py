"""Rules, groups and batches on streams, step by step."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sigmill.operators import errors as err
from sigmill.operators import ingest as ing
from sigmill.operators import watches as wat
from sigmill.plans import q_ingest
from sigmill.plans.views import logs
from sigmill.streaming import rules, streams

D = "/root/testdata/sf0.001"


def at(minutes, seconds=0):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes, seconds=seconds)


class Run:
    """A stream that is fed one list of rows after the other; what each gave out is kept."""

    def __init__(self, spark, folder, schema, operator, mode="update"):
        self.spark, self.folder, self.schema, self.mode, self.n, self.progress = spark, str(folder), schema, mode, 0, []
        self.operator = operator

    def feed(self, rows):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        got = []
        stream = self.operator(self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(f"{self.folder}/in"))
        q = stream.writeStream.outputMode(self.mode).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).foreachBatch(lambda df, n: got.extend(df.collect())).start()
        q.awaitTermination()
        self.progress = [p for p in q.recentProgress if p["stateOperators"]]
        return got

    def held(self):
        return self.progress[-1]["stateOperators"][0]["numRowsTotal"]


def test_a_batch_passes_whole_and_once_and_ids_are_forgotten(spark, tmp_path):
    run = Run(spark, tmp_path, "batch_id string, id long, received_at timestamp", lambda s: ing.dedup_batches_stream(s, remember_s=3600), "append")
    three = [("b1", i, at(0)) for i in range(3)]
    assert sorted(r.id for r in run.feed(three)) == [0, 1, 2]
    # Sent again in the next micro-batch, beside the rest of the first arrival and rows without an id.
    got = run.feed([("b1", i, at(5)) for i in range(3)] + [("b1", 3, at(0)), ("b2", 7, at(9)), ("b2", 8, at(8)), (None, 9, at(5)), (None, 10, at(6)), ("", 11, at(6))])
    assert sorted(r.id for r in got) == [3, 8, 9, 10, 11]
    assert run.held() == 2
    run.feed([("b3", 20, at(600))])
    run.feed([("b4", 21, at(601))])
    assert run.held() <= 2
    assert [r.id for r in run.feed([("b1", 30, at(602))])] == [30]  # forgotten long ago


LOG = "id long, ts timestamp, service string, env string, level string, kind string, event_type string, method string, path string, handler string, duration_ms long, db_count long, cache_hits long, cache_misses long, user_id string"


def row(i, when, level="info", service="api", ms=10, user="u"):
    return (i, when, service, "prod", level, "request", None, "GET", "/a", None, ms, 2, 3, 1, user)


WATCHES = [
    {"id": "all", "minutes": 10, "baseline_minutes": 20, "interval_minutes": 10, "condition": {"all": [{"type": "threshold", "metric": "error_rate", "op": "gt", "value": 0.3}, {"type": "relative", "metric": "log_count", "op": "gte", "multiple": 1}, {"type": "delta", "metric": "p95_response", "percent": 50}, {"type": "count", "name": "hit", "field": "user_id", "level": "error", "minutes": 10, "op": "gte", "value": 2}, {"not": {"type": "threshold", "metric": "heartbeat", "op": "gt", "value": 59}}]}},
    {"id": "paused", "status": "paused", "condition": {"type": "threshold", "metric": "log_count", "op": "gte", "value": 0}},
    {"id": "web", "service": "WEB", "interval_minutes": 2, "condition": {"type": "threshold", "metric": "log_count", "op": "gte", "value": 0}},
]


@pytest.fixture
def several(spark):
    with q_ingest.several_states(spark):
        yield


def test_rules_of_all_kinds_are_judged_as_on_drained_rows(spark, tmp_path, several):
    run = Run(spark, tmp_path, LOG, lambda s: rules.stream_watches(s, WATCHES))
    fed, said = [], []

    def feed(rows):
        fed.extend(rows)
        got = run.feed(rows)
        said.extend(got)
        for r in got:
            frame = wat.metrics_frame(spark.createDataFrame(fed, LOG), str(r.at), 10 if r.watch_id == "all" else 60, 20 if r.watch_id == "all" else 1440)
            users = wat.count_frame(spark.createDataFrame(fed, LOG), str(r.at), "hit", 10, "user_id", "error")
            rule = next(w for w in WATCHES if w["id"] == r.watch_id)
            want = frame.join(users, ["service", "env"], "left").filter(F.col("service") == r.service).select(wat.evaluate_condition(rule["condition"]).alias("b")).first().b
            assert r.breached == want, (r, want)
        return sorted((r.watch_id, r.service) for r in got)

    assert feed([row(i, at(i)) for i in range(12)] + [row(50, at(3), service="web"), row(51, at(3), service="")]) == [("all", "api"), ("all", "web"), ("web", "web")]
    assert feed([row(60, at(13), "error", user="a")]) == []  # within half an interval
    assert feed([row(61 + i, at(16, i), "error", ms=90, user=f"u{i}") for i in range(12)]) == [("all", "api")]
    assert said[-1].breached and said[-1].at.minute == 17
    assert feed([row(90, at(14), "error", user="late")]) == []  # a late row wakes nothing twice
    assert feed([row(100 + i, at(30), service="web") for i in range(3)]) == [("all", "web"), ("web", "web")]
    assert "paused" not in {r.watch_id for r in said}


def test_two_counts_of_one_name_are_refused():
    leaf = {"type": "count", "name": "n", "op": "gt", "value": 1}
    with pytest.raises(ValueError):
        rules.count_leaves([{"condition": {"any": [leaf, {**leaf, "field": "user_id"}]}}])


def test_rules_without_rows_or_rules(spark, tmp_path, several):
    run = Run(spark, tmp_path, LOG, lambda s: rules.stream_watches(s, WATCHES[:1]))
    assert run.feed([row(1, at(0), service=None), row(2, at(0), service="")]) == []


def test_groups_on_a_stream_equal_the_batch_in_any_order(spark, tmp_path):
    """Actions before, between and after the occurrences they concern; rows in a random order."""
    rows = logs(spark, D).filter("level in ('error', 'fatal')")
    groups = err.error_groups(rows)
    few = [r.fingerprint for r in groups.orderBy(F.desc("occurrences"), "fingerprint").limit(6).collect()]
    some = groups.filter(F.col("fingerprint").isin(few))
    act = lambda days, what: some.select("fingerprint", "env", (F.col("first_seen") + F.make_dt_interval(days=F.lit(days))).alias("at"), F.lit(what).alias("action"))
    actions = act(1, "resolved").union(act(4, "ignored").filter("env = 'staging'")).union(act(6, "reopened")).union(act(9, "resolved")).union(act(9, "resolved"))
    want = err.with_status(groups, err.lifecycle_events(rows, actions.distinct()))
    for name, order in (("rows", F.xxhash64("id")), ("acts", F.xxhash64("fingerprint", "at"))):
        df = (rows if name == "rows" else actions).orderBy(order)
        for part in df.randomSplit([1.0, 1.0, 1.0], 5):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    found = q_ingest.sunk(streams.stream_group_states(read("rows", rows), read("acts", actions)), "update", ("fingerprint", "env"))
    columns = ("fingerprint", "env", "service", "error_class", "message", "source_file", "first_seen", "last_seen", "occurrences", "last_log_id", "status", "reopened")
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    got, wanted = key(found), key(want)
    assert got == wanted and any(r[-1] for r in got)


def test_replayed_traces_time_out_by_their_own_clock(spark, tmp_path):
    schema = "trace_id string, service string, level string, ts timestamp"
    run = Run(spark, tmp_path, schema, lambda s: streams.stream_trace_status(s, 30, "event"))
    run.feed([("a", "web", "info", at(0)), ("a", "db", "error", at(0, 2)), (None, "web", "info", at(0))])
    run.feed([("b", "web", "info", at(300))])
    got = run.feed([("c", "web", "info", at(301))])
    state = {}
    for r in [*got]:
        state[r.trace_id] = r.status
    assert state.get("c") == "partial"
    later = [(r.trace_id, r.status, r.spans) for r in run.feed([("a", "web", "info", at(302)), ("d", "web", "info", at(900))])]
    # A row of a trace that had timed out counts on; with the next five hours it is silent again.
    assert ("a", "partial", 3) in later and ("a", "timeout", 3) in later and ("d", "timeout", 1) not in later
    with pytest.raises(ValueError):
        streams.stream_trace_status(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 30, "moon")
