"""What queries meet on the way grows with their rows, not with their square."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from sigmill.operators import code_risk as cod
from sigmill.operators import ingest as ing
from sigmill.operators import search as srt
from sigmill.plans import q_signals
from sigmill.plans.views import logs
from sigmill.sources import sealed
from sigmill.streaming import rules, streams

D = "/root/testdata/sf0.001"


def most_rows(spark) -> int:
    """The most rows that any step of the newest execution put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    newest = store.executionsList().last()
    values = store.executionMetrics(newest.executionId())
    found = []
    for i in range(newest.metrics().size()):
        m = newest.metrics().apply(i)
        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
            found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


def test_context_meets_only_rows_it_shows(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7 % 600).cast("long"))
    rows = spark.range(3000).select("id", at.alias("ts"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("env"), F.when(F.col("id") % 5 > 0, "x").otherwise("y").alias("service"))
    anchors = rows.filter("id % 4 = 0")
    got = srt.log_context(rows, anchors, 3, 2).select("anchor", "side", "n", "id").collect()
    assert most_rows(spark) <= 3000 * 6
    ordered = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.id)):
        ordered.setdefault(r.env, []).append(r.id)
    want = set()
    for ids in ordered.values():
        for i, a in enumerate(ids):
            if a % 4 == 0:
                want |= {(a, "before", i - j, ids[j]) for j in range(max(0, i - 3), i)} | {(a, "anchor", 0, a)} | {(a, "after", j - i, ids[j]) for j in range(i + 1, min(len(ids), i + 3))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_context_keeps_to_its_hours_and_service(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "a", "x"), (2, t + timedelta(hours=1), "a", "y"), (3, t + timedelta(hours=47), "a", "x"), (4, t + timedelta(hours=2), None, "x"), (5, None, "a", "x"), (6, t, "a", "x")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, env string, service string")
    show = lambda **k: sorted((r.side, r.n, r.id) for r in srt.log_context(df, df.filter("id = 1"), **k).collect())
    assert show() == [("after", 1, 6), ("after", 2, 2), ("anchor", 0, 1)]
    assert show(same_service=True, hours=48) == [("after", 1, 6), ("after", 2, 3), ("anchor", 0, 1)]
    assert show(before=0, after=0) == [("anchor", 0, 1)]


def test_an_append_asks_its_rows_once(spark, tmp_path):
    rows = logs(spark, D).filter("ts < '2024-01-03'")
    n, asked = rows.count(), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(message):
        asked.add(1)
        return message

    sealed.append_logs(rows.withColumn("message", counted("message")), str(tmp_path), "01", sealed.Layout(24, 2))
    assert n and asked.value == n
    for table in ("rows", "minutes", "dictionaries", "postings"):
        assert sealed.read(spark, str(tmp_path), table).count() >= 1
    sealed.append_logs(rows.filter("false"), str(tmp_path / "none"), "a")
    assert sealed.read(spark, str(tmp_path / "none"), "rows") is None


def test_traces_share_states(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('t', id % 200) AS trace_id", "nullif(concat('s', id % 3), 's2') AS service", "if(id = 7, 'error', 'info') AS level", "timestamp_seconds(1700000000 + id) AS ts")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streams.stream_trace_status(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 30, "event", buckets=3)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).foreachBatch(streams.keep_updates(f"{tmp_path}/out")).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3
    got = {r.trace_id: r for r in streams.latest_updates(spark.read.parquet(f"{tmp_path}/out"), ("trace_id",)).collect()}
    assert len(got) == 200 and all((r.spans, r.services, r.duration_ms, r.status) == (3, "s0,s1", 400_000, "partial") for r in got.values())
    assert [t for t, r in got.items() if r.has_errors] == ["t7"]


def test_rules_meet_sums_not_rows(spark):
    """Rows in any order of time are folded over many Arrow batches at once, and nothing of them is lost."""
    rows = spark.range(0, 6000, 1, 1).selectExpr(
        "id", "timestamp_seconds(1700000040 + id % 3 * 60) AS ts", "'api' AS service", "'' AS env", "if(id % 10 = 0, 'error', 'info') AS level", "'request' AS kind", "'' AS event_type", "'GET' AS method", "'/' AS path", "'' AS handler",
        "id % 2 * 5L AS duration_ms", "1L AS db_count", "2L AS cache_hits", "if(id % 4 = 1, null, 1L) AS cache_misses", "concat('u', id % 20) AS user_id",
    )
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        found = rules.minutes(rows, {"hit": {"minutes": 60, "field": "user_id", "level": "ERROR", "service": None}}).collect()
    finally:
        spark.conf.set(key, before)
    assert len(found) <= 3 * 4  # three minutes; a duration, or none with one of two users or nobody
    total = lambda c: sum(r[c] for r in found)
    assert (total("n"), total("errors"), total("d"), total("timed"), total("hits"), total("reads")) == (6000, 600, 15_000, 3000, 6000, 4500)
    kept = rules.Kept({"hit": {"field": "user_id"}})
    kept.add(pd.DataFrame([r.asDict() for r in found]))
    first = min(r["minute"] for r in found)
    assert kept.counted(0, first, first + 3) == 2 and kept.window(first, first + 3)[0] == 6000 and kept.window(first, first + 3)[7] == 5


def test_batches_share_states(spark, tmp_path):
    """600 rows of 200 batches, each sent again five minutes later, in two files: first arrivals pass whole, and the state is a few buckets."""
    rows = spark.range(600).selectExpr("concat('b', id % 200) AS batch_id", "id", "timestamp_seconds(1700000000 + id % 200) AS received_at")
    again = rows.withColumn("received_at", F.col("received_at") + F.expr("interval 5 minutes"))
    for part in (rows.filter("id < 400"), again.unionByName(rows.filter("id >= 400"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ing.dedup_batches_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), buckets=3)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).foreachBatch(streams.keep_updates(f"{tmp_path}/out")).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(600))


def test_error_detail_makes_error_rows_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(message):
        asked.add(1)
        return message

    monkeypatch.setattr(q_signals, "logs", lambda spark, d: logs(spark, d).withColumn("message", counted("message")))
    errors = logs(spark, D).filter("level in ('error', 'fatal') and error_fingerprint <> ''").count()
    assert {r.part for r in q_signals.QUERIES["err16_error_detail"](spark, D).collect()} == {"group", "event", "occurrence"}
    assert 0 < asked.value <= errors


def test_equal_back_traces_are_taken_apart_once(spark, monkeypatch):
    asked, whole = spark.sparkContext.accumulator(0), cod.extract_files

    @F.udf("string")
    def counted(trace):
        asked.add(1)
        return trace

    monkeypatch.setattr(cod, "extract_files", lambda trace: whole(counted(trace)))
    assert len(q_signals.QUERIES["cod1_all_endings"](spark, D).collect()) == 13
    assert asked.value == 13
    rows = spark.range(500).selectExpr("'error' AS level", "'api' AS service", "'' AS source_file", "timestamp_seconds(id) AS ts", """if(id % 5 > 0, '{"stack_trace":"a.rb:1"}', '{"stack_trace":"a.rb:1 b.rb:2"}') AS body""")
    assert sorted((r.file, r.service, r.errors, r.last_error.timestamp()) for r in cod.code_entities(rows).collect()) == [("a.rb", "api", 500, 499.0), ("b.rb", "api", 100, 495.0)]
    assert asked.value == 13 + 2
