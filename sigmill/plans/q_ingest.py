"""Queries of sources, ingest transforms and streams, with SQL twins where SQL can say them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import ingest as ing
from ..sources import sealed as store
from ..sources import tables as src
from ..sources import wire
from ..streaming import rules as live
from ..streaming import streams
from .q_logs import ERR, measure_sql, plain
from .q_signals import actions, events_of, groups_of, metrics
from .views import AS_OF, VIEWS, Book, folder, logs, table, written

B = Book()
q = B.add


def payloads(spark, d):
    """Wire JSON made of log rows: odd levels, numeric strings, an array for every tenth row."""
    rows = logs(spark, d)
    level = F.when(F.col("level") == "warn", "Warning").when(F.col("id") % 50 == 0, "loud").otherwise(F.upper("level"))
    body = F.to_json(
        F.struct(
            level.alias("level"),
            "service",
            F.when(F.col("id") % 40 != 1, F.col("message")).alias("message"),
            "env",
            F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            "method",
            "path",
            "status",
            F.when(F.col("id") % 3 == 0, (F.col("duration_ms") + 0.4).cast("string")).otherwise(F.col("duration_ms").cast("string")).alias("duration_ms"),
            "trace_id",
        )
    )
    return rows.select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("payload"))


@q("src1_read_flat_logs", "SELECT service, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms, count(path) AS paths FROM logs GROUP BY 1")
def _(spark, d):
    return wire.parse_flat_logs(payloads(spark, d)).groupBy("service").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.count("path").alias("paths"))


@q("src2_normalize_logs", "SELECT level, CASE WHEN env='' THEN 'dev' ELSE env END AS env, CASE WHEN method IS NOT NULL THEN 'request' ELSE 'log' END AS kind, count(*) AS n, max(ts) AS last FROM logs WHERE id % 40 <> 1 AND NOT (id % 50 = 0 AND level <> 'warn') GROUP BY ALL")
def _(spark, d):
    n = wire.normalize_logs(wire.parse_flat_logs(payloads(spark, d)), AS_OF, "dev")
    return plain(n.groupBy("level", "env", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last")))


@q("src3_from_legacy_payload", "SELECT handler, CAST(sum(duration_ms) AS BIGINT) AS ms, CAST(sum(cache_misses) AS BIGINT) AS misses, CAST(sum(cache_hits) AS BIGINT) AS hits FROM logs WHERE kind='request' GROUP BY 1")
def _(spark, d):
    rows = logs(spark, d).filter("kind = 'request'")
    c = lambda x, t: F.col(x).cast(t)
    summary = F.struct(
        F.substring_index("handler", "#", 1).alias("controller"), F.substring_index("handler", "#", -1).alias("action"), "method", "path", c("status", "long").alias("status"), c("duration_ms", "double").alias("duration_ms"), c("db_ms", "double").alias("db_time_ms"), "db_count", "n_plus_one", "dup_queries", F.lit(0.0).alias("view"), "cache_hits", (F.col("cache_hits") + F.col("cache_misses")).alias("reads"), F.lit(0).cast("long").alias("ext"), F.lit(0.0).alias("ext_ms"), F.lit(0.0).alias("mem")
    ).cast(wire.SUMMARY)
    old = rows.withColumn("request_summary", summary).withColumns({"handler": F.lit(None).cast("string"), "duration_ms": F.lit(None).cast("long"), "cache_misses": F.lit(0).cast("long")})
    return wire.from_legacy_payload(old).groupBy("handler").agg(F.sum("duration_ms").alias("ms"), F.sum("cache_misses").alias("misses"), F.sum("cache_hits").alias("hits"))


@q("src4_request_summary", "SELECT id AS log_id, handler AS controller, method, path, status, duration_ms, db_ms AS db_time_ms, db_count AS sql_count, coalesce(n_plus_one,false) AS n_plus_one, dup_queries AS duplicate_queries, cache_hits, coalesce(cache_hits,0)+coalesce(cache_misses,0) AS cache_reads FROM logs WHERE duration_ms > 0")
def _(spark, d):
    return wire.request_summary(logs(spark, d))


@q("src5_write_logs", "SELECT count(*) AS n, count(DISTINCT date_trunc('hour', received_at)) AS hours, CAST(sum(id) AS BIGINT) AS ids FROM logs")
def _(spark, d):
    where = folder(spark, "logs")
    src.write_logs(logs(spark, d), where)
    return spark.read.parquet(where).agg(F.count("*").alias("n"), F.countDistinct(src.HOUR).alias("hours"), F.sum("id").alias("ids"))


@q("src5_dictionaries", "SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d-%H') AS arrival_hour, 'service' AS \"column\", service AS value, count(*) AS n FROM logs GROUP BY ALL UNION ALL SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d-%H'), 'level', level, count(*) FROM logs GROUP BY ALL")
def _(spark, d):
    where = folder(spark, "logs")
    src.write_logs(logs(spark, d), where, beside=f"{where}-beside")
    return spark.read.parquet(f"{where}-beside/dictionaries").filter("column in ('service', 'level')").select(F.col(src.HOUR).cast("string").alias("arrival_hour"), "column", "value", "n")


#: Thirty days of few rows: a folder a day.
DAILY = store.Layout(hours=24, buckets=2)
_sealed: dict[tuple[str, str], str] = {}


def sealed_table(spark, d):
    """The log rows in two appends, one of them made twice; folders before the 20th are sealed, in two steps. Written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _sealed:
        where = folder(spark, "sealed")
        rows = logs(spark, d)
        store.append_logs(rows.filter("id % 3 > 0"), where, "a", DAILY)
        store.seal(spark, where, "2024-01-10-00", DAILY)
        for _ in range(2):
            store.append_logs(rows.filter("id % 3 = 0"), where, "b", DAILY)
        store.seal(spark, where, "2024-01-20-00", DAILY)
        _sealed[key] = where
    return _sealed[key]


@q("src5_sealed_hours", "SELECT date_trunc('minute', ts) AS minute, service, env, level, count(*) AS n, min(id) AS first_id, max(id) AS last_id, count(*) FILTER (duration_ms > 0) AS timed, CAST(coalesce(sum(duration_ms) FILTER (duration_ms > 0), 0) AS BIGINT) AS duration_sum, coalesce(array_to_string(list_sort(list(duration_ms) FILTER (duration_ms > 0)), ','), '') AS durations FROM logs WHERE received_at < TIMESTAMP '2024-01-20' GROUP BY ALL")
def _(spark, d):
    # Rows of one minute may have arrived on both sides of midnight, in two sealed hours.
    minutes = store.added(store.read(spark, sealed_table(spark, d), "minutes").filter(F.col("append") == store.SEALED), *store.KEYS)
    each = F.array_join(F.flatten(F.transform("durations", lambda x: F.array_repeat(x["value"], x["times"].cast("int")))), ",")
    minutes = minutes.withColumn("durations", F.coalesce(each, F.lit("")))
    return plain(minutes, "minute", "service", "env", "level", "n", "first_id", "last_id", "timed", "duration_sum", "durations")


# A span that begins and ends within minutes, partly over sealed hours.
LO, HI = "2024-01-08 03:14:15.500000", "2024-01-24 21:45:30.250000"
WITHIN = f"ts >= TIMESTAMP '{LO}' AND ts <= TIMESTAMP '{HI}'"


@q("agg1_level_from_summaries", f"SELECT level, count(*) AS n FROM logs WHERE {WITHIN} AND lower(service)='web' AND (env='' OR env='staging') GROUP BY level")
def _(spark, d):
    return store.count_by_level(spark, sealed_table(spark, d), LO, HI, service="WEB", env="Staging")


@q("agg2_rate_from_summaries", f"SELECT count(*) AS total, CAST(count(*) FILTER ({ERR}) AS BIGINT) AS errors, round(count(*) FILTER ({ERR})*100.0::DOUBLE/count(*),4) AS percent FROM logs WHERE {WITHIN}")
def _(spark, d):
    return store.error_rate(spark, sealed_table(spark, d), LO, HI)


@q("agg3_service_from_summaries", f"SELECT service, count(*) AS total, count(*) FILTER ({ERR}) AS errors FROM logs WHERE {WITHIN} GROUP BY service")
def _(spark, d):
    return store.count_by_service(spark, sealed_table(spark, d), LO, HI)


@q("agg4_histogram_from_summaries", ", b AS (SELECT unnest(generate_series(0, 160)) AS i), c AS (SELECT datediff('second', TIMESTAMP '2024-01-10 00:07:00', date_trunc('second', ts)) // 5400 AS i, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-10 00:07:00' AND ts < TIMESTAMP '2024-01-20 00:07:00' AND service='api' GROUP BY ALL) SELECT TIMESTAMP '2024-01-10 00:07:00' + to_seconds(b.i*5400) AS bucket, coalesce(c.n,0) AS n FROM b LEFT JOIN c USING (i)")
def _(spark, d):
    return plain(store.histogram(spark, sealed_table(spark, d), "2024-01-10 00:07:00", "2024-01-20 00:07:00", 5400, service="api"))


@q("agg6_values_from_dictionaries", f"SELECT DISTINCT source_file AS value FROM logs WHERE {WITHIN} AND coalesce(source_file,'')<>''")
def _(spark, d):
    return store.distinct_values(spark, sealed_table(spark, d), "source_file", LO, HI)


@q("agg21_measure_from_summaries", measure_sql(LO, "2024-01-24 21:45:30", "service, env"))
def _(spark, d):
    return store.measure(spark, sealed_table(spark, d), LO, "2024-01-24 21:45:30")


@q("flt6_stored_postings", f"SELECT id, message FROM logs WHERE {WITHIN} AND list_has_all({text.sql_tokens('message')}, ['purchase', 'took', '7'])".replace(", '7'", ", '10'"))
def _(spark, d):
    return store.full_text_hours(spark, sealed_table(spark, d), "10 took PURCHASE", LO, HI, layout=DAILY).select("id", "message")


@q("srt1_newest_first", f"SELECT id, ts, service FROM logs WHERE ts <= TIMESTAMP '{HI}' AND ts >= TIMESTAMP '2024-01-02' AND level='fatal' ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 5")
def _(spark, d):
    return plain(store.search_newest(spark, sealed_table(spark, d), AS_OF, "2024-01-02", HI, 40, 5, layout=DAILY, level="fatal"), "id", "ts", "service")


@q("src7_read_jdbc_query", "SELECT s_suppkey, s_nationkey FROM supplier", ())
def _(spark, d):
    url = f"jdbc:derby:memory:sigmill{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    table(spark, d, "supplier").select("s_suppkey", "s_nationkey").write.jdbc(url, "supplier", properties=driver)
    ends = table(spark, d, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    return src.read_jdbc_query(spark, url, 'SELECT "s_suppkey", "s_nationkey" FROM supplier', max_rows=None, split=('"s_suppkey"', ends[0], ends[1], 4), **driver)


@q("src6_scan_logs", "SELECT id, service FROM logs WHERE ts >= TIMESTAMP '2024-01-10 03:20:00' AND ts <= TIMESTAMP '2024-01-12 17:00:00'")
def _(spark, d):
    where = folder(spark, "logs")
    src.write_logs(logs(spark, d), where)
    return src.scan_logs(spark, where, "2024-01-10 03:20:00", "2024-01-12 17:00:00").select("id", "service")


@q("src8_profile_table", "SELECT 'level' AS \"column\", (SELECT count(*) FROM logs) AS rows, 'error,fatal,info,warn' AS samples UNION ALL SELECT 'service', (SELECT count(*) FROM logs), 'api,billing,web,worker' UNION ALL SELECT 'id', (SELECT count(*) FROM logs), ''")
def _(spark, d):
    return src.profile_table(logs(spark, d).select("id", "level", "service")).select("column", "rows", F.coalesce(F.array_join("samples", ","), F.lit("")).alias("samples"))


@q("src9_append_metrics", "SELECT server, name, count(*) AS n, max(value) AS top FROM metrics GROUP BY ALL", ("metrics",))
def _(spark, d):
    m = metrics(spark, d).withColumn("labels", F.to_json(F.create_map(F.lit("host"), F.col("server"))))
    where = folder(spark, "metrics")
    src.append_metrics(m, where)
    return spark.read.parquet(where).groupBy(F.col("labels")["host"].alias("server"), "name").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@q("src10_prune", f"SELECT id FROM logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 day")
def _(spark, d):
    return src.prune(logs(spark, d), "10d", AS_OF).select("id")


@q("src10_prune_log_hours", f", h AS (SELECT date_trunc('hour', received_at) AS h FROM logs GROUP BY 1 HAVING max(received_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 100 hour) SELECT id FROM logs WHERE date_trunc('hour', received_at) IN (SELECT h FROM h)")
def _(spark, d):
    return src.prune_log_hours(logs(spark, d), "100h", AS_OF).select("id")


RULES = "service string, rate double, keep_errors boolean"


def rules(spark):
    return spark.createDataFrame([("api", 0.25, True), ("web", 0.0, False), ("*", 0.5, True)], RULES)


UNIT = "('0x' || left(md5(id::VARCHAR), 8))::BIGINT / 4294967296.0::DOUBLE"


@q("ing1_sample_logs", f"SELECT id FROM logs WHERE CASE service WHEN 'api' THEN {ERR} OR {UNIT} < 0.25 WHEN 'web' THEN {UNIT} < 0.0 ELSE {ERR} OR {UNIT} < 0.5 END")
def _(spark, d):
    return ing.sample_logs(logs(spark, d), rules(spark)).select("id")


@q("ing2_scrub_text", f"SELECT doc_id, md5({text.sql_scrub('text')}) AS digest FROM documents", ())
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.scrub_text(F.col("text"))).alias("digest"))


@q("ing3_scrub_body", f"SELECT id, {text.sql_scrub('message')} AS note FROM logs")
def _(spark, d):
    rows = logs(spark, d)
    body = F.to_json(F.struct(F.struct(F.array("message").alias("notes"), F.lit("x").alias("Password")).alias("deep")))
    out = rows.select("id", ing.scrub_body(body).alias("body"))
    return out.filter(F.get_json_object("body", "$.deep.Password") == text.FILTERED).select("id", F.get_json_object("body", "$.deep.notes[0]").alias("note"))


@q("ing4_fingerprint", f"SELECT id, error_fingerprint FROM logs WHERE {ERR}")
def _(spark, d):
    return ing.add_fingerprints(logs(spark, d)).filter(F.col("level").isin("error", "fatal")).select("id", "error_fingerprint")


@q("ing5_normalize_message", f"SELECT doc_id, {text.sql_normalize('text')} AS normal FROM documents", ())
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_message(F.col("text")).alias("normal"))


@q("ing6_source_file", "SELECT id, source_file AS file FROM logs WHERE source_file IS NOT NULL")
def _(spark, d):
    rows = logs(spark, d).filter("source_file is not null")
    f = F.col("source_file")
    frame = F.when(F.col("id") % 3 == 0, F.concat(f, F.lit(":87:in `charge'"))).when(F.col("id") % 3 == 1, F.concat(F.lit("at A.b ("), f, F.lit(":1:2)"))).otherwise(F.concat(F.lit('File "'), f, F.lit('", line 3')))
    body = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(frame).alias("backtrace")))).otherwise(F.to_json(F.struct(F.concat(F.lit("Error: x\n  "), frame).alias("stack_trace"))))
    return rows.select("id", ing.source_file_from_backtrace(body).alias("file"))


def with_children(spark, d):
    """All log rows; every fourth holds two child logs in its body."""
    kid = lambda n: F.struct(F.lit("WARN" if n else None).cast("string").alias("level"), F.concat(F.lit(f"step {n} of "), F.col("id").cast("string")).alias("message"), F.lit(float(10 * n)).alias("at"))
    return logs(spark, d).withColumn("body", F.when(F.col("id") % 4 == 0, F.to_json(F.struct(F.array(kid(0), kid(1)).alias("logs")))).otherwise(F.col("body")))


@q("ing7_expand_logs", "SELECT id, 'info' AS level, 'step 0 of ' || id AS message, date_trunc('millisecond', ts) AS ts, service FROM logs WHERE id % 4 = 0 UNION ALL SELECT id, 'warn', 'step 1 of ' || id, date_trunc('millisecond', ts) + INTERVAL 10 millisecond, service FROM logs WHERE id % 4 = 0")
def _(spark, d):
    out = ing.expand_in_request_logs(with_children(spark, d)).filter("event_type = 'in_request_log'")
    return plain(out, "id", "level", "message", "ts", "service")


KEPT = f"SELECT * FROM logs WHERE CASE service WHEN 'api' THEN {ERR} OR {UNIT} < 0.25 WHEN 'web' THEN {UNIT} < 0.0 ELSE {ERR} OR {UNIT} < 0.5 END"


@q(
    "ing8_ingest_pipeline",
    f""", s AS ({KEPT})
SELECT id, level, {text.sql_scrub("message")} AS message, 'mail [FILTERED]' AS error_message, CASE WHEN {ERR} THEN error_fingerprint ELSE '' END AS fingerprint,
       CASE WHEN id % 4 = 0 THEN '' ELSE '[FILTERED]' END AS token FROM s
UNION ALL SELECT id, 'info', 'step 0 of ' || id, '', '', '' FROM s WHERE id % 4 = 0 UNION ALL SELECT id, 'warn', 'step 1 of ' || id, '', '', '' FROM s WHERE id % 4 = 0""",
)
def _(spark, d):
    body = F.when(F.col("id") % 4 == 0, F.col("body")).otherwise(F.concat(F.lit('{"Token":"t'), "id", F.lit('"}')))
    rows = with_children(spark, d).withColumns({"error_message": F.concat(F.lit("mail u"), "id", F.lit("@mail.org")), "body": body})
    out = ing.ingest_pipeline(rows, rules(spark))
    return out.select("id", "level", "message", *[F.coalesce(c, F.lit("")).alias(n) for c, n in ((F.col("error_message"), "error_message"), (F.col("error_fingerprint"), "fingerprint"), (F.get_json_object("body", "$.Token"), "token"))])


@q("ing9_dedup_batches", ", b AS (SELECT *, id // 20 % 300 AS batch_id FROM logs) SELECT id, batch_id FROM b JOIN (SELECT batch_id, min(received_at) AS r FROM b GROUP BY 1) USING (batch_id) WHERE received_at = r")
def _(spark, d):
    rows = logs(spark, d).withColumn("batch_id", F.floor(F.col("id") / 20) % 300)
    return ing.dedup_batches(rows).select("id", "batch_id")


@q("ing10_validate_payload", "SELECT id % 10 <> 0 AND NOT (id % 50 = 0 AND level<>'warn') AND id % 40 <> 1 AND NOT coalesce(method IS NOT NULL, false) AS valid, CASE WHEN id % 10 <> 0 AND method IS NOT NULL THEN 'request' ELSE 'log' END AS kind, count(*) AS n FROM logs GROUP BY ALL")
def _(spark, d):
    return ing.validate_payload(payloads(spark, d), AS_OF).groupBy("valid", "kind").agg(F.count("*").alias("n"))


def odd_payloads(spark, d):
    """Wire JSON with fields of wrong kinds, unknown names and missing ones, by id."""
    i = F.col("id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = [
        F.when(i % 9 > 0, F.concat(F.lit('"level":'), F.when(i % 5 == 0, F.lit("7")).when(i % 5 == 1, F.lit('"WARNING"')).otherwise(quoted(F.col("level"))))),
        F.when(i % 7 > 0, F.concat(F.lit('"service":'), F.when(i % 4 == 0, F.lit("[1]")).otherwise(quoted(F.col("service"))))),
        F.concat(F.lit('"message":'), F.when(i % 6 == 0, F.lit("{}")).otherwise(F.lit('"m"'))),
        F.concat(F.lit('"duration_ms":'), F.when(i % 3 == 0, F.lit('"12"')).when(i % 3 == 1, F.lit("1.5")).otherwise(F.lit("null"))),
        F.concat(F.lit('"n_plus_one":'), F.when(i % 2 == 0, F.lit("true")).otherwise(F.lit("0"))),
        F.concat(F.lit('"body":'), F.when(i % 8 == 0, F.lit("[]")).when(i % 8 == 1, F.lit('"x"')).otherwise(F.lit('{"a":1}'))),
        F.when(i % 10 == 0, F.lit('"severity":"x"')),
        F.when(i % 11 == 0, F.lit('"qqqqqq":1')),
    ]
    return logs(spark, d).select("id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("payload"))


_K = "CASE WHEN coalesce({0}, 'NULL') = 'NULL' THEN NULL WHEN {0} = 'VARCHAR' THEN 'string' WHEN {0} = 'BOOLEAN' THEN 'boolean' WHEN {0} = 'OBJECT' THEN 'object' WHEN {0} = 'ARRAY' THEN 'array' ELSE 'number' END"
_P = """, p AS (SELECT id, level AS lv, '{' || concat_ws(',', CASE WHEN id%9>0 THEN '"level":' || CASE id%5 WHEN 0 THEN '7' WHEN 1 THEN '"WARNING"' ELSE '"' || level || '"' END END, CASE WHEN id%7>0 THEN '"service":' || CASE WHEN id%4=0 THEN '[1]' ELSE '"' || service || '"' END END,
 '"message":' || CASE WHEN id%6=0 THEN '{}' ELSE '"m"' END, '"duration_ms":' || CASE id%3 WHEN 0 THEN '"12"' WHEN 1 THEN '1.5' ELSE 'null' END, '"n_plus_one":' || CASE WHEN id%2=0 THEN 'true' ELSE '0' END, '"body":' || CASE id%8 WHEN 0 THEN '[]' WHEN 1 THEN '"x"' ELSE '{"a":1}' END,
 CASE WHEN id%10=0 THEN '"severity":"x"' END, CASE WHEN id%11=0 THEN '"qqqqqq":1' END) || '}' AS payload FROM logs)"""
_W = " UNION ALL ".join(f"SELECT id, 'error' AS part, '{k}: expected {ing.KINDS[want]}' AS said FROM p WHERE {_K.format(f'json_type(payload, {chr(39)}$.{k}{chr(39)})')} <> '{want}'" for k, want in (("level", "string"), ("service", "string"), ("message", "string"), ("duration_ms", "number"), ("n_plus_one", "boolean"), ("body", "object")))


@q(
    "ing10_full_report",
    _P + f""" {_W} UNION ALL SELECT id, 'error', 'level: required' FROM p WHERE id%9=0 UNION ALL SELECT id, 'error', 'level: not one of debug, info, warn, error, fatal' FROM p WHERE id%9>0 AND id%5=0
UNION ALL SELECT id, 'warning', 'level: stored in lower case' FROM p WHERE id%9>0 AND id%5=1 UNION ALL SELECT id, 'warning', 'service: not sent' FROM p WHERE id%7=0 UNION ALL SELECT id, 'warning', 'ts: not sent' FROM p
UNION ALL SELECT id, 'warning', 'kind: not sent, inferred as log' FROM p UNION ALL SELECT id, 'warning', 'n_plus_one: kept on request rows only' FROM p
UNION ALL SELECT id, 'unknown', 'qqqqqq ' FROM p WHERE id%11=0 UNION ALL SELECT id, 'unknown', 'severity level' FROM p WHERE id%10=0""",
)
def _(spark, d):
    r = written(ing.validate_payload(odd_payloads(spark, d), AS_OF).select("id", "errors", "warnings", "unknown", "did_you_mean"))
    part = lambda name, c: r.select("id", F.lit(name).alias("part"), F.explode(c).alias("said"))
    unknown = r.select("id", F.lit("unknown").alias("part"), F.explode(F.arrays_zip("unknown", "did_you_mean")).alias("u")).select("id", "part", F.concat_ws(" ", "u.unknown", "u.did_you_mean").alias("said"))
    return part("error", "errors").union(part("warning", "warnings")).union(unknown)


def wire_files(spark, d):
    """The wire payloads as files, one payload a line; lines are objects."""
    where = folder(spark, "wire")
    payloads(spark, d).select(F.regexp_replace("payload", r"^\[|\]$", "").alias("value")).write.text(where)
    return where


SRC1 = "SELECT id % 50 = 0 AND level <> 'warn' AS loud, service, env, method, path, status, CASE WHEN id % 40 <> 1 THEN message END AS message, CAST(duration_ms AS BIGINT) AS duration_ms, trace_id FROM logs"


@q("src1_from_files", SRC1)
def _(spark, d):
    found = wire.read_flat_logs(spark, wire_files(spark, d), lines=True)
    return found.select((F.col("level") == "loud").alias("loud"), "service", "env", "method", "path", "status", "message", "duration_ms", "trace_id")


@q("src1_from_stream", SRC1)
def _(spark, d):
    found = sunk(wire.read_flat_logs(spark, wire_files(spark, d), stream=True, lines=True), "append")
    return found.select((F.col("level") == "loud").alias("loud"), "service", "env", "method", "path", "status", "message", "duration_ms", "trace_id")


@q("ing11_suggest_all_aliases", "SELECT field, suggestion FROM (VALUES " + ", ".join("('{}', '{}')".format(a, f if "." not in f else '{}, as "{}" inside it'.format(*f.split("."))) for a, f in ing.ALIASES.items()) + ") v(field, suggestion) WHERE EXISTS (SELECT 1 FROM events)", ())
def _(spark, d):
    names = list(ing.ALIASES)
    wanted = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("field"))
    return wanted.distinct().select("field", ing.suggest_field(F.col("field")).alias("suggestion"))


@q("ing11_suggest_field", "SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN 'servce' WHEN 1 THEN 'severity' ELSE 'qqqqqq' END AS field, CASE event_id % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'level' ELSE '' END AS suggestion FROM events", ())
def _(spark, d):
    i = F.col("event_id") % 3
    wanted = table(spark, d, "events").select(F.when(i == 0, "servce").when(i == 1, "severity").otherwise("qqqqqq").alias("field"))
    return wanted.select("field", ing.suggest_field(F.col("field")).alias("suggestion")).distinct()


def log_stream(spark, d, *columns):
    """The log rows (or some columns of them) as a stream of files, as many as the cluster runs tasks at once; half of them are a batch."""
    where, n = folder(spark, "stream"), spark.sparkContext.defaultParallelism
    rows = logs(spark, d).select(*(columns or ["*"]))
    rows.repartition(n).write.parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(where)


#: Where the rows are parted in time for streams that bring them in order.
PERIODS = ("2024-01-08 12:00:00", "2024-01-16 00:00:00", "2024-01-23 12:00:00")


def ordered_stream(spark, rows):
    """The rows as a stream that brings one period after the other, each of several files."""
    where, parted, n = folder(spark, "ordered"), folder(spark, "periods"), spark.sparkContext.defaultParallelism
    # Rows are made once, into a folder a period.
    period = reduce(lambda before, i: before.when(F.col("ts") < F.lit(PERIODS[i]).cast("timestamp"), i), range(len(PERIODS)), F).when(F.col("ts").isNotNull(), len(PERIODS))
    rows = rows.withColumn("period", period)
    rows.write.partitionBy("period").parquet(parted)
    made, rows = spark.read.schema(rows.schema).parquet(parted), rows.drop("period")
    for i in range(len(PERIODS) + 1):
        made.filter(F.col("period") == i).select(rows.columns).repartition(n, "id").write.mode("append").parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(where)


@contextmanager
def several_states(spark):
    """Keyed state of several variables needs the RocksDB store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def drained(stream, mode: str, foreach) -> None:
    """Runs a stream over all there is."""
    at = folder(stream.sparkSession, "progress")
    stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(foreach).start().awaitTermination()


def sunk(stream, mode: str, keys: tuple[str, ...] = ()):
    """The rows that a stream over all there is wrote to the shared folder: the newest of each key, or all if there is none."""
    spark, where = stream.sparkSession, folder(stream.sparkSession, "sink")
    drained(stream, mode, streams.keep_updates(where))
    rows = spark.read.parquet(where)
    return streams.latest_updates(rows, keys) if keys else rows


LIVE = [
    {"id": "w1", "minutes": 720, "baseline_minutes": 1440, "interval_minutes": 5, "condition": {"any": [{"type": "threshold", "metric": "error_rate", "op": "gt", "value": 0.2}, {"type": "relative", "metric": "error_rate", "op": "gt", "multiple": 1.1}, {"all": [{"type": "delta", "metric": "log_count", "percent": 20}, {"not": {"type": "threshold", "metric": "cache_hit_rate", "op": "lt", "value": 0.75}}]}]}},
    {"id": "w2", "minutes": 60, "interval_minutes": 57_600, "condition": {"type": "count", "name": "users", "field": "user_id", "level": "ERROR", "minutes": 2880, "op": "gte", "value": 2}},
    {"id": "w3", "status": "paused", "condition": {"type": "threshold", "metric": "log_count", "op": "gte", "value": 0}},
    {"id": "w4", "service": "API", "minutes": 1440, "baseline_minutes": 1440, "condition": {"any": [{"type": "threshold", "metric": "p95_response", "op": "gt", "value": 90}, {"type": "threshold", "metric": "heartbeat", "op": "gt", "value": 30}, {"type": "threshold", "metric": "sql_count", "op": "lt", "value": 5}]}},
]
# Each period judges the rules of a service and environment at the end of the newest minute it brings.
VIEWS["live"] = VIEWS["logs"] + f""", chk AS (SELECT service, env, CASE WHEN ts < TIMESTAMP '{PERIODS[0]}' THEN 1 WHEN ts < TIMESTAMP '{PERIODS[1]}' THEN 2 WHEN ts < TIMESTAMP '{PERIODS[2]}' THEN 3 ELSE 4 END AS p, date_trunc('minute', max(ts)) + INTERVAL 1 minute AS "at" FROM logs GROUP BY ALL),
lm AS (SELECT c.service, c.env, c."at", c.p, count(*) FILTER (l.ts >= c."at" - INTERVAL 12 hour) AS n, count(*) FILTER (l.ts >= c."at" - INTERVAL 12 hour AND {ERR}) AS e,
 count(*) FILTER (l.ts >= c."at" - INTERVAL 24 hour AND l.ts < c."at" - INTERVAL 12 hour) AS pn, count(*) FILTER (l.ts >= c."at" - INTERVAL 36 hour AND l.ts < c."at" - INTERVAL 12 hour) AS bn, count(*) FILTER (l.ts >= c."at" - INTERVAL 36 hour AND l.ts < c."at" - INTERVAL 12 hour AND {ERR}) AS be,
 CAST(sum(cache_hits) FILTER (l.ts >= c."at" - INTERVAL 12 hour AND duration_ms > 0) AS BIGINT) AS hits, CAST(sum(cache_hits + cache_misses) FILTER (l.ts >= c."at" - INTERVAL 12 hour AND duration_ms > 0) AS BIGINT) AS reads,
 count(DISTINCT user_id) FILTER (level = 'error') AS users, quantile_disc(CASE WHEN duration_ms > 0 THEN duration_ms END, 0.95) FILTER (l.ts >= c."at" - INTERVAL 24 hour) AS p95, max(l.ts) AS last,
 CAST(coalesce(sum(db_count) FILTER (l.ts >= c."at" - INTERVAL 24 hour AND duration_ms > 0), 0) AS BIGINT) AS sqls
 FROM chk c JOIN logs l ON l.service = c.service AND l.env = c.env AND l.ts >= c."at" - INTERVAL 48 hour AND l.ts < c."at" GROUP BY ALL),
lr AS (SELECT *, round(e::DOUBLE/n, 6) AS er, round(be::DOUBLE/nullif(bn,0), 6) AS br, CASE WHEN reads > 0 THEN round(hits::DOUBLE/reads, 6) ELSE 0.0 END AS hr, min("at") OVER (PARTITION BY service, env) AS first_at FROM lm),
l2 AS (SELECT *, "at" >= first_at + INTERVAL 20 day AS later FROM lr)"""


@q(
    "str1_stream_watches",
    """ SELECT 'w1' AS watch_id, "at", service, env, er > 0.2 OR (coalesce(br <> 0, false) AND coalesce(er > br*1.1, false)) OR (coalesce(abs(n-pn)*100.0::DOUBLE/nullif(pn,0), -1) >= 20 AND NOT hr < 0.75) AS breached FROM lr
UNION ALL SELECT 'w2', "at", service, env, users >= 2 FROM l2 WHERE "at" = first_at OR later AND p = (SELECT min(x.p) FROM l2 x WHERE x.service = l2.service AND x.env = l2.env AND x.later)
UNION ALL SELECT 'w4', "at", service, env, coalesce(p95 > 90, false) OR (epoch_us("at") - epoch_us(last)) // 1000000 > 30 OR sqls < 5 FROM lr WHERE service = 'api'""",
    ("live",),
)
def _(spark, d):
    with several_states(spark):
        rows = logs(spark, d).select("id", "ts", "service", "env", "level", "kind", "event_type", "method", "path", "handler", "duration_ms", "db_count", "cache_hits", "cache_misses", "user_id")
        return plain(sunk(live.stream_watches(ordered_stream(spark, rows), LIVE), "update"), "watch_id", "at", "service", "env", "breached")


@q("str2_error_groups", f"SELECT error_fingerprint AS fingerprint, env, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM logs WHERE {ERR} AND error_fingerprint<>'' GROUP BY ALL")
def _(spark, d):
    where = folder(spark, "groups")
    keys = ("fingerprint", "env")
    drained(streams.stream_error_groups(log_stream(spark, d)), "update", streams.keep_updates(where))
    return plain(streams.latest_updates(spark.read.parquet(where), keys), "fingerprint", "env", "occurrences", "first_seen", "last_seen")


@q("str2_group_states", ", st AS (SELECT fingerprint, env, arg_max(event, (\"at\", event)) AS e, CAST(count(*) FILTER (event='reopened') AS BIGINT) AS r FROM evts GROUP BY ALL) SELECT g.* EXCLUDE (status), CASE WHEN e IN ('resolved','ignored') THEN e ELSE 'unresolved' END AS status, coalesce(r,0) AS reopened FROM groups g LEFT JOIN st USING (fingerprint, env)", ("acts",))
def _(spark, d):
    where = folder(spark, "actions")
    acts = actions(groups_of(spark, d)[1])
    acts.write.parquet(where)
    found = streams.stream_group_states(log_stream(spark, d), spark.readStream.schema(acts.schema).parquet(where))
    return plain(sunk(found, "update", ("fingerprint", "env")), *found.columns)


@q("str2_impacts", f"SELECT error_fingerprint AS fingerprint, env, user_id, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM logs WHERE {ERR} AND error_fingerprint<>'' GROUP BY ALL")
def _(spark, d):
    return plain(sunk(streams.stream_impacts(log_stream(spark, d)), "update", ("fingerprint", "env", "user_id")), "fingerprint", "env", "user_id", "occurrences", "first_seen", "last_seen")


@q("str3_trace_status", f"SELECT trace_id, count(*) AS spans, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, epoch_us(max(ts))//1000 - epoch_us(min(ts))//1000 AS duration_ms, bool_or({ERR}) AS has_errors FROM logs GROUP BY 1")
def _(spark, d):
    return sunk(streams.stream_trace_status(log_stream(spark, d, "ts", "trace_id", "service", "level"), None), "update", ("trace_id",)).select("trace_id", "spans", "services", "duration_ms", "has_errors")


LAST = "(SELECT epoch_us(max(ts))//1000 - 3600000 FROM logs)"


@q("str3_trace_timeouts", f"SELECT trace_id, count(*) AS spans, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, epoch_us(max(ts))//1000 - epoch_us(min(ts))//1000 AS duration_ms, bool_or({ERR}) AS has_errors, CASE WHEN epoch_us(max(ts))//1000 + 30000 < {LAST} THEN 'timeout' ELSE 'partial' END AS status FROM logs GROUP BY 1")
def _(spark, d):
    return sunk(streams.stream_trace_status(ordered_stream(spark, logs(spark, d).select("id", "ts", "trace_id", "service", "level")), 30, "event"), "update", ("trace_id",))


@q("str4_live_tail", f"SELECT id, message FROM logs WHERE {ERR} AND level='fatal' AND service='web'")
def _(spark, d):
    return sunk(streams.live_tail(log_stream(spark, d), level="fatal", service="web"), "append").select("id", "message")


@q("str5_heartbeat", "SELECT service, epoch_us(max(ts))//1000 AS last_ms FROM logs GROUP BY 1")
def _(spark, d):
    return sunk(streams.stream_heartbeat(log_stream(spark, d), None), "update", ("service",)).select("service", "last_ms")


@q("str5_silent_services", f"SELECT service, epoch_us(max(ts))//1000 AS last_ms, epoch_us(max(ts))//1000 + 60000 < {LAST} AS silent FROM (SELECT service || '/' || env || '/' || version AS service, ts FROM logs) GROUP BY 1")
def _(spark, d):
    parts = logs(spark, d).select("id", "ts", F.concat_ws("/", "service", "env", "version").alias("service"))
    return sunk(streams.stream_heartbeat(ordered_stream(spark, parts), 60, "event"), "update", ("service",))


@q("str6_minute_rollup", "SELECT date_trunc('minute', ts) AS minute, service, env, level, count(*) AS n FROM logs GROUP BY ALL")
def _(spark, d):
    # Complete, as rows are spread over the batches whatever their time: update would drop the late ones.
    return plain(sunk(streams.stream_minute_rollup(log_stream(spark, d)), "complete", ("minute", "service", "env", "level")), "minute", "service", "env", "level", "n")


@q("str7_first_seen_deploys", "SELECT DISTINCT version, service, env FROM logs")
def _(spark, d):
    return sunk(streams.stream_first_seen_deploys(log_stream(spark, d)), "append").select("version", "service", "env")


@q("str7_first_sightings", "SELECT version, service, env, min(ts) AS first_seen FROM logs GROUP BY ALL")
def _(spark, d):
    where, keys = folder(spark, "sightings"), ("version", "service", "env")
    drained(streams.sightings(log_stream(spark, d)), "append", streams.keep_first(where, keys))
    return plain(streams.latest_updates(spark.read.parquet(where), keys), *keys, "first_seen")


@q("ing9_dedup_stream", "SELECT id, id // 20 AS batch_id, min(ts) OVER (PARTITION BY id // 20) AS received_at FROM logs")
def _(spark, d):
    # Batches of 20 rows; two in three are sent again ten minutes later, with all their rows.
    rows = logs(spark, d).select("id", "ts", F.floor(F.col("id") / 20).alias("batch_id"))
    first = F.min("ts").over(Window.partitionBy("batch_id"))
    times = F.when(F.col("batch_id") % 3 > 0, F.array(first, first + F.expr("interval 10 minutes"))).otherwise(F.array(first))
    sent = rows.select("id", "batch_id", times.alias("times")).select("id", "batch_id", F.explode("times").alias("received_at"))
    stream = ordered_stream(spark, sent.withColumn("ts", F.col("received_at")))
    return plain(sunk(ing.dedup_batches_stream(stream), "append"), "id", "batch_id", "received_at")


QUERIES, SQL = B.queries, B.sql
