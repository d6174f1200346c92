"""Queries of the predicate, search and aggregate families, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates as agg
from ..operators import errors as err
from ..operators import predicates as flt
from ..operators import search as srt
from .views import AS_OF, Book, logs, table

B = Book()
NTZ = "timestamp_ntz"
LOG_COLS = ("id", "ts", "level", "service", "env", "message")


def plain(df, *cols):
    """Only `cols`, times without a zone."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast(NTZ).alias(c) if kinds[c] == "timestamp" else c for c in (cols or df.columns)])


def q(name, sql, views=("logs",)):
    return B.add(name, sql, views)


COLS = ", ".join(LOG_COLS)


@q("flt1_filter_logs", f"SELECT {COLS} FROM logs WHERE lower(service)='api' AND (env='' OR lower(env)='production') AND duration_ms >= 20 AND db_count >= 5 AND contains(path, 'click') AND NOT n_plus_one AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'")
def _(spark, d):
    return plain(flt.filter_logs(logs(spark, d), service="API", env="Production", min_duration_ms=20, min_db_count=5, path="click", n_plus_one=False, start="2024-01-05", end="2024-01-25"), *LOG_COLS)


@q("flt2_env_matches", "SELECT env, count(*) AS n FROM logs WHERE env='' OR lower(env)='staging' GROUP BY env")
def _(spark, d):
    return logs(spark, d).filter(flt.env_matches("STAGING")).groupBy("env").agg(F.count("*").alias("n"))


@q("flt3_is_request", "SELECT kind, count(*) AS n FROM logs WHERE kind='request' OR event_type='http.request' OR (coalesce(duration_ms,0)>0 AND (coalesce(method,'')<>'' OR coalesce(path,'')<>'' OR coalesce(handler,'')<>'')) GROUP BY kind")
def _(spark, d):
    return logs(spark, d).filter(flt.is_request()).groupBy("kind").agg(F.count("*").alias("n"))


@q("flt4_handler_matches", "SELECT handler, count(*) AS n FROM logs WHERE lower(handler)='orderscontroller' OR lower(split_part(handler,'#',1))='orderscontroller' GROUP BY handler")
def _(spark, d):
    return logs(spark, d).filter(flt.handler_matches("ordersController")).groupBy("handler").agg(F.count("*").alias("n"))


@q("flt5_tokenize", f"SELECT doc_id, len({text.sql_tokens('text')}) AS n_tokens, md5(list_aggregate(list_sort({text.sql_tokens('text')}), 'string_agg', ' ')) AS digest FROM documents WHERE text IS NOT NULL", ())
def _(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.when(F.size("t") > 0, F.md5(F.array_join(F.array_sort("t"), " "))).alias("digest"))


@q("flt6_full_text", "SELECT id, message FROM logs WHERE contains(' ' || lower(message) || ' ', ' purchase ') AND regexp_matches(lower(message), '(^|[^a-z0-9_-])ms([^a-z0-9_-]|$)') AND regexp_matches(message, '(^|[^a-z0-9_-])10([^a-z0-9_-]|$)')")
def _(spark, d):
    return flt.full_text(logs(spark, d), "10 MS purchase").select("id", "message")


@q("flt6_postings", f"SELECT doc_id AS id FROM documents WHERE list_has_all({text.sql_tokens('text')}, ['the','and','that'])", ())
def _(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))
    return flt.full_text_by_postings(rows, flt.posting_table(rows), "The and THAT").select("id")


@q("flt7_metadata_filter", "SELECT id FROM logs WHERE json_extract_string(body,'$.metadata.k')='7'")
def _(spark, d):
    return logs(spark, d).filter(flt.metadata_filter({"k": "7"})).select("id")


@q("flt8_exclude", "SELECT service, env, count(*) AS n FROM logs WHERE lower(service) NOT IN ('api','web') AND (env='' OR lower(env)<>'staging') GROUP BY ALL")
def _(spark, d):
    rows = logs(spark, d)
    return rows.filter(flt.excluded(rows, {"service": "API, web", "env": "staging", "nothing": "x"})).groupBy("service", "env").agg(F.count("*").alias("n"))


@q("flt9_project_fields", "SELECT id, ts, service, duration_ms FROM logs")
def _(spark, d):
    return plain(flt.project_fields(logs(spark, d), "service, duration_ms, nonsense, id"))


DEPLOYS = "deploys AS (SELECT version, service, env, min(ts) AS first_seen FROM logs WHERE coalesce(version,'')<>'' GROUP BY ALL)"


@q("flt10_last_deploy_window", f", {DEPLOYS} SELECT id FROM logs WHERE ts >= (SELECT max(first_seen) FROM deploys WHERE service='web' AND (env='' OR env='production'))".replace(", deploys", ", deploys", 1))
def _(spark, d):
    from ..operators.deploys import deploys

    rows = logs(spark, d)
    return flt.last_deploy_window(rows, deploys(rows), "web", "production").select("id")


@q("flt11_is_critical", "SELECT id FROM logs WHERE contains(lower(coalesce(path,'')),'/purchase/1') OR contains(lower(coalesce(message,'')),'/purchase/1') OR contains(lower(coalesce(path,'')),'error 1') OR contains(lower(coalesce(message,'')),'error 1')")
def _(spark, d):
    return logs(spark, d).filter(flt.is_critical(["/PURCHASE/1", "Error 1"], "path", "message")).select("id")


@q("srt1_search_logs", f"SELECT {COLS} FROM logs WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND level='error' ORDER BY ts DESC, id DESC LIMIT 40 OFFSET 10")
def _(spark, d):
    return plain(srt.search_logs(logs(spark, d), AS_OF, start="2024-01-10", end="2024-01-20", level="ERROR", limit=40, offset=10), *LOG_COLS)


REQ = "kind='request' AND duration_ms > 0"


@q("srt2_search_requests", f"SELECT id, service, path, duration_ms FROM logs WHERE {REQ} ORDER BY duration_ms DESC, id LIMIT 20")
def _(spark, d):
    return srt.search_requests(logs(spark, d)).select("id", "service", "path", "duration_ms")


@q("srt3_get_log", f"SELECT {COLS} FROM logs WHERE id=777")
def _(spark, d):
    return plain(srt.get_log(logs(spark, d), 777), *LOG_COLS)


@q(
    "srt4_log_context",
    """, a AS (SELECT id AS anchor, ts AS at, env AS aenv FROM logs WHERE id % 20 = 0),
n AS (SELECT a.anchor, l.id, CASE WHEN l.id=a.anchor THEN 'anchor' WHEN (l.ts, l.id) < (a.at, a.anchor) THEN 'before' ELSE 'after' END AS side, l.ts
  FROM logs l JOIN a ON l.env=a.aenv AND abs(epoch(l.ts)-epoch(a.at)) < 86401 AND abs(datediff('second', a.at, l.ts)) <= 86400),
r AS (SELECT *, CASE side WHEN 'before' THEN row_number() OVER (PARTITION BY anchor, side ORDER BY ts DESC, id DESC) WHEN 'after' THEN row_number() OVER (PARTITION BY anchor, side ORDER BY ts, id) ELSE 0 END AS n FROM n)
SELECT anchor, side, CAST(n AS INT) AS n, id FROM r WHERE n <= 5""",
)
def _(spark, d):
    rows = logs(spark, d)
    return srt.log_context(rows, rows.filter("id % 20 = 0"), 5, 5).select("anchor", "side", F.col("n").cast("int").alias("n"), "id")


@q("srt5_tail_logs", "SELECT id, level FROM logs WHERE id > 100 ORDER BY id LIMIT 60")
def _(spark, d):
    return srt.tail_logs(logs(spark, d), 100, 60).select("id", "level")


GROUPS = "g AS (SELECT error_fingerprint AS fingerprint, env, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM logs WHERE level IN ('error','fatal') AND error_fingerprint<>'' GROUP BY ALL)"


@q("srt6_enrich_with_groups", f", {GROUPS} SELECT l.id, l.error_fingerprint, CASE WHEN g.fingerprint IS NOT NULL THEN 'unresolved' END AS group_status, g.occurrences AS group_occurrences, g.last_seen AS group_last_seen FROM logs l LEFT JOIN g ON l.error_fingerprint=g.fingerprint AND l.env=g.env")
def _(spark, d):
    rows = logs(spark, d)
    groups = err.error_groups(rows)
    return plain(srt.enrich_with_groups(rows, groups), "id", "error_fingerprint", "group_status", "group_occurrences", "group_last_seen")


@q("srt7_service_fallback", "SELECT service, count(*) AS n FROM logs WHERE service='billing' GROUP BY service")
def _(spark, d):
    return srt.search_with_service_fallback(logs(spark, d), "billing").groupBy("service").agg(F.count("*").alias("n"))


@q("srt8_time_distribution", "SELECT time_bucket(INTERVAL 1 hour, ts) AS bucket, 3600 AS width, count(*) AS n FROM logs WHERE level='fatal' GROUP BY ALL")
def _(spark, d):
    return plain(srt.time_distribution(logs(spark, d).filter("level = 'fatal'")))


@q("srt8_all_rows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS bucket, 3600 AS width, count(*) AS n FROM logs GROUP BY ALL")
def _(spark, d):
    return plain(srt.time_distribution(logs(spark, d)))


@q("srt8_narrow_spans", ", o AS (SELECT min(ts) AS s FROM logs), w AS (SELECT l.ts, p.span FROM logs l, o, (VALUES (2, 60), (12, 300), (48, 1800)) p(h, span) WHERE l.ts <= o.s + to_hours(p.h)), m AS (SELECT span, datediff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) - CASE WHEN max(ts) - date_trunc('second', max(ts)) < min(ts) - date_trunc('second', min(ts)) THEN 1 ELSE 0 END AS s FROM w GROUP BY 1), x AS (SELECT span, CASE WHEN s<=300 THEN 30 WHEN s<=1800 THEN 60 WHEN s<=7200 THEN 300 WHEN s<=43200 THEN 1800 ELSE 3600 END AS width FROM m) SELECT CAST(w.span AS INT) AS span, make_timestamp((epoch_us(ts) // 1000000 // width * width) * 1000000) AS bucket, width, count(*) AS n FROM w JOIN x USING (span) GROUP BY ALL")
def _(spark, d):
    rows = logs(spark, d)
    first = rows.agg(F.min("ts")).first()[0]
    within = lambda h: rows.filter(F.col("ts") <= F.lit(first) + F.make_dt_interval(hours=F.lit(h)))
    parts = [srt.time_distribution(within(h)).select(F.lit(span).alias("span"), "bucket", "width", "n") for h, span in ((2, 60), (12, 300), (48, 1800))]
    return plain(parts[0].union(parts[1]).union(parts[2]))


@q("srt9_result_summary", ", p AS (SELECT * FROM logs ORDER BY ts DESC, id DESC LIMIT 100) SELECT 'level' AS field, level AS value, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'service', service, count(*) FROM p GROUP BY ALL")
def _(spark, d):
    return srt.result_summary(srt.search_logs(logs(spark, d), AS_OF, start="2024-01-01", limit=100))


@q("agg1_count_by_level", "SELECT level, count(*) AS n FROM logs WHERE lower(service)='web' GROUP BY level")
def _(spark, d):
    return agg.count_by_level(logs(spark, d), service="web")


ERR = "level IN ('error','fatal')"


@q("agg2_error_rate", f"SELECT count(*) AS total, CAST(count(*) FILTER ({ERR}) AS BIGINT) AS errors, round(count(*) FILTER ({ERR})*100.0::DOUBLE/count(*),4) AS percent FROM logs")
def _(spark, d):
    return agg.error_rate(logs(spark, d))


@q("agg3_count_by_service", f"SELECT service, count(*) AS total, count(*) FILTER ({ERR}) AS errors FROM logs GROUP BY service")
def _(spark, d):
    return agg.count_by_service(logs(spark, d))


@q(
    "agg4_histogram",
    ", b AS (SELECT unnest(generate_series(0, 240)) AS i), c AS (SELECT datediff('second', TIMESTAMP '2024-01-10 00:07:00', date_trunc('second', ts)) // 3600 AS i, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-10 00:07:00' AND ts < TIMESTAMP '2024-01-20 00:07:00' AND service='api' GROUP BY ALL) SELECT TIMESTAMP '2024-01-10 00:07:00' + to_seconds(b.i*3600) AS bucket, coalesce(c.n,0) AS n FROM b LEFT JOIN c USING (i)",
)
def _(spark, d):
    return plain(agg.histogram(logs(spark, d), "2024-01-10 00:07:00", "2024-01-20 00:07:00", 3600, service="api"))


@q("agg5_rollup_minute", "SELECT date_trunc('minute', ts) AS minute, service, env, level, count(*) AS n, min(id) AS first_id, max(id) AS last_id, min(ts) AS first_ts, max(ts) AS last_ts FROM logs GROUP BY ALL")
def _(spark, d):
    return plain(agg.rollup_minute(logs(spark, d)))


@q("agg5_service_from_rollup", f"SELECT service, count(*) AS total, count(*) FILTER ({ERR}) AS errors FROM logs GROUP BY service")
def _(spark, d):
    return agg.count_by_service_from_rollup(agg.rollup_minute(logs(spark, d)))


@q("agg6_distinct_values", "SELECT DISTINCT source_file AS value FROM logs WHERE coalesce(source_file,'')<>''")
def _(spark, d):
    return agg.distinct_values(logs(spark, d), "source_file")


@q("agg7_attribute_values", "SELECT DISTINCT version AS value FROM logs ORDER BY 1 LIMIT 100")
def _(spark, d):
    return agg.attribute_values(logs(spark, d), "commit")


@q("agg8_metadata_keys", "SELECT 'k' AS key, count(*) AS n FROM logs WHERE json_extract_string(body,'$.metadata.k') IS NOT NULL")
def _(spark, d):
    return agg.metadata_keys(logs(spark, d))


@q("agg9_aggregate_requests", f"SELECT count(*) AS requests, round(sum(duration_ms)::DOUBLE/count(*),4) AS avg_duration_ms, round(sum(db_count)::DOUBLE/count(*),4) AS avg_db_count, CAST(sum(cache_hits+cache_misses) AS BIGINT) AS cache_reads, CAST(sum(cache_hits) AS BIGINT) AS cache_hits, round(sum(cache_hits)*100.0::DOUBLE/sum(cache_hits+cache_misses),4) AS hit_rate FROM logs WHERE {REQ}")
def _(spark, d):
    return agg.aggregate_requests(logs(spark, d))


@q("agg10_performance_report", f", t AS (SELECT * FROM logs WHERE {REQ} ORDER BY duration_ms DESC, id LIMIT 50) SELECT count(*) AS requests, count(*) FILTER (n_plus_one) AS n_plus_one, round(sum(db_count)::DOUBLE/count(*),4) AS avg_sql, round(sum(duration_ms)::DOUBLE/count(*),4) AS avg_duration_ms, sum(db_count)/count(*) > 20 AS hint_sql, sum(duration_ms)/count(*) > 1000 AS hint_slow FROM t")
def _(spark, d):
    return agg.performance_report(logs(spark, d), limit=50)


@q("agg10_performance_rows", f"SELECT id, service, path, duration_ms, db_count FROM logs WHERE {REQ} ORDER BY duration_ms DESC, id LIMIT 50")
def _(spark, d):
    return agg.performance_rows(logs(spark, d), limit=50).select("id", "service", "path", "duration_ms", "db_count")


LV = ", ".join(f"count(*) FILTER (level='{v}') AS {v}" for v in ("debug", "info", "warn", "error", "fatal"))


@q("agg11_level_trend", f", t AS (SELECT time_bucket(INTERVAL 5 minute, ts) AS bucket, count(*) AS n, {LV} FROM logs WHERE ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-21' GROUP BY 1) SELECT *, n > 1.4*avg(n) OVER () AS warning FROM t ORDER BY bucket DESC LIMIT 500")
def _(spark, d):
    return plain(agg.level_trend(logs(spark, d), start="2024-01-20", end="2024-01-21"))


@q("agg12_service_error_rates", f", t AS (SELECT service, count(*) AS total, count(*) FILTER ({ERR}) AS errors FROM logs GROUP BY service) SELECT *, round(errors*100.0::DOUBLE/total,4) AS percent, errors*100.0::DOUBLE/total > 1.25*(sum(errors) OVER ()*100.0::DOUBLE/sum(total) OVER ()) AS high FROM t")
def _(spark, d):
    return agg.service_error_rates(logs(spark, d))


@q("agg13_error_patterns", f", t AS (SELECT {text.sql_mask('message')} AS pattern, * FROM logs WHERE {ERR}) SELECT pattern, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(message, id) AS sample, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, round(count(*)*100.0::DOUBLE/(SELECT count(*) FROM t),4) AS share, count(*)*2 > (SELECT count(*) FROM t) AS dominant FROM t GROUP BY pattern ORDER BY n DESC, pattern LIMIT 20")
def _(spark, d):
    return plain(agg.error_patterns(logs(spark, d)))


@q("agg14_active_commits", f"SELECT version, min(ts) AS first_seen, count(*) AS n, count(*) FILTER ({ERR}) AS errors FROM logs GROUP BY version ORDER BY first_seen DESC, version LIMIT 10")
def _(spark, d):
    return plain(agg.active_commits(logs(spark, d)))


@q("agg15_unique_errors", f"SELECT coalesce(nullif(error_fingerprint,''), nullif(error_class,''), left(message,80)) AS error_key, count(*) AS n, min(ts) AS first_seen FROM logs WHERE {ERR} GROUP BY 1 ORDER BY n DESC, error_key LIMIT 10")
def _(spark, d):
    return plain(agg.unique_errors(logs(spark, d)))


@q("agg16_slowest_endpoints", f"SELECT id, service, method, path, handler, duration_ms FROM logs WHERE {REQ} AND service='worker' ORDER BY duration_ms DESC, id LIMIT 5")
def _(spark, d):
    return agg.slowest_endpoints(logs(spark, d), service="worker")


@q(
    "agg17_logs_summary",
    f""", {GROUPS} SELECT 'level' AS section, level AS key, count(*) AS n FROM logs GROUP BY level
UNION ALL SELECT 'total', 'logs', count(*) FROM logs UNION ALL SELECT 'total', 'errors', count(*) FROM logs WHERE {ERR}
UNION ALL (SELECT 'commit', version, n FROM (SELECT version, min(ts) AS f, count(*) AS n FROM logs GROUP BY version ORDER BY f DESC, version LIMIT 10))
UNION ALL (SELECT 'error', k, n FROM (SELECT coalesce(nullif(error_fingerprint,''), nullif(error_class,''), left(message,80)) AS k, count(*) AS n FROM logs WHERE {ERR} GROUP BY 1 ORDER BY n DESC, k LIMIT 10))
UNION ALL (SELECT 'slow', CAST(id AS VARCHAR), duration_ms FROM logs WHERE {REQ} ORDER BY duration_ms DESC, id LIMIT 5)
UNION ALL SELECT 'open_groups', 'groups', count(*) FROM g""",
)
def _(spark, d):
    rows = logs(spark, d)
    return agg.logs_summary(rows, err.error_groups(rows))


def _change_sql(key, cond, cur, base):
    inside = lambda p: f"(ts >= TIMESTAMP '{p[0]}' AND ts < TIMESTAMP '{p[1]}')"
    return (
        f", c AS (SELECT {key}, count(*) FILTER ({inside(cur)}) AS current, count(*) FILTER ({inside(base)}) AS baseline FROM logs WHERE ({inside(cur)} OR {inside(base)}) {cond} GROUP BY 1), "
        "p AS (SELECT *, CASE WHEN baseline=0 AND current=0 THEN 0.0 WHEN baseline=0 THEN current*100.0 ELSE round((current-baseline)*100.0::DOUBLE/baseline,2) END::DOUBLE AS percent FROM c) "
        f"SELECT *, CASE WHEN baseline=0 AND current>0 THEN 'new' WHEN percent>0 THEN 'increase' WHEN percent<0 THEN 'decrease' ELSE 'unchanged' END AS change FROM p ORDER BY abs(percent) DESC, {key} LIMIT 5"
    )


CUR, BASE = ("2024-01-20 00:00:00", "2024-01-21 00:00:00"), ("2024-01-19 00:00:00", "2024-01-20 00:00:00")


@q("agg18_compare_errors", _change_sql("service", f"AND {ERR}", CUR, BASE))
def _(spark, d):
    return agg.compare_errors(logs(spark, d), CUR, BASE)


@q("agg19_compare_volume", _change_sql("level", "", CUR, BASE))
def _(spark, d):
    return agg.compare_volume(logs(spark, d), CUR, BASE)


@q("agg20_changes", f", {GROUPS}, e AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-25') AS errors, count(*) FILTER (ts < TIMESTAMP '2024-01-25') AS errors_before FROM logs WHERE {ERR} AND ts >= TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '{AS_OF}') SELECT *, (SELECT count(*) FROM g WHERE first_seen >= TIMESTAMP '2024-01-25' AND first_seen <= TIMESTAMP '{AS_OF}') AS new_groups, round((errors-errors_before)*100.0::DOUBLE/errors_before,2) AS percent FROM e")
def _(spark, d):
    rows = logs(spark, d)
    return agg.changes(rows, err.error_groups(rows), "2024-01-25", AS_OF)


def measure_sql(start, end, keys, where="TRUE"):
    t = "kind='request' AND duration_ms>0"
    return (
        f"SELECT {keys}, count(*) AS log_count, count(*) FILTER ({ERR}) AS error_count, round(count(*) FILTER ({ERR})::DOUBLE/count(*),6) AS error_rate, "
        f"round(sum(duration_ms) FILTER ({t})::DOUBLE/count(duration_ms) FILTER ({t}),4) AS response_time, quantile_disc(duration_ms,0.95) FILTER ({t}) AS p95_response, "
        f"datediff('second', date_trunc('second', max(ts)), TIMESTAMP '{end}') - CASE WHEN max(ts) > date_trunc('second', max(ts)) THEN 1 ELSE 0 END AS heartbeat, CAST(coalesce(sum(db_count) FILTER ({t}),0) AS BIGINT) AS sql_count, "
        f"coalesce(round(sum(cache_hits) FILTER ({t})::DOUBLE/nullif(sum(cache_hits+cache_misses) FILTER ({t}),0),6),0.0) AS cache_hit_rate FROM logs WHERE ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}' AND {where} GROUP BY {keys}"
    )


@q("agg21_measure", measure_sql("2024-01-15", "2024-01-25", "service, env"))
def _(spark, d):
    return agg.measure(logs(spark, d), "2024-01-15", "2024-01-25")


QUERIES, SQL = B.queries, B.sql
