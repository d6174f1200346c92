"""Queries of alert rules and merged reports, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deploys as dep
from ..operators import errors as err
from ..operators import health as hlt
from ..operators import reports as rpt
from ..operators import watches as wat
from ..operators.predicates import is_error
from .q_logs import ERR, measure_sql, plain
from .q_signals import events_of, groups_of, metrics, probes
from .views import AS_OF, VIEWS, Book, logs, table, written

B = Book()
q = B.add

NOW = "2024-01-20 12:00:00"
S, E, S2 = "2024-01-20 00:00:00", "2024-01-20 12:00:00", "2024-01-19 12:00:00"
B0 = "2024-01-19 00:00:00"
M = ("log_count", "error_count", "error_rate", "response_time", "p95_response", "heartbeat", "sql_count", "cache_hit_rate")


def _frame():
    parts = []
    for n, (s, e) in {"now": (S, E), "previous": (S2, S), "baseline": (B0, S)}.items():
        cols = ", ".join(f"{c}::DOUBLE AS {n}_{c}" for c in M)
        parts.append(f"{n}_m AS (SELECT service, env, {cols} FROM ({measure_sql(s, e, 'service, env')}))")
    zero = ", ".join(f"coalesce({n}_{c},0) AS {n}_{c}" for n in ("now", "previous", "baseline") for c in ("log_count", "error_count", "sql_count"))
    rest = ", ".join(f"{n}_{c}" if (n, c) != ("now", "heartbeat") else "coalesce(now_heartbeat,43200) AS now_heartbeat" for n in ("now", "previous", "baseline") for c in M if c not in ("log_count", "error_count", "sql_count"))
    return ", ".join(parts) + f", frame AS (SELECT service, env, {zero}, {rest} FROM now_m FULL JOIN previous_m USING (service, env) FULL JOIN baseline_m USING (service, env))"


VIEWS["frame"] = VIEWS["logs"] + ", " + _frame()
T1 = {"type": "threshold", "metric": "error_rate", "op": "gt", "value": 0.15}
T2 = {"type": "threshold", "metric": "response_time", "op": "lte", "value": 55.0}
R1 = {"type": "relative", "metric": "error_rate", "op": "gt", "multiple": 1.1}
D1 = {"type": "delta", "metric": "log_count", "percent": 20}
T1S, T2S = "coalesce(now_error_rate > 0.15, false)", "coalesce(now_response_time <= 55.0, false)"
R1S = "(coalesce(baseline_error_rate <> 0, false) AND coalesce(now_error_rate > baseline_error_rate*1.1, false))"
D1S = "coalesce(abs(now_log_count-previous_log_count)*100/nullif(previous_log_count,0), -1) >= 20"


def frame(spark, d):
    return wat.metrics_frame(logs(spark, d), NOW, 720, 1440)


def judged(name, tree, sql):
    @q(name, f"SELECT service, env, {sql} AS breached FROM frame", ("frame",))
    def _(spark, d):
        return frame(spark, d).select("service", "env", wat.evaluate_condition(tree).alias("breached"))


judged("wat1_condition_tree", {"any": [{"all": [T1, {"not": T2}]}, R1, {"all": [D1, T2]}]}, f"(({T1S} AND NOT {T2S}) OR {R1S} OR ({D1S} AND {T2S}))")
judged("wat2_threshold", T1, T1S)
judged("wat3_relative", R1, R1S)
judged("wat4_delta", D1, D1S)


@q("wat1_evaluate_watches", f"SELECT 'w1' AS watch_id, service, env, {T1S} AS breached FROM frame WHERE service='api' UNION ALL SELECT 'w2', service, env, {D1S} FROM frame", ("frame",))
def _(spark, d):
    return wat.evaluate_watches(frame(spark, d), [{"id": "w1", "service": "API", "condition": T1}, {"id": "w2", "condition": {"all": [D1]}}])


@q("wat5_count", f"SELECT service, env, count(DISTINCT user_id) AS users FROM logs WHERE ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}' AND level='error' GROUP BY ALL")
def _(spark, d):
    return wat.count_frame(logs(spark, d), NOW, "users", 720, "user_id", "ERROR")


@q("wat6_baseline", f", m AS ({measure_sql(S, E, 'service, env')}), c AS (SELECT service, env, array_to_string(list_sort(list(DISTINCT error_class)), ',') AS error_classes FROM logs WHERE ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}' AND {ERR} AND error_class<>'' GROUP BY ALL), p AS (SELECT service, env, count(*) AS n_endpoints, round(sum(a),2) AS endpoint_ms FROM (SELECT service, env, path, round(sum(duration_ms)::DOUBLE/count(*),4) AS a FROM logs WHERE ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}' AND duration_ms>0 GROUP BY ALL) GROUP BY ALL) SELECT service, env, log_count, p95_response, error_classes, n_endpoints, endpoint_ms FROM m LEFT JOIN c USING (service, env) LEFT JOIN p USING (service, env)")
def _(spark, d):
    b = wat.baseline(logs(spark, d), S, E)
    total = F.round(F.aggregate("endpoints", F.lit(0.0), lambda a, x: a + x["avg_ms"]), 2)
    return b.select("service", "env", "log_count", "p95_response", "error_classes", F.size("endpoints").cast("long").alias("n_endpoints"), total.alias("endpoint_ms"))


VIEWS["runs"] = VIEWS["logs"] + f""", runs AS (SELECT 'watch-' || service AS watch_id, service, time_bucket(INTERVAL 6 hour, ts) AS t, count(*) FILTER ({ERR}) >= 4 AS breached FROM logs GROUP BY ALL),
isl AS (SELECT *, sum(CASE WHEN breached THEN 0 ELSE 1 END) OVER (PARTITION BY watch_id ORDER BY t) AS i FROM runs),
streaks AS (SELECT watch_id, service, t AS "at", breached, CAST(sum(CASE WHEN breached THEN 1 ELSE 0 END) OVER (PARTITION BY watch_id, i ORDER BY t) AS BIGINT) AS consecutive FROM isl),
alerts AS (SELECT watch_id || '@' || epoch_us("at")//1000000 AS alert_id, watch_id, service, "at", 'pending' AS status FROM streaks WHERE breached AND consecutive=2)"""


def runs_in(rows):
    return wat.breach_runs(wat.run_history(rows, 360, 4), 2)


def runs_of(spark, d):
    return runs_in(logs(spark, d))


def alerts_of(spark, d):
    return alerts_in(logs(spark, d))


def alerts_in(rows):
    a = runs_in(rows).filter("alert")
    return a.select(F.concat_ws("@", "watch_id", F.unix_seconds("at")).alias("alert_id"), "watch_id", "service", "at", F.lit("pending").alias("status"))


@q("wat7_breach_runs", "SELECT watch_id, \"at\", breached, consecutive, breached AND consecutive=2 AS alert FROM streaks", ("runs",))
def _(spark, d):
    return plain(runs_of(spark, d), "watch_id", "at", "breached", "consecutive", "alert")


WROWS = "w AS (SELECT service || '/' || env AS watch_id, service, env, CASE WHEN now_error_rate > 0.1 THEN 'triggered' ELSE 'active' END AS status, now_error_rate AS value, baseline_error_rate AS baseline, env='staging' AS compound, now_error_rate > 0.2 AS breached FROM frame)"


def watch_rows(spark, d):
    f = frame(spark, d)
    return f.select(F.concat_ws("/", "service", "env").alias("watch_id"), "service", "env", F.when(F.col("now_error_rate") > 0.1, "triggered").otherwise("active").alias("status"), F.col("now_error_rate").alias("value"), F.col("baseline_error_rate").alias("baseline"), (F.col("env") == "staging").alias("compound"), (F.col("now_error_rate") > 0.2).alias("breached"))


@q("wat8_auto_resolve", f", {WROWS} SELECT watch_id, CASE WHEN status='triggered' AND CASE WHEN compound THEN NOT breached ELSE coalesce(baseline<>0 AND abs(value-baseline)/abs(baseline) <= 0.10, false) END THEN 'resolved' ELSE status END AS status FROM w", ("frame",))
def _(spark, d):
    return wat.auto_resolve(watch_rows(spark, d)).select("watch_id", "status")


DEP = ", dp AS (SELECT version, service, env, min(ts) AS first_seen FROM logs GROUP BY ALL)"


@q("wat9_expire_watches", DEP + " SELECT version, service, env, CASE WHEN first_seen + INTERVAL 24 hour <= TIMESTAMP '2024-01-20 12:00:00' THEN 'expired' ELSE 'active' END AS status FROM dp")
def _(spark, d):
    w = dep.deploys(logs(spark, d)).withColumns({"expires_at": F.col("first_seen") + F.expr("interval 24 hours"), "status": F.lit("active")})
    return wat.expire_watches(w, NOW).select("version", "service", "env", "status")


@q(
    "wat10_evidence",
    f""", n AS (SELECT * FROM logs WHERE service='api' AND ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}'), b AS (SELECT * FROM logs WHERE service='api' AND ts >= TIMESTAMP '{S2}' AND ts < TIMESTAMP '{S}'),
ep AS (SELECT path, sum(duration_ms)::DOUBLE/count(*) AS a, count(*) AS n FROM n WHERE duration_ms>0 GROUP BY 1), eb AS (SELECT path, sum(duration_ms)::DOUBLE/count(*) AS b FROM b WHERE duration_ms>0 GROUP BY 1)
SELECT 'error_class' AS part, error_class AS key, count(*) AS n, CASE WHEN error_class IN (SELECT error_class FROM b WHERE {ERR}) THEN 'known' ELSE 'new' END AS detail FROM n WHERE {ERR} GROUP BY error_class
UNION ALL SELECT 'endpoint', path, n, '' FROM ep JOIN eb USING (path) WHERE a > 1.10*b
UNION ALL SELECT 'file', source_file, count(*), '' FROM n WHERE {ERR} AND coalesce(source_file,'')<>'' GROUP BY 2 UNION ALL SELECT 'trace', trace_id, count(*), '' FROM n WHERE {ERR} GROUP BY 2""",
)
def _(spark, d):
    e = wat.evidence(logs(spark, d), S, E, S2, "api")
    return e.withColumn("detail", F.when(F.col("part") == "endpoint", "").otherwise(F.col("detail")))


@q(
    "wat10_evidence_bundle",
    f""", n AS (SELECT * FROM logs WHERE service='api' AND ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}'), m AS ({measure_sql(S2, S, 'service', chr(115) + 'ervice=' + chr(39) + 'api' + chr(39))}),
r AS (SELECT id::VARCHAR AS key, level || ' ' || left(message, 200) AS detail FROM n ORDER BY ts DESC, id DESC LIMIT 20)
SELECT 'row' AS part, key, 1 AS n, detail FROM r UNION ALL SELECT 'timeline', '2024-01-18 00:00:00', 0, 'watch_created' UNION ALL SELECT 'timeline', '{S}', 1, 'baseline_captured' UNION ALL SELECT 'timeline', '{E}', 2, 'alert_triggered: log_count = 500.0000'
UNION ALL SELECT 'baseline', 'log_count', 1, 'baseline ' || log_count::DOUBLE || ' now 500.0 ' || round((500.0-log_count)*100.0::DOUBLE/log_count, 2) || '%' FROM m""",
)
def _(spark, d):
    watch = {"service": "API", "metric": "log_count", "created_at": "2024-01-18 00:00:00"}
    return wat.evidence_bundle(logs(spark, d), watch, 500, S, E, S2).filter("part in ('row', 'baseline', 'timeline')")


@q("wat11_default_watches", "SELECT service, env, m.metric AS metric, 'gt' AS op, m.value AS value, CAST(m.w AS INT) AS window_min, CAST(m.c AS INT) AS min_consecutive FROM (SELECT DISTINCT service, env FROM logs WHERE env<>'staging') CROSS JOIN (VALUES ('error_rate', 0.05::DOUBLE, 5, 2), ('heartbeat', 900.0::DOUBLE, 20, 1)) m(metric, value, w, c)")
def _(spark, d):
    rows = logs(spark, d)
    return wat.default_watches(rows, rows.filter("env = 'staging'").select("service", "env").distinct())


@q("wat12_deploy_watches", DEP + " SELECT version, service, env, first_seen + INTERVAL 24 hour AS expires_at FROM dp WHERE first_seen >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    found = dep.deploys(logs(spark, d))
    return plain(wat.deploy_watches(found, found.filter(F.col("first_seen") < F.lit("2024-01-15").cast("timestamp"))), "version", "service", "env", "expires_at")


@q("wat13_watch_status", "SELECT watch_id, count(*) AS runs, count(*) FILTER (breached AND consecutive=2) AS alerts FROM streaks GROUP BY 1", ("runs",))
def _(spark, d):
    runs = runs_of(spark, d)
    watches = runs.select("watch_id", F.lit("active").alias("status")).distinct()
    return wat.watch_status(watches, runs, runs.filter("alert"), "active").select("watch_id", "runs", "alerts")


def parents(spark, d):
    return logs(spark, d).select(F.concat_ws("-", F.lit("watch"), "service").alias("watch_id"), "service", F.lit("production").alias("env")).distinct()


@q("wat14_list_alerts", "SELECT alert_id, watch_id FROM alerts WHERE service IN ('web')", ("runs",))
def _(spark, d):
    return wat.list_alerts(alerts_of(spark, d), parents(spark, d), "pending", "WEB", "production").select("alert_id", "watch_id")


@q("wat15_alert_status", "SELECT alert_id, CASE WHEN day(\"at\") % 3 = 0 THEN 'dismissed' WHEN day(\"at\") % 3 = 1 THEN 'acknowledged' ELSE 'pending' END AS status FROM alerts", ("runs",))
def _(spark, d):
    a = alerts_of(spark, d)
    day = F.dayofmonth("at") % 3
    act = lambda cond, what, hours: a.filter(cond).select("alert_id", F.lit(what).alias("action"), (F.col("at") + F.make_dt_interval(hours=F.lit(hours))).alias("at"))
    actions = act(day < 2, "acknowledged", 1).union(act(day == 0, "dismissed", 2))
    return wat.alert_status(a, actions).select("alert_id", "status")


@q("wat16_investigate_service", f", m AS ({measure_sql(S, E, 'service', chr(115) + 'ervice=' + chr(39) + 'web' + chr(39))}) SELECT 'metric' AS part, k AS key, v AS value FROM (SELECT unnest(['log_count','error_count','error_rate','response_time','p95_response','heartbeat','sql_count','cache_hit_rate']) AS k, unnest([log_count::DOUBLE,error_count,error_rate,response_time,p95_response,heartbeat,sql_count,cache_hit_rate]) AS v FROM m) UNION ALL SELECT 'error_class', error_class, count(*)::DOUBLE FROM logs WHERE service='web' AND {ERR} AND ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}' GROUP BY 2")
def _(spark, d):
    return wat.investigate_service(logs(spark, d), "Web", S, E)


@q("wat16_service_rows", f"SELECT id, ts, level, error_class, message FROM logs WHERE service='web' AND ts >= TIMESTAMP '{S}' AND ts < TIMESTAMP '{E}' ORDER BY {ERR} DESC, ts DESC, id DESC LIMIT 20")
def _(spark, d):
    return plain(wat.service_rows(logs(spark, d), "Web", S, E))


# One week of every signal, as one list of events.
VIEWS["signals"] = VIEWS["acts"] + ", " + VIEWS["probes"] + ", " + VIEWS["runs"].removeprefix(VIEWS["logs"] + ", ") + f""", dpl AS (SELECT version, service, env, min(ts) AS first_seen FROM logs GROUP BY ALL),
tr AS (SELECT "check", checked_at, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY "check" ORDER BY checked_at, response_ms, status_code) AS before FROM probes) WHERE before<>status),
sig AS (SELECT ts AS "at", 'error' AS type, service, env, message AS detail FROM logs WHERE {ERR} UNION ALL SELECT first_seen, 'deploy', service, env, version FROM dpl
 UNION ALL SELECT e."at", 'group', g.service, e.env, e.event || ' ' || e.fingerprint FROM evts e JOIN groups g USING (fingerprint, env) UNION ALL SELECT "at", 'alert', service, '', watch_id FROM alerts
 UNION ALL SELECT checked_at + INTERVAL 28 year, 'health', "check", '', before || ' -> ' || status FROM tr)"""


def signals(spark, d, start, end, **scope):
    # Every signal but the probes comes from these columns; texts are kept for error rows alone.
    rows = logs(spark, d)
    rows = written(rows.select("id", "ts", "level", "service", "env", "version", "error_fingerprint", *[F.when(is_error(), F.col(c)).alias(c) for c in ("message", "error_class", "source_file")]))
    groups = written(err.error_groups(rows))
    life = events_of(rows, groups).join(groups.select("fingerprint", "env", "service"), ["fingerprint", "env"])
    moves = hlt.transitions(probes(spark, d), "1900-01-01", "2100-01-01").withColumn("checked_at", F.col("checked_at") + F.expr("interval 28 years"))
    return rpt.timeline_events(rows, dep.deploys(rows), life, alerts_in(rows), moves, start, end, **scope)


W0, W1 = "2024-01-15 00:00:00", "2024-01-22 00:00:00"


@q("rpt1_incident_timeline", f"SELECT * FROM sig WHERE \"at\" >= TIMESTAMP '{W0}' AND \"at\" <= TIMESTAMP '{W1}' ORDER BY \"at\", type, service, env, detail LIMIT 200", ("signals",))
def _(spark, d):
    return plain(rpt.incident_timeline(signals(spark, d, W0, W1)))


@q("rpt1_timeline_summary", f"SELECT type, count(*) AS n, min(\"at\") AS earliest, count(DISTINCT service) AS services FROM sig WHERE \"at\" >= TIMESTAMP '{W0}' AND \"at\" <= TIMESTAMP '{W1}' GROUP BY type", ("signals",))
def _(spark, d):
    return plain(rpt.timeline_summary(signals(spark, d, W0, W1)))


@q("rpt2_catchup", f", u AS (SELECT 'error' AS type, 2 AS severity, first_seen AS \"at\", fingerprint AS title, contains(lower(service),'bill') OR contains(lower(message),'bill') AS critical, env FROM groups UNION ALL SELECT 'alert', 1, \"at\", watch_id, false, '' FROM alerts UNION ALL SELECT 'deploy', 3, first_seen, version, false, env FROM dpl) SELECT * FROM u WHERE \"at\" >= TIMESTAMP '{AS_OF}' - INTERVAL 7 day ORDER BY critical DESC, severity, \"at\" DESC, title, env LIMIT 50", ("signals",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return plain(rpt.catchup(groups, alerts_of(spark, d), dep.deploys(rows), "2024-01-01", AS_OF, critical=["BILL"]))


VIEWS["now"] = VIEWS["signals"] + ", " + VIEWS["metrics"] + """, checks AS (SELECT "check", arg_max(status, (checked_at, response_ms, status_code)) AS status FROM probes GROUP BY 1),
servers AS (SELECT server, CASE WHEN max(ts) < TIMESTAMP '1998-11-01' - INTERVAL 30 day THEN 'offline' ELSE 'online' END AS status FROM metrics GROUP BY 1)"""


def checks_servers(spark, d):
    p = probes(spark, d)
    checks = hlt.uptime(p.select("check").distinct(), p, "1997-01-01")
    return checks, hlt.mark_stale_offline(hlt.register_servers(metrics(spark, d)), "1998-11-01", 30)


@q("rpt3_triage", ", u AS (SELECT 'check_down' AS type, 1 AS severity, \"check\" AS title, 0 AS weight FROM checks WHERE status='down' UNION ALL SELECT 'alert', 2, watch_id, 0 FROM alerts UNION ALL SELECT 'server_offline', 2, server, 0 FROM servers WHERE status='offline' UNION ALL SELECT 'error_group', CASE WHEN occurrences>=100 THEN 2 ELSE 3 END, fingerprint, occurrences FROM groups) SELECT * FROM u ORDER BY severity, weight DESC, type, title LIMIT 20", ("now",))
def _(spark, d):
    return rpt.triage(groups_of(spark, d)[1], alerts_of(spark, d), *checks_servers(spark, d))


@q("rpt3_triage_connectors", ", u AS (SELECT 'check_down' AS type, 1 AS severity, \"check\" AS title, 0 AS weight FROM checks WHERE status='down' UNION ALL SELECT 'alert', 2, watch_id, 0 FROM alerts UNION ALL SELECT 'server_offline', 2, server, 0 FROM servers WHERE status='offline' UNION ALL SELECT 'connector_failed', 2, 'db-' || n_nationkey, 0 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'error_group', CASE WHEN occurrences>=100 THEN 2 ELSE 3 END, fingerprint, occurrences FROM groups WHERE env='' OR env='staging') SELECT * FROM u ORDER BY severity, weight DESC, type, title LIMIT 60", ("now",))
def _(spark, d):
    connectors = table(spark, d, "nation").select(F.concat(F.lit("db-"), "n_nationkey").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "error").otherwise("ok").alias("status"))
    return rpt.triage(groups_of(spark, d)[1], alerts_of(spark, d), *checks_servers(spark, d), env="Staging", limit=60, connectors=connectors)


@q("rpt4_status", f"SELECT (SELECT count(*) FROM logs WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1 hour AND ts <= TIMESTAMP '{NOW}') AS logs_1h, (SELECT count(*) FROM logs WHERE {ERR} AND ts > TIMESTAMP '{NOW}' - INTERVAL 1 hour AND ts <= TIMESTAMP '{NOW}') AS errors_1h, (SELECT count(*) FROM groups) AS open_groups, (SELECT count(*) FROM alerts) AS pending_alerts, (SELECT count(*) FROM checks) AS checks, (SELECT count(*) FROM checks WHERE status='down') AS checks_down, (SELECT count(*) FROM servers) AS servers, (SELECT count(*) FROM servers WHERE status='offline') AS servers_offline", ("now",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return rpt.status(rows, groups, alerts_of(spark, d), *checks_servers(spark, d), NOW)


@q(
    "rpt5_diagnose",
    f""", l AS (SELECT * FROM logs WHERE service='api' AND ts >= TIMESTAMP '{S}' AND ts <= TIMESTAMP '{E}'), m AS ({measure_sql(S, E, 'service', chr(115) + 'ervice=' + chr(39) + 'api' + chr(39))})
SELECT 'errors' AS section, 'total' AS key, count(*)::DOUBLE AS value FROM l UNION ALL SELECT 'errors','errors',count(*) FILTER ({ERR}) FROM l UNION ALL SELECT 'errors','percent',round(count(*) FILTER ({ERR})*100.0::DOUBLE/count(*),4) FROM l
UNION ALL SELECT 'errors','active_groups',count(*) FROM groups WHERE service='api' AND last_seen >= TIMESTAMP '{S}' UNION ALL SELECT 'volume',level,count(*) FROM l GROUP BY level
UNION ALL SELECT 'performance','response_time',response_time FROM m UNION ALL SELECT 'performance','p95_response',p95_response FROM m UNION ALL SELECT 'performance','sql_count',sql_count FROM m UNION ALL SELECT 'performance','cache_hit_rate',round(cache_hit_rate,4) FROM m
UNION ALL SELECT 'alerts','pending',count(*) FROM alerts WHERE service='api' HAVING count(*)>0 UNION ALL SELECT 'health',status,count(*) FROM checks GROUP BY status""",
    ("now",),
)
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return rpt.diagnose(rows, groups, alerts_of(spark, d), checks_servers(spark, d)[0], "api", S, E)


@q(
    "rpt6_investigate_overview",
    f""", l AS (SELECT * FROM logs WHERE service='web' AND ts >= TIMESTAMP '{W0}' AND ts <= TIMESTAMP '{W1}')
(SELECT 'groups' AS section, fingerprint || '/' || env AS key, occurrences::DOUBLE AS value FROM groups WHERE service='web' ORDER BY occurrences DESC, fingerprint, env LIMIT 5)
UNION ALL SELECT 'errors', error_class, count(*) FROM l WHERE {ERR} GROUP BY 2 UNION ALL SELECT 'alerts','pending',count(*) FROM alerts WHERE service='web' HAVING count(*)>0
UNION ALL SELECT 'volume','total',count(*) FROM l UNION ALL SELECT 'volume','errors',count(*) FILTER ({ERR}) FROM l""",
    ("signals",),
)
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return rpt.investigate_overview(rows, groups, alerts_of(spark, d), "web", W0, W1)


@q("rpt6_recent_errors", f"SELECT id, ts, level, error_class, message, trace_id FROM logs WHERE service='web' AND {ERR} AND ts >= TIMESTAMP '{W0}' AND ts <= TIMESTAMP '{W1}' ORDER BY ts DESC, id DESC LIMIT 10")
def _(spark, d):
    return plain(rpt.recent_errors(logs(spark, d), "WEB", W0, W1))


@q("rpt7_activity_of_investigations", "SELECT event_id AS id, user_id AS investigation, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, ts, event_id) AS step FROM events WHERE event_id % 2 = 0", ())
def _(spark, d):
    a = activity(spark, d).withColumns({"investigation": F.when(F.col("id") % 2 == 0, F.col("session")), "step_index": F.col("id") % 5})
    return rpt.activity_of_investigations(a).select("id", "investigation", F.col("step").cast("long").alias("step"))


def activity(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), (F.col("event_type") == "error").alias("is_error"), F.col("ts").cast("timestamp").alias("created_at"))


@q("rpt7_activity_stats", f"SELECT count(DISTINCT user_id) FILTER (a >= 0 AND a <= 300000) AS active_sessions, count(*) FILTER (a >= 0 AND a <= 3600000) AS calls_1h, count(*) FILTER (a >= 0 AND a <= 3600000 AND event_type='error') AS errors_1h, max(ts) AS last_activity FROM (SELECT *, epoch_us(TIMESTAMP '{NOW}')//1000 - epoch_us(ts)//1000 AS a FROM events)", ())
def _(spark, d):
    return plain(rpt.activity_stats(activity(spark, d), NOW))


@q("rpt7_recent_activity", "SELECT event_id AS id, user_id AS session FROM events ORDER BY ts DESC, event_id LIMIT 50", ())
def _(spark, d):
    return rpt.recent_activity(activity(spark, d)).select("id", "session")


QUERIES, SQL = B.queries, B.sql
