"""RPT: reports that merge signals. Unlike event lists become one frame by projection and union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import count_by_level, error_rate, measure, one, service_error_rates
from .predicates import env_matches, is_critical, is_error, same


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def event(df: DataFrame, at, kind: str, service, env, detail) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(F.col(at).alias("at"), F.lit(kind).alias("type"), text(service).alias("service"), text(env).alias("env"), text(detail).alias("detail"))


def within(c: str, start: str, end: str):
    return (F.col(c) >= F.lit(start).cast("timestamp")) & (F.col(c) <= F.lit(end).cast("timestamp"))


def timeline_events(logs, deploys, group_events, alerts, transitions, start: str, end: str, service=None, env=None) -> DataFrame:
    """RPT-1: every event of the window: errors, first sightings of commits, group life, alerts, health changes."""
    none = F.lit("")
    parts = [
        event(logs.filter(is_error()), "ts", "error", "service", "env", "message"),
        event(deploys, "first_seen", "deploy", "service", "env", "version"),
        event(group_events, "at", "group", "service", "env", F.concat_ws(" ", "event", "fingerprint")),
        event(alerts, "at", "alert", "service", none, "watch_id"),
        event(transitions, "checked_at", "health", "check", none, F.concat_ws(" -> ", "before", "status")),
    ]
    out = merged(parts).filter(within("at", start, end))
    if service:
        out = out.filter(same("service", service))
    return out.filter(env_matches(env)) if env else out


def incident_timeline(events: DataFrame, limit: int = 200) -> DataFrame:
    """RPT-1: oldest first."""
    return events.orderBy("at", "type", "service", "env", "detail").limit(limit)


def timeline_summary(events: DataFrame) -> DataFrame:
    """RPT-1: counts by type with the earliest event and how many services each touched."""
    return events.groupBy("type").agg(F.count("*").alias("n"), F.min("at").alias("earliest"), F.countDistinct("service").alias("services"))


def catchup(groups, alerts, deploys, since: str, as_of: str, env=None, critical: list[str] | None = None, limit: int = 50) -> DataFrame:
    """RPT-2: new unresolved groups, alerts and deploys since a cursor (at most 7 days back)."""
    s = F.greatest(F.lit(since).cast("timestamp"), F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(7)))
    new = groups.filter((F.col("status") == "unresolved") & (F.col("first_seen") >= s))
    crit = is_critical(critical, "service", "message") if critical else F.lit(False)
    item = lambda df, kind, severity, at, title, c: df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(at).alias("at"), F.col(title).cast("string").alias("title"), c.alias("critical"), "env")
    parts = [item(new, "error", 2, "first_seen", "fingerprint", crit), item(alerts.filter(F.col("at") >= s).withColumn("env", F.lit("")), "alert", 1, "at", "watch_id", F.lit(False)), item(deploys.filter(F.col("first_seen") >= s), "deploy", 3, "first_seen", "version", F.lit(False))]
    out = merged(parts)
    if env:
        out = out.filter(env_matches(env))
    return out.orderBy(F.desc("critical"), "severity", F.desc("at"), "title", "env").limit(limit)


def triage(groups, alerts, checks, servers, env=None, limit: int = 20, connectors: DataFrame | None = None) -> DataFrame:
    """RPT-3: what is open now, worst first; connectors (name, status) that failed are among it."""
    g = groups.filter(F.col("status") == "unresolved")
    if env:
        g = g.filter(env_matches(env))
    item = lambda df, kind, severity, title, weight: df.select(F.lit(kind).alias("type"), severity.alias("severity"), F.col(title).cast("string").alias("title"), weight.cast("long").alias("weight"))
    parts = [
        item(checks.filter("status = 'down'"), "check_down", F.lit(1), "check", F.lit(0)),
        item(alerts.filter("status = 'pending'"), "alert", F.lit(2), "watch_id", F.lit(0)),
        item(servers.filter("status = 'offline'"), "server_offline", F.lit(2), "server", F.lit(0)),
        item(g, "error_group", F.when(F.col("occurrences") >= 100, 2).otherwise(3), "fingerprint", F.col("occurrences")),
    ]
    if connectors is not None:
        parts.append(item(connectors.filter("status = 'error'"), "connector_failed", F.lit(2), "name", F.lit(0)))
    return merged(parts).orderBy("severity", F.desc("weight"), "type", "title").limit(limit)


def status(logs, groups, alerts, checks, servers, as_of: str) -> DataFrame:
    """RPT-4: one row of counts."""
    hour = (F.col("ts") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(1))) & (F.col("ts") <= F.lit(as_of).cast("timestamp"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = [
        logs.filter(hour).agg(F.count("*").alias("logs_1h"), zero(one(is_error())).alias("errors_1h")),
        groups.agg(zero(one(F.col("status") == "unresolved")).alias("open_groups")),
        alerts.agg(zero(one(F.col("status") == "pending")).alias("pending_alerts")),
        checks.agg(F.count("*").alias("checks"), zero(one(F.col("status") == "down")).alias("checks_down")),
        servers.agg(F.count("*").alias("servers"), zero(one(F.col("status") == "offline")).alias("servers_offline")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def pairs(df: DataFrame, section: str, key: str, value: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.round(F.col(value).cast("double"), 4).alias("value"))


def wide(df: DataFrame, section: str, *columns: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")
    return pairs(df.select(each).select("p.*"), section, "key", "value")


def diagnose(logs, groups, alerts, checks, service: str, start: str, end: str, env=None) -> DataFrame:
    """RPT-5: (section, key, value) of errors, volume, performance, alerts and health of a service."""
    scope = dict(service=service, env=env, start=start, end=end)
    g = groups.filter(same("service", service) & env_matches(env) & (F.col("last_seen") >= F.lit(start).cast("timestamp")))
    m = measure(logs.filter(same("service", service)), start, end, env=env, keys=("service",))
    return merged(
        [
            wide(error_rate(logs, **scope), "errors", "total", "errors", "percent"),
            pairs(g.agg(F.count("*").alias("n")).withColumn("k", F.lit("active_groups")), "errors", "k", "n"),
            pairs(count_by_level(logs, **scope), "volume", "level", "n"),
            wide(m, "performance", "response_time", "p95_response", "sql_count", "cache_hit_rate"),
            pairs(alerts.filter(same("service", service)).groupBy("status").agg(F.count("*").alias("n")), "alerts", "status", "n"),
            pairs(checks.groupBy("status").agg(F.count("*").alias("n")), "health", "status", "n"),
        ]
    )


def investigate_overview(logs, groups, alerts, service: str, start: str, end: str, top: int = 5) -> DataFrame:
    """RPT-6: (section, key, value): largest groups, error classes, alerts, volume."""
    rows = logs.filter(same("service", service) & within("ts", start, end))
    g = groups.filter(same("service", service)).orderBy(F.desc("occurrences"), "fingerprint", "env").limit(top)
    classes = rows.filter(is_error()).groupBy("error_class").agg(F.count("*").alias("n"))
    return merged([pairs(g.withColumn("k", F.concat_ws("/", "fingerprint", "env")), "groups", "k", "occurrences"), pairs(classes, "errors", "error_class", "n"), pairs(alerts.filter(same("service", service)).groupBy("status").agg(F.count("*").alias("n")), "alerts", "status", "n"), wide(service_error_rates(rows), "volume", "total", "errors")])


def recent_errors(logs, service: str, start: str, end: str, limit: int = 10) -> DataFrame:
    """RPT-6: the newest error rows of a service."""
    rows = logs.filter(same("service", service) & within("ts", start, end) & is_error())
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "ts", "level", "error_class", "message", "trace_id")


def activity_stats(activity: DataFrame, as_of: str) -> DataFrame:
    """RPT-7: sessions of the last five minutes, calls and errors of the last hour, last activity."""
    age = F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis("created_at")
    five, hour = age.between(0, 300_000), age.between(0, 3_600_000)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return activity.agg(F.countDistinct(F.when(five, F.col("session"))).alias("active_sessions"), zero(one(hour)).alias("calls_1h"), zero(one(hour & F.col("is_error"))).alias("errors_1h"), F.max("created_at").alias("last_activity"))


def activity_of_investigations(activity: DataFrame) -> DataFrame:
    """RPT-7: the calls of every investigation in their order: `step` by step_index, then time."""
    order = Window.partitionBy("investigation").orderBy("step_index", "created_at", "id")
    return activity.filter(F.col("investigation").isNotNull()).withColumn("step", F.row_number().over(order))


def recent_activity(activity: DataFrame, limit: int = 50) -> DataFrame:
    """RPT-7: newest first."""
    return activity.orderBy(F.desc("created_at"), "id").limit(limit)
