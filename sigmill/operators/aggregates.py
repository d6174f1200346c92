"""AGG: aggregations over log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import body
from ..functions.text import mask_message
from .predicates import env_matches, filter_logs, is_error, is_request
from .search import clamp, search_requests

FACETS = ("level", "service", "env", "version", "kind", "event_type", "error_class", "source_file", "method", "handler", "host", "user_id", "tenant_id")
ALIASES = {"environment": "env", "exception_class": "error_class", "commit": "version", "commit_hash": "version"}


def one(c) -> F.Column:
    return F.sum(F.when(c, 1).otherwise(0))


def count_by_level(logs: DataFrame, **params) -> DataFrame:
    """AGG-1."""
    return filter_logs(logs, **params).groupBy("level").agg(F.count("*").alias("n"))


def error_rate(logs: DataFrame, **params) -> DataFrame:
    """AGG-2: total, errors, percent; one row, zeros when nothing is there."""
    a = filter_logs(logs, **params).agg(F.count("*").alias("total"), F.coalesce(one(is_error()), F.lit(0)).alias("errors"))
    return a.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("errors") * 100.0 / F.col("total"), 4)).otherwise(0.0))


def count_by_service(logs: DataFrame, **params) -> DataFrame:
    """AGG-3: total and errors per service."""
    return filter_logs(logs, **params).groupBy("service").agg(F.count("*").alias("total"), one(is_error()).alias("errors"))


def histogram(logs: DataFrame, start: str, end: str, interval_s: int, by: str = "ts", **params) -> DataFrame:
    """AGG-4: zero-filled counts in buckets anchored at `start`; at most 10,000 buckets."""
    spark = logs.sparkSession
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    width = F.greatest(F.lit(max(1, interval_s)), F.ceil(F.timestamp_diff("SECOND", s, e) / 10000).cast("int"))
    frame = spark.range(1).select(s.alias("s"), width.alias("w"), F.floor(F.timestamp_diff("SECOND", s, e) / width).alias("n"))
    buckets = frame.select("s", "w", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"))
    rows = filter_logs(logs, **params).filter((F.col(by) >= s) & (F.col(by) < e))
    counted = rows.groupBy(F.floor(F.timestamp_diff("SECOND", s, F.col(by)) / width).alias("i")).agg(F.count("*").alias("n"))
    return F.broadcast(buckets).join(counted, "i", "left").select(F.timestamp_seconds(F.unix_timestamp("s") + F.col("i") * F.col("w")).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def rollup_minute(logs: DataFrame) -> DataFrame:
    """AGG-5: counts per minute, service, environment and level, with id and time ranges."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    return logs.groupBy(minute, "service", "env", "level").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def count_by_service_from_rollup(rollup: DataFrame) -> DataFrame:
    """AGG-3 from the minute table, for whole minutes."""
    return rollup.groupBy("service").agg(F.sum("n").alias("total"), F.sum(F.when(is_error(), F.col("n")).otherwise(0)).alias("errors"))


def distinct_values(logs: DataFrame, column: str, **params) -> DataFrame:
    """AGG-6: sorted non-empty values of one of the facet columns."""
    if column not in FACETS:
        raise ValueError(f"{column!r} is no facet")
    rows = filter_logs(logs, **params).select(F.col(column).alias("value"))
    return rows.filter(F.coalesce("value", F.lit("")) != "").distinct().orderBy("value")


def attribute_values(logs: DataFrame, field: str, limit=100, **params) -> DataFrame:
    """AGG-7: a facet by its public name."""
    return distinct_values(logs, ALIASES.get(field, field), **params).limit(clamp(limit, 100, 100))


def metadata_keys(logs: DataFrame, **params) -> DataFrame:
    """AGG-8: distinct keys of body.metadata with how many rows have them."""
    keys = body.keys(body.is_variant(logs), "$.metadata")
    return filter_logs(logs, **params).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def aggregate_requests(logs: DataFrame, **params) -> DataFrame:
    """AGG-9: request rows with a duration, in one row."""
    rows = filter_logs(logs, **params).filter(is_request() & (F.col("duration_ms") > 0))
    reads = F.sum(F.coalesce("cache_hits", F.lit(0)) + F.coalesce("cache_misses", F.lit(0)))
    a = rows.agg(F.count("*").alias("requests"), F.sum("duration_ms").alias("d"), F.sum("db_count").alias("q"), F.coalesce(reads, F.lit(0)).alias("cache_reads"), F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("cache_hits"))
    rate = lambda x, y, times=1: F.when(F.col(y) > 0, F.round(F.col(x) * float(times) / F.col(y), 4)).otherwise(0.0)
    return a.select("requests", rate("d", "requests").alias("avg_duration_ms"), rate("q", "requests").alias("avg_db_count"), "cache_reads", "cache_hits", rate("cache_hits", "cache_reads", 100).alias("hit_rate"))


def performance_rows(logs: DataFrame, sort_by="duration", limit=20, **params) -> DataFrame:
    """AGG-10: the rows of a performance search."""
    return search_requests(logs, sort_by, limit, **params)


def performance_report(logs: DataFrame, sort_by="duration", limit=20, **params) -> DataFrame:
    """AGG-10: totals and hints over the rows of a performance search."""
    top = performance_rows(logs, sort_by, limit, **params)
    a = top.agg(F.count("*").alias("requests"), one(F.col("n_plus_one")).alias("n_plus_one"), F.sum("db_count").alias("q"), F.sum("duration_ms").alias("d"))
    avg = lambda c: F.round(F.col(c) / F.col("requests"), 4)
    return a.select("requests", "n_plus_one", avg("q").alias("avg_sql"), avg("d").alias("avg_duration_ms"), (avg("q") > 20).alias("hint_sql"), (avg("d") > 1000).alias("hint_slow"))


def level_trend(logs: DataFrame, bucket="5 minutes", limit=500, **params) -> DataFrame:
    """AGG-11: level counts per bucket, and whether the bucket is over 1.4 times the mean."""
    rows = filter_logs(logs, **params)
    counted = rows.groupBy(F.window("ts", bucket)["start"].alias("bucket")).agg(F.count("*").alias("n"), *[one(F.col("level") == v).alias(v) for v in ("debug", "info", "warn", "error", "fatal")])
    counted = counted.orderBy(F.desc("bucket")).limit(limit)
    whole = Window.partitionBy(F.lit(1))
    return counted.withColumn("warning", F.col("n") > 1.4 * F.sum("n").over(whole) / F.count("*").over(whole))


def service_error_rates(logs: DataFrame, limit=50, **params) -> DataFrame:
    """AGG-12: error percent per service, flagged over 1.25 times the overall one."""
    s = count_by_service(logs, **params)
    whole = Window.partitionBy(F.lit(1))
    overall = F.sum("errors").over(whole) * 100.0 / F.sum("total").over(whole)
    rate = F.col("errors") * 100.0 / F.col("total")
    s = s.withColumn("percent", F.round(rate, 4)).withColumn("high", rate > 1.25 * overall)
    return s.orderBy(F.desc("total"), "service").limit(limit)


def error_patterns(logs: DataFrame, limit=20, c="message", **params) -> DataFrame:
    """AGG-13: masked messages of error rows with count, share, first, last, a sample and services."""
    rows = filter_logs(logs, **params).filter(is_error())
    g = rows.groupBy(mask_message(F.col(c)).alias("pattern")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by(c, "id").alias("sample"), F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services")
    )
    total = rows.agg(F.count("*").alias("total"))
    g = g.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") * 100.0 / F.col("total"), 4)).withColumn("dominant", F.col("n") * 2 > F.col("total")).drop("total")
    return g.orderBy(F.desc("n"), "pattern").limit(limit)


def active_commits(logs: DataFrame, limit=10, **params) -> DataFrame:
    """AGG-14: rows and errors per version, newest first sighting first."""
    rows = filter_logs(logs, **params).filter(F.coalesce("version", F.lit("")) != "")
    return rows.groupBy("version").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"), one(is_error()).alias("errors")).orderBy(F.desc("first_seen"), "version").limit(limit)


def unique_errors(logs: DataFrame, limit=10, **params) -> DataFrame:
    """AGG-15: by fingerprint, else class, else the first 80 characters of the message."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(given("error_fingerprint"), given("error_class"), F.substring("message", 1, 80))
    return filter_logs(logs, **params).filter(is_error()).groupBy(key.alias("error_key")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen")).orderBy(F.desc("n"), "error_key").limit(limit)


def slowest_endpoints(logs: DataFrame, service=None, limit=5, **params) -> DataFrame:
    """AGG-16."""
    return search_requests(logs, "duration", limit, service=service, **params).select("id", "service", "method", "path", "handler", "duration_ms")


def logs_summary(logs: DataFrame, groups: DataFrame, **params) -> DataFrame:
    """AGG-17: (section, key, n) of levels, commits, errors, slow requests and open groups."""
    tag = lambda s, df, k, n: df.select(F.lit(s).alias("section"), F.col(k).cast("string").alias("key"), F.col(n).cast("long").alias("n"))
    rate = error_rate(logs, **params)
    parts = [
        tag("level", count_by_level(logs, **params), "level", "n"),
        tag("total", rate.withColumn("k", F.lit("logs")), "k", "total"),
        tag("total", rate.withColumn("k", F.lit("errors")), "k", "errors"),
        tag("commit", active_commits(logs, **params), "version", "n"),
        tag("error", unique_errors(logs, **params), "error_key", "n"),
        tag("slow", slowest_endpoints(logs, **params), "id", "duration_ms"),
        tag("open_groups", groups.filter("status = 'unresolved'").agg(F.count("*").alias("n")).withColumn("k", F.lit("groups")), "k", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change(now, before) -> tuple[F.Column, F.Column]:
    """Percent change and its direction; from nothing, the count counts as growth from one."""
    p = F.round((now - before) * 100.0 / before, 2)
    percent = F.when((before == 0) & (now == 0), 0.0).when(before == 0, now * 100.0).otherwise(p)
    way = F.when((before == 0) & (now > 0), "new").when(percent > 0, "increase").when(percent < 0, "decrease").otherwise("unchanged")
    return percent, way


def compare(logs: DataFrame, key: str, current: tuple, baseline: tuple, errors_only: bool) -> DataFrame:
    """Counts per key in two periods in one pass over both."""
    inside = lambda p: (F.col("ts") >= F.lit(p[0]).cast("timestamp")) & (F.col("ts") < F.lit(p[1]).cast("timestamp"))
    rows = logs.filter(inside(current) | inside(baseline))
    if errors_only:
        rows = rows.filter(is_error())
    a = rows.groupBy(key).agg(one(inside(current)).alias("current"), one(inside(baseline)).alias("baseline"))
    percent, way = change(F.col("current"), F.col("baseline"))
    return a.withColumn("percent", percent).withColumn("change", way)


def compare_errors(logs: DataFrame, current: tuple, baseline: tuple, limit=5) -> DataFrame:
    """AGG-18: the services whose errors moved most between two periods."""
    return compare(logs, "service", current, baseline, True).orderBy(F.desc(F.abs("percent")), "service").limit(limit)


def compare_volume(logs: DataFrame, current: tuple, baseline: tuple) -> DataFrame:
    """AGG-19: rows per level in two periods."""
    return compare(logs, "level", current, baseline, False)


def changes(logs: DataFrame, groups: DataFrame, since: str, as_of: str) -> DataFrame:
    """AGG-20: new groups, and errors since against the equal window before."""
    s, e = F.lit(since).cast("timestamp"), F.lit(as_of).cast("timestamp")
    length = e - s
    rows = logs.filter(is_error() & (F.col("ts") >= s - length) & (F.col("ts") <= e))
    a = rows.agg(F.coalesce(one(F.col("ts") >= s), F.lit(0)).alias("errors"), F.coalesce(one(F.col("ts") < s), F.lit(0)).alias("errors_before"))
    new = groups.filter((F.col("first_seen") >= s) & (F.col("first_seen") <= e)).agg(F.count("*").alias("new_groups"))
    p = F.when(F.col("errors_before") > 0, F.round((F.col("errors") - F.col("errors_before")) * 100.0 / F.col("errors_before"), 2)).when(F.col("errors") > 0, 100.0).otherwise(0.0)
    return a.crossJoin(new).withColumn("percent", p)


def measures(end) -> list[F.Column]:
    """AGG-21: every metric a rule may name, as aggregates of a window that ends at `end`."""
    timed = is_request() & (F.col("duration_ms") > 0)
    d = F.when(timed, F.col("duration_ms"))
    hits, reads = F.sum(F.when(timed, F.col("cache_hits"))), F.sum(F.when(timed, F.col("cache_hits") + F.col("cache_misses")))
    errors, n = one(is_error()), F.count("*")
    return [
        n.alias("log_count"),
        errors.alias("error_count"),
        F.round(errors / n, 6).alias("error_rate"),
        F.round(F.sum(d) / F.count(d), 4).alias("response_time"),
        F.expr("percentile_disc(0.95) within group (order by case when kind = 'request' and duration_ms > 0 then duration_ms end)").cast("long").alias("p95_response"),
        F.timestamp_diff("SECOND", F.max("ts"), end).alias("heartbeat"),
        F.coalesce(F.sum(F.when(timed, F.col("db_count"))), F.lit(0)).alias("sql_count"),
        F.when(reads > 0, F.round(hits / reads, 6)).otherwise(0.0).alias("cache_hit_rate"),
    ]


def measure(logs: DataFrame, start: str, end: str, endpoint=None, env=None, keys=("service", "env")) -> DataFrame:
    """AGG-21: one row of metrics per key, in one aggregate."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = logs.filter((F.col("ts") >= s) & (F.col("ts") < e) & env_matches(env))
    if endpoint:
        rows = rows.filter((F.col("path") == endpoint) | (F.col("handler") == endpoint))
    return rows.groupBy(*keys).agg(*measures(e))
