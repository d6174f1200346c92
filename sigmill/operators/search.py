"""SRT: search, top-k and pages. Every order ends in id, so every page is one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .predicates import filter_logs, is_error, is_request

SORTS = {"duration": "duration_ms", "sql_count": "db_count", "db_time": "db_ms", "duplicates": "dup_queries"}


def clamp(limit, default: int, most: int) -> int:
    return default if not limit or limit <= 0 else min(limit, most)


def search_logs(logs: DataFrame, as_of, start=None, end=None, limit=50, offset=0, ascending=False, **params) -> DataFrame:
    """SRT-1: one page, newest first; without a start the hour before `as_of`."""
    if start is None:
        start = F.lit(as_of).cast("timestamp") - F.expr("interval 1 hour")
    found = filter_logs(logs, start=start, end=end, **params)
    order = [F.asc("ts"), F.asc("id")] if ascending else [F.desc("ts"), F.desc("id")]
    return found.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, 50, 500))


def search_requests(logs: DataFrame, sort_by="duration", limit=20, offset=0, **params) -> DataFrame:
    """SRT-2: the slowest (or busiest) request rows of the whole window."""
    found = filter_logs(logs, **params).filter(is_request() & (F.col("duration_ms") > 0))
    return found.orderBy(F.desc_nulls_last(SORTS[sort_by]), F.asc("id")).offset(offset).limit(clamp(limit, 20, 100))


def get_log(logs: DataFrame, log_id: int) -> DataFrame:
    """SRT-3."""
    return logs.filter(F.col("id") == log_id)


def log_context(logs: DataFrame, anchors: DataFrame, before=10, after=10, same_service=False, hours=24) -> DataFrame:
    """SRT-4: rows around each anchor (id) in its environment, `side` before/anchor/after, `n` away.

    Rows are numbered by time in each environment, minute by minute: a rank in
    the minute and the rows of all minutes before it. An anchor then asks for
    the numbers around its own, so it meets no more rows than it shows. Only
    days within reach of an anchor are numbered.
    """
    keys = ["env", "service"] if same_service else ["env"]
    day = F.unix_date(F.to_date("ts"))
    chosen = logs.join(anchors.select(F.col("id").alias("anchor")).distinct(), F.col("id") == F.col("anchor"))
    reach = -(-hours // 24)
    days = chosen.select(*keys, F.explode(F.sequence(day - reach, day + reach)).alias("__day")).distinct()
    near = logs.withColumns({"__day": day, "__minute": F.floor(F.unix_timestamp("ts") / 60)}).join(days, [*keys, "__day"], "left_semi").drop("__day")
    sizes = near.groupBy(*keys, "__minute").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__minute")) - F.col("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__minute").orderBy("ts", "id"))
    ranked = near.withColumn("__inside", inside).join(sizes.select(*keys, "__minute", earlier.alias("__earlier")), [*keys, "__minute"])
    ranked = ranked.withColumn("__rank", F.col("__earlier") + F.col("__inside")).drop("__minute", "__inside", "__earlier")
    steps = F.explode(F.sequence(F.lit(-max(0, min(before, 50))), F.lit(max(0, min(after, 50))))).alias("__step")
    wanted = ranked.join(anchors.select(F.col("id").alias("anchor")).distinct(), F.col("id") == F.col("anchor")).select(*keys, "anchor", F.col("ts").alias("__at"), F.col("__rank").alias("__own"), steps)
    wanted = wanted.withColumn("__rank", F.col("__own") + F.col("__step")).drop("__own")
    found = ranked.join(wanted, [*keys, "__rank"]).filter(F.abs(F.timestamp_diff("SECOND", F.col("__at"), F.col("ts"))) <= hours * 3600)
    side = F.when(F.col("__step") == 0, "anchor").when(F.col("__step") < 0, "before").otherwise("after")
    return found.select(*logs.columns, "anchor", side.alias("side"), F.abs("__step").alias("n"))


def tail_logs(logs: DataFrame, after_id=None, limit=50) -> DataFrame:
    """SRT-5: the next rows after a cursor; without one the newest, oldest first."""
    n = clamp(limit, 50, 200)
    if after_id is not None:
        return logs.filter(F.col("id") > after_id).orderBy("id").limit(n)
    return logs.orderBy(F.desc("id")).limit(n).orderBy("id")


def enrich_with_groups(logs: DataFrame, groups: DataFrame) -> DataFrame:
    """SRT-6: group status, counts and (where groups have them) reopenings beside rows, by fingerprint and environment."""
    reopened = [F.col("reopened").alias("group_reopened")] if "reopened" in groups.columns else []
    g = groups.select(*reopened, F.col("fingerprint").alias("error_fingerprint"), "env", F.col("status").alias("group_status"), F.col("occurrences").alias("group_occurrences"), F.col("last_seen").alias("group_last_seen"))
    return logs.join(g, ["error_fingerprint", "env"], "left")


def search_with_service_fallback(logs: DataFrame, query: str, **params) -> DataFrame:
    """SRT-7: an empty full-text result is retried with the query as a service name."""
    found = filter_logs(logs, query=query, **params)
    if params.get("service") or not found.limit(1).isEmpty():
        return found
    return filter_logs(logs, service=query, **params)


def time_distribution(rows: DataFrame) -> DataFrame:
    """SRT-8: counts in buckets whose width follows the span of the rows."""
    span = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("s", F.timestamp_diff("SECOND", F.col("first"), F.col("last")))
    width = F.when(F.col("s") <= 300, 30).when(F.col("s") <= 1800, 60).when(F.col("s") <= 7200, 300).when(F.col("s") <= 43200, 1800).otherwise(3600)
    sized = rows.crossJoin(F.broadcast(span.select(width.alias("width"))))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("width")) * F.col("width"))
    return sized.groupBy(start.alias("bucket"), "width").agg(F.count("*").alias("n"))


def result_summary(rows: DataFrame) -> DataFrame:
    """SRT-9: counts by level and by service of a result."""
    by = lambda c: rows.groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return by("level").union(by("service"))

