"""DEP: deploys seen in logs, and what came after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import env_matches, is_error, same
from .search import clamp


def deploys(logs: DataFrame) -> DataFrame:
    """DEP-1: the first sighting of each (version, service, env)."""
    return logs.filter(F.coalesce("version", F.lit("")) != "").groupBy("version", "service", "env").agg(F.min("ts").alias("first_seen"))


def list_deploys(found: DataFrame, since=None, service=None, env=None, limit=50) -> DataFrame:
    """DEP-2: newest first."""
    if since:
        found = found.filter(F.col("first_seen") >= F.lit(since).cast("timestamp"))
    if service:
        found = found.filter(same("service", service))
    if env:
        found = found.filter(env_matches(env))
    return found.orderBy(F.desc("first_seen"), "version", "service", "env").limit(clamp(limit, 50, 500))


def latest_deploy(found: DataFrame, service=None, env=None) -> DataFrame:
    return list_deploys(found, None, service, env, 1)


def deploy_report(logs: DataFrame, found: DataFrame, after_hours: int = 1, before_hours: int = 24) -> DataFrame:
    """DEP-3: error rate and mean duration after each deploy against the time before it.

    The deploys are the small side. Rows and deploys meet by service,
    environment and day, a deploy once for each day its windows touch.
    """
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    d = found.select("version", F.col("service").alias("service"), "env", "first_seen")
    d = d.withColumn("day", F.explode(F.sequence(F.floor((F.unix_seconds("first_seen") - before_hours * 3600) / 86400), F.floor((F.unix_seconds("first_seen") + after_hours * 3600) / 86400))))
    rows = logs.select("service", "env", "ts", "level", "kind", "duration_ms", day("ts").alias("day")).join(d, ["service", "env", "day"])
    at = F.unix_millis("ts") - F.unix_millis("first_seen")
    after, before = (at >= 0) & (at < after_hours * 3_600_000), (at < 0) & (at >= -before_hours * 3_600_000)
    rows = rows.filter(after | before)

    def side(c, name):
        n, errors, d_ = F.sum(F.when(c, 1).otherwise(0)), F.sum(F.when(c & is_error(), 1).otherwise(0)), F.when(c & (F.col("duration_ms") > 0), F.col("duration_ms"))
        return [n.alias(f"logs_{name}"), F.when(n > 0, F.round(errors / n, 6)).alias(f"error_rate_{name}"), F.round(F.sum(d_) / F.count(d_), 4).alias(f"response_{name}")]

    g = rows.groupBy("version", "service", "env").agg(*side(after, "after"), *side(before, "before"))
    return g.withColumn("response_delta", F.when(F.col("response_before") > 0, F.round((F.col("response_after") - F.col("response_before")) * 100 / F.col("response_before"), 2)))
