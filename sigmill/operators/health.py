"""HLT and SRV: recorded probes and server metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LATEST = ("checked_at", "response_ms", "status_code")


def classify_probe(results: DataFrame) -> DataFrame:
    """HLT-1: up, degraded or down from (status_code, expected_code, response_ms, timeout_ms, body_found)."""
    code, want = F.col("status_code"), F.coalesce("expected_code", F.lit(200))
    by_code = F.when(code == want, "up").when(code.between(200, 399), "degraded").otherwise("down")
    slow = F.col("response_ms") > F.col("timeout_ms") / 2
    status = F.when(by_code == "down", "down").when(~F.coalesce("body_found", F.lit(True)), "down").when((by_code == "up") & slow, "degraded").otherwise(by_code)
    return results.withColumn("status", status)


def in_time(desc: bool = False):
    cols = [F.desc(c) if desc else F.asc(c) for c in LATEST]
    return Window.partitionBy("check").orderBy(*cols)


def uptime(checks: DataFrame, results: DataFrame, since: str) -> DataFrame:
    """HLT-2: latest status over all time; counts, mean response and uptime since then."""
    s = F.col("checked_at") >= F.lit(since).cast("timestamp")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = results.groupBy("check").agg(
        F.max_by("status", F.struct(*LATEST)).alias("status"), n(s).alias("total"), n(s & (F.col("status") == "down")).alias("downs"), n(s & (F.col("status") == "up")).alias("ups"), F.sum(F.when(s, F.col("response_ms"))).alias("r")
    )
    out = checks.join(a, "check", "left").withColumn("status", F.coalesce("status", F.lit("unknown"))).fillna({"total": 0, "downs": 0, "ups": 0})
    per = lambda c, x: F.when(F.col("total") > 0, F.round(F.col(c) * x / F.col("total"), 4))
    return out.select("check", "status", "total", "downs", per("r", 1.0).alias("avg_response_ms"), per("ups", 100.0).alias("uptime"))


def transitions(results: DataFrame, start: str, end: str) -> DataFrame:
    """HLT-3: changes of status inside the window; the state before it is the seed.

    A task sees a day of a check at most: the last status of each day (and of
    all time before the window) is one row, and goes over to the next day.
    """
    begin = F.lit(start).cast("timestamp")
    rows = results.filter((F.col("checked_at") >= begin) & (F.col("checked_at") <= F.lit(end).cast("timestamp"))).withColumn("day", F.to_date("checked_at"))
    final = F.max(F.struct(*LATEST, "status"))["status"].alias("final")
    seed = results.filter(F.col("checked_at") < begin).groupBy("check").agg(final, F.lit("0001-01-01").cast("date").alias("day"))
    days = rows.groupBy("check", "day").agg(final).unionByName(seed)
    carried = days.select("check", "day", F.lag("final").over(Window.partitionBy("check").orderBy("day")).alias("carried"))
    of_day = F.lag("status").over(Window.partitionBy("check", "day").orderBy(*LATEST))
    rows = rows.withColumn("of_day", of_day).join(carried, ["check", "day"]).withColumn("before", F.coalesce("of_day", "carried"))
    return rows.filter(F.col("before") != F.col("status")).select("check", "checked_at", "before", "status")


def reliability(results: DataFrame, last: int = 5) -> DataFrame:
    """HLT-4: percent up among the last results of each check."""
    rows = results.withColumn("n", F.row_number().over(in_time(True))).filter(F.col("n") <= last)
    return rows.groupBy("check").agg(F.round(F.sum(F.when(F.col("status") == "up", 1).otherwise(0)) * 100.0 / F.count("*"), 4).alias("reliability"))


def consecutive_failures(results: DataFrame) -> DataFrame:
    """HLT-5: results after the last `up` of each check, by one aggregate and a join back."""
    up = results.groupBy("check").agg(F.max(F.when(F.col("status") == "up", F.struct(*LATEST))).alias("up"))
    after = results.join(up, "check").withColumn("fails", F.when(F.col("up").isNull() | (F.struct(*LATEST) > F.col("up")), 1).otherwise(0))
    return after.groupBy("check").agg(F.sum("fails").alias("failures"))


def latest_results(results: DataFrame, check: str, limit: int = 20) -> DataFrame:
    """HLT-6."""
    return results.filter(F.col("check") == check).orderBy(*[F.desc(c) for c in LATEST]).limit(limit)


def query_metrics(metrics: DataFrame, server: str, name=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """SRV-1: newest first."""
    m = metrics.filter(F.col("server") == server)
    if name:
        m = m.filter(F.col("name") == name)
    if start:
        m = m.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        m = m.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return m.orderBy(F.desc("ts"), "name", "value").limit(limit)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """SRV-2: the last samples of each metric of each server; ties stay."""
    last = metrics.groupBy("server", "name").agg(F.max("ts").alias("ts"))
    return metrics.join(last, ["server", "name", "ts"], "left_semi")


def register_servers(heartbeats: DataFrame) -> DataFrame:
    """SRV-3: one row a hostname; the latest heartbeat wins."""
    return heartbeats.groupBy("server").agg(F.min("ts").alias("registered_at"), F.max("ts").alias("last_seen"), F.max_by("name", F.struct("ts", "name")).alias("last_metric"), F.lit("online").alias("status"))


def mark_stale_offline(servers: DataFrame, as_of: str, days: int) -> DataFrame:
    """SRV-4: online servers that have been silent go offline."""
    silent = F.col("last_seen") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return servers.withColumn("status", F.when((F.col("status") == "online") & silent, "offline").otherwise(F.col("status")))
