"""TRC: what the rows of a trace say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .predicates import is_error


def in_order():
    return Window.partitionBy("trace_id").orderBy("ts", "id")


def ms_between(a, b):
    return F.unix_millis(b) - F.unix_millis(a)


def of_traces(logs: DataFrame) -> DataFrame:
    return logs.filter(F.coalesce("trace_id", F.lit("")) != "")


def trace_timeline(logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    """TRC-1: rows of one trace (or all) oldest first, elapsed ms from the first, and the whole trace's span.

    What holds for a whole trace is aggregated once and joined to its rows.
    """
    rows = of_traces(logs) if trace_id is None else logs.filter(F.col("trace_id") == trace_id)
    whole = rows.groupBy("trace_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(is_error()).alias("has_errors"), F.size(F.collect_set("service")).cast("long").alias("n_services"))
    return rows.select("trace_id", "id", "service", "level", "ts").join(whole, "trace_id").select("trace_id", "id", "service", "level", ms_between("first", "ts").alias("elapsed_ms"), ms_between("first", "last").alias("total_ms"), "has_errors", "n_services")


def trace_service_summary(logs: DataFrame) -> DataFrame:
    """TRC-2: per trace and service: rows, errors, ms from first to last."""
    return of_traces(logs).groupBy("trace_id", "service").agg(F.count("*").alias("entries"), F.sum(F.when(is_error(), 1).otherwise(0)).alias("errors"), ms_between(F.min("ts"), F.max("ts")).alias("duration_ms"))


def trace_gaps(logs: DataFrame, least_ms: int = 500) -> DataFrame:
    """TRC-3: neighbouring rows further apart than `least_ms` that change service."""
    rows = of_traces(logs).select("trace_id", "id", "ts", "service", F.lag("ts").over(in_order()).alias("before"), F.lag("service").over(in_order()).alias("from_service"), F.lag("id").over(in_order()).alias("from_id"))
    gap = ms_between(F.col("before"), F.col("ts"))
    return rows.filter((gap > least_ms) & (F.col("service") != F.col("from_service"))).select("trace_id", "from_id", "id", "from_service", "service", gap.alias("gap_ms"))


def trace_first_error(logs: DataFrame) -> DataFrame:
    """TRC-4: the earliest error row of each trace."""
    first = F.min_by(F.struct("id", "service", "message"), F.struct("ts", "id"))
    return of_traces(logs).filter(is_error()).groupBy("trace_id").agg(first.alias("e")).select("trace_id", "e.*")


def trace_context(logs: DataFrame, traces: DataFrame, margin_s: int = 2, limit: int = 50) -> DataFrame:
    """TRC-5: other rows of the touched services within the margin of each service's part of a trace.

    A part is at most as long as its trace; minutes are the equi-join key of the
    range join, so rows meet only parts that are near.
    """
    spans = of_traces(logs).join(traces.select("trace_id").distinct(), "trace_id").groupBy("trace_id", "service").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    lo, hi = F.unix_seconds("a") - margin_s, F.unix_seconds("b") + margin_s + 1
    spans = spans.withColumn("minute", F.explode(F.sequence(F.floor(lo / 60), F.floor(hi / 60)))).withColumnRenamed("trace_id", "of_trace")
    rows = logs.withColumn("minute", F.floor(F.unix_seconds("ts") / 60))
    near = rows.join(spans, ["service", "minute"]).filter((F.coalesce("trace_id", F.lit("")) != F.col("of_trace")) & (F.unix_millis("ts") >= F.unix_millis("a") - 1000 * margin_s) & (F.unix_millis("ts") <= F.unix_millis("b") + 1000 * margin_s))
    w = Window.partitionBy("of_trace", "service").orderBy("ts", "id")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("of_trace", "service", "id", "n")


def trace_status(logs: DataFrame) -> DataFrame:
    """TRC-6: spans, root span, services, first and last time, duration and errors of each trace."""
    root = F.min(F.when((F.coalesce("span_id", F.lit("")) != "") & (F.coalesce("parent_span_id", F.lit("")) == ""), F.struct("ts", "id", "span_id")))
    return of_traces(logs).groupBy("trace_id").agg(
        F.count("*").alias("spans"),
        root["span_id"].alias("root_span"),
        F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_updated"),
        ms_between(F.min("ts"), F.max("ts")).alias("duration_ms"),
        F.bool_or(is_error()).alias("has_errors"),
        F.lit("partial").alias("status"),
    )


def mark_stale_traces(status: DataFrame, as_of: str, seconds: int = 30) -> DataFrame:
    """TRC-7: partial traces without an update for the threshold time out."""
    stale = (F.col("status") == "partial") & (F.col("last_updated") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))
    return status.withColumn("status", F.when(stale, "timeout").otherwise(F.col("status")))


def recent_traces(status: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """TRC-8: last updated first, with how many there are."""
    total = status.agg(F.count("*").alias("total"))
    return status.orderBy(F.desc("last_updated"), "trace_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))
