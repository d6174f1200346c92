"""The telemetry tables of the supplied data, in Spark and as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text

AS_OF = "2024-01-31 00:00:00"


class Book:
    """Collects queries and their SQL twins; the twin sees `logs` and what else it names."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name, sql=None, views=("logs",)):
        def put(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = "WITH " + ", ".join(VIEWS[v] for v in views) + " " + sql if views else sql
            return f

        return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark, name: str) -> str:
    """A fresh folder that all executors share, under spark.checkpoint.dir; nothing else is sure to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df):
    """What several branches of a query read, made once: fewer scans, and a lost executor costs a reread."""
    where = folder(df.sparkSession, "shared")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def logs(spark, sf_dir):
    """Log rows made of events: one row an event, the columns of the log schema."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").cast("long").alias("dur")
    )
    k, kind = F.col("k"), F.col("event_type")
    error, request = kind == "error", kind.isin("view", "click", "purchase")
    db = F.when(request, k % 25)
    e = e.select(
        "id",
        "ts",
        (F.col("ts") + F.make_dt_interval(secs=F.col("id") % 7)).alias("received_at"),
        F.when(error, F.when(F.col("id") % 5 == 0, "fatal").otherwise("error")).when(kind == "signup", "warn").otherwise("info").alias("level"),
        F.element_at(F.array(*map(F.lit, ("api", "web", "worker", "billing"))), (F.col("user_id") % 4 + 1).cast("int")).alias("service"),
        F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 10 <= 2, "staging").otherwise("production").alias("env"),
        F.when(error, "log").when(kind == "signup", "event").otherwise("request").alias("kind"),
        "event_type",
        F.concat(F.lit("user-"), "user_id").alias("user_id"),
        F.concat(F.lit("tenant-"), F.col("user_id") % 10).alias("tenant_id"),
        F.concat(F.lit("trace-"), F.floor(F.col("id") / 5)).alias("trace_id"),
        F.concat(F.lit("span-"), "id").alias("span_id"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("span-"), F.col("id") - F.col("id") % 5)).alias("parent_span_id"),
        F.when(kind == "purchase", "POST").when(request, "GET").alias("method"),
        F.when(request, F.concat(F.lit("/"), kind, F.lit("/"), k % 20)).alias("path"),
        F.concat(F.lit("OrdersController#"), kind).alias("handler"),
        F.when(request, F.when(k % 20 == 0, 500).when(k % 10 == 1, 404).otherwise(200)).alias("status"),
        F.when(request, F.col("dur")).alias("duration_ms"),
        db.alias("db_count"),
        (2 * db).alias("db_ms"),
        F.when(request, k % 7).alias("cache_hits"),
        F.when(request, k % 3).alias("cache_misses"),
        F.when(request, k % 6).alias("dup_queries"),
        (db > 20).alias("n_plus_one"),
        F.when(error, F.element_at(F.array(*map(F.lit, ("NoMethodError", "TimeoutError", "KeyError", "ValueError", ""))), (k % 5 + 1).cast("int"))).alias("error_class"),
        F.when(error & (k % 3 > 0), F.concat(F.lit("app/f"), k % 12, F.lit(".rb"))).alias("source_file"),
        F.concat(kind, F.lit(" "), "id", F.lit(" took "), "dur", F.lit(" ms from 10.0."), k % 9, F.lit(".7")).alias("message"),
        F.concat(F.lit('{"metadata":{"k":'), k, F.lit('},"sql":[{"table":"t'), k % 4, F.lit('","duration_ms":'), "dur", F.lit("}]}")).alias("body"),
    )
    version = F.substring(F.md5(F.concat("service", F.lit("|"), F.floor((F.dayofmonth("ts") - 1) / 5))), 1, 7)
    made = text.fingerprint(F.col("service"), F.col("error_class"), F.col("source_file"), F.col("message"))
    return e.withColumns({"version": version, "error_fingerprint": F.when(F.col("level").isin("error", "fatal"), made).otherwise("")})


VIEWS = {
    "logs": f"""ev0 AS (
  SELECT event_id AS id, ts, user_id AS uid, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value) AS BIGINT) AS dur, event_type IN ('view','click','purchase') AS req, event_type = 'error' AS err FROM events),
l0 AS (SELECT id, ts, ts + to_seconds(id % 7) AS received_at,
  CASE WHEN err THEN CASE WHEN id % 5 = 0 THEN 'fatal' ELSE 'error' END WHEN event_type = 'signup' THEN 'warn' ELSE 'info' END AS level,
  ['api','web','worker','billing'][uid % 4 + 1] AS service,
  CASE WHEN id % 10 = 0 THEN '' WHEN id % 10 <= 2 THEN 'staging' ELSE 'production' END AS env,
  CASE WHEN err THEN 'log' WHEN event_type = 'signup' THEN 'event' ELSE 'request' END AS kind, event_type,
  'user-' || uid AS user_id, 'tenant-' || (uid % 10) AS tenant_id, 'trace-' || (id // 5) AS trace_id, 'span-' || id AS span_id,
  CASE WHEN id % 5 <> 0 THEN 'span-' || (id - id % 5) END AS parent_span_id,
  CASE WHEN event_type = 'purchase' THEN 'POST' WHEN req THEN 'GET' END AS method,
  CASE WHEN req THEN '/' || event_type || '/' || (k % 20) END AS path, 'OrdersController#' || event_type AS handler,
  CASE WHEN req THEN CASE WHEN k % 20 = 0 THEN 500 WHEN k % 10 = 1 THEN 404 ELSE 200 END END AS status,
  CASE WHEN req THEN dur END AS duration_ms, CASE WHEN req THEN k % 25 END AS db_count, CASE WHEN req THEN 2 * (k % 25) END AS db_ms,
  CASE WHEN req THEN k % 7 END AS cache_hits, CASE WHEN req THEN k % 3 END AS cache_misses, CASE WHEN req THEN k % 6 END AS dup_queries,
  CASE WHEN req THEN k % 25 > 20 END AS n_plus_one,
  CASE WHEN err THEN ['NoMethodError','TimeoutError','KeyError','ValueError',''][k % 5 + 1] END AS error_class,
  CASE WHEN err AND k % 3 > 0 THEN 'app/f' || (k % 12) || '.rb' END AS source_file,
  event_type || ' ' || id || ' took ' || dur || ' ms from 10.0.' || (k % 9) || '.7' AS message,
  '{{"metadata":{{"k":' || k || '}},"sql":[{{"table":"t' || (k % 4) || '","duration_ms":' || dur || '}}]}}' AS body FROM ev0),
logs AS (SELECT *, left(md5(service || '|' || ((day(ts) - 1) // 5)), 7) AS version,
  CASE WHEN level IN ('error','fatal') THEN {text.sql_fingerprint("service", "error_class", "source_file", "message")} ELSE '' END AS error_fingerprint FROM l0)"""
}
