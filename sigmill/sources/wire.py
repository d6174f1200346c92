"""SRC-1 to SRC-4: what arrives, and the log schema it becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_prefix

TEXTS = ("level", "service", "message", "env", "version", "host", "kind", "event_type", "trace_id", "span_id", "parent_span_id", "request_id", "user_id", "tenant_id", "session_id", "method", "path", "route", "handler", "error_class", "error_message", "source_file", "job_class", "job_queue", "job_id")
NUMBERS = ("status", "duration_ms", "db_ms", "db_count", "cache_ms", "cache_hits", "cache_misses", "ext_ms", "ext_count", "render_ms", "alloc_count", "mem_delta_mb", "slow_queries", "dup_queries", "queue_ms", "source_line")
FIELDS = {"ts": "string"} | {c: "string" for c in TEXTS} | {c: "number" for c in NUMBERS} | {"n_plus_one": "boolean", "body": "object"}
LIMITS = {"message": 16384, "error_message": 16384, "path": 2048, "route": 2048, "handler": 2048, "source_file": 2048, "service": 512, "env": 512, "version": 512, "host": 512, "trace_id": 512, "request_id": 512, "user_id": 512}
CUT_MARK = "…[truncated]"
#: Everything is read as text, so one odd value costs a field and not a row.
WIRE = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS] + [T.StructField("_corrupt_record", T.StringType())])


def number(c: str | Column) -> Column:
    """Whole numbers, floats (rounded) and numeric strings; anything else is null."""
    return F.round((F.col(c) if isinstance(c, str) else c).try_cast("double")).try_cast("long")


def truncated(c: str) -> Column:
    """The field within its limit of bytes, marked where it was cut."""
    limit = LIMITS.get(c, 512)
    return F.when(F.octet_length(c) > limit, F.concat(byte_prefix(F.col(c), limit - len(CUT_MARK.encode())), F.lit(CUT_MARK))).otherwise(F.col(c))


def read_flat_logs(spark: SparkSession, path: str, stream: bool = False, lines: bool = False) -> DataFrame:
    """SRC-1: JSON files of one object or an array each, or of one object a line; bad rows keep their text in _corrupt_record."""
    reader = (spark.readStream if stream else spark.read).schema(WIRE).option("multiLine", not lines).option("primitivesAsString", True)
    return typed(reader.json(path))


def parse_flat_logs(df: DataFrame, c: str = "payload") -> DataFrame:
    """SRC-1 for payloads in a column: an object or an array of objects."""
    many = F.when(F.startswith(F.ltrim(c), F.lit("[")), F.col(c)).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    rows = df.select(F.explode_outer(F.from_json(many, T.ArrayType(WIRE))).alias("r")).select("r.*")
    return typed(rows)


def typed(wire: DataFrame) -> DataFrame:
    """Wire text as the types of the log schema."""
    return wire.withColumns({c: number(c) for c in NUMBERS if c != "mem_delta_mb"} | {"mem_delta_mb": F.round(F.col("mem_delta_mb").try_cast("double"), 2).try_cast("decimal(18,2)"), "n_plus_one": F.col("n_plus_one").try_cast("boolean")})


def normalize_logs(df: DataFrame, as_of: str, default_env: str = "") -> DataFrame:
    """SRC-2: rows with a level and a message; lower-case levels, times, environment, lengths and kind settled."""
    from ..operators.ingest import infer_kind

    level = F.lower("level")
    level = F.when(level == "warning", "warn").otherwise(level)
    kept = df.filter(level.isin("debug", "info", "warn", "error", "fatal") & (F.coalesce("message", F.lit("")) != ""))
    kind = infer_kind(lambda k: F.col(k).cast("string"))
    own = {"level": level, "kind": kind, "ts": F.coalesce(F.try_to_timestamp("ts"), F.lit(as_of).cast("timestamp")), "env": F.coalesce(F.nullif(F.col("env"), F.lit("")), F.lit(default_env))}
    kept = kept.withColumns(own)
    return kept.withColumns({c: truncated(c) for c in TEXTS if c not in ("level", "kind")})


SUMMARY = "struct<controller:string,action:string,method:string,path:string,status:long,duration_ms:double,db_time_ms:double,sql_count:long,n_plus_one:boolean,duplicate_queries:long,view_time_ms:double,cache_hits:long,cache_reads:long,http_external_count:long,http_external_total_ms:double,memory_delta_mb:double>"


def from_legacy_payload(df: DataFrame) -> DataFrame:
    """SRC-3: rows with a nested `request_summary` struct as flat rows.

    The summary's own fields win; cache, view, external and memory figures only
    fill what is missing or zero.
    """
    s = lambda c: F.col(f"request_summary.{c}")
    wins = lambda flat, nested: F.coalesce(nested, F.col(flat))
    fills = lambda flat, nested: F.coalesce(F.nullif(F.col(flat), F.lit(0)), nested)
    handler = F.when(F.coalesce(s("action"), F.lit("")) != "", F.concat_ws("#", s("controller"), s("action"))).otherwise(s("controller"))
    whole = lambda c: F.round(c).cast("long")
    new = {
        "handler": F.coalesce(F.nullif(handler, F.lit("")), F.col("handler")),
        "method": wins("method", s("method")),
        "path": wins("path", s("path")),
        "status": wins("status", s("status")),
        "duration_ms": wins("duration_ms", whole(s("duration_ms"))),
        "db_ms": wins("db_ms", whole(s("db_time_ms"))),
        "db_count": wins("db_count", s("sql_count")),
        "n_plus_one": wins("n_plus_one", s("n_plus_one")),
        "dup_queries": wins("dup_queries", s("duplicate_queries")),
        "render_ms": fills("render_ms", whole(s("view_time_ms"))),
        "cache_hits": fills("cache_hits", s("cache_hits")),
        "cache_misses": fills("cache_misses", F.greatest(s("cache_reads") - s("cache_hits"), F.lit(0))),
        "ext_count": fills("ext_count", s("http_external_count")),
        "ext_ms": fills("ext_ms", whole(s("http_external_total_ms"))),
    }
    return df.withColumns({k: v for k, v in new.items() if k in df.columns}).drop("request_summary")


def request_summary(logs: DataFrame) -> DataFrame:
    """SRC-4: the request view of rows that took time."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return logs.filter(F.col("duration_ms") > 0).select(
        F.col("id").alias("log_id"), F.col("handler").alias("controller"), "method", "path", "status", "duration_ms", F.col("db_ms").alias("db_time_ms"), F.col("db_count").alias("sql_count"),
        F.coalesce("n_plus_one", F.lit(False)).alias("n_plus_one"), F.col("dup_queries").alias("duplicate_queries"), "cache_hits", (zero("cache_hits") + zero("cache_misses")).alias("cache_reads"),
    )
