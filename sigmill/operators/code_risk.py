"""COD: source files that errors point at, and how risky they look."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import is_error

# Frame styles, folders and endings that decide what is a source file.
FRAMES = (r"([^\s:]+\.\w+):\d+", r"([^\s]+\.go):\d+", r"\(([^)]+\.[jt]sx?):\d+:\d+\)", r'File "([^"]+\.py)", line \d+')
#: What a text must hold for a style to be looked for.
MARKS = (":", ".go:", "(", 'File "')
SKIPPED = ("/vendor/", "/node_modules/", "/gems/", "/site-packages/")
ENDINGS = (".rb", ".go", ".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".rs", ".ex", ".exs", ".php")


def extract_files(backtrace: Column) -> Column:
    """COD-1: distinct source files of a back-trace in any of four styles."""
    found = F.flatten(F.array(*[F.coalesce(F.when(F.contains(backtrace, F.lit(m)), F.regexp_extract_all(backtrace, F.lit(p), F.lit(1))), F.array().cast("array<string>")) for p, m in zip(FRAMES, MARKS, strict=True)]))
    own = lambda p: ~reduce(lambda a, b: a | b, [F.contains(p, F.lit(s)) for s in SKIPPED]) & reduce(lambda a, b: a | b, [F.endswith(p, F.lit(e)) for e in ENDINGS])
    return F.array_distinct(F.filter(found, own))


def trace_files(traces: DataFrame, *keys: str, trace: str = "trace") -> DataFrame:
    """COD-1 for a table: each distinct (keys, back-trace) with its files and its rows `n`. Back-traces recur, so equal ones are taken apart once."""
    once = traces.groupBy(*keys, trace).agg(F.count("*").alias("n"))
    # The files ask for n, or Spark would drop this grouping where a distinct of the files follows.
    return once.select(*keys, extract_files(F.when(F.col("n") > 0, F.col(trace))).alias("files"), "n")


def backtrace_text(body: Column) -> Column:
    """The frames of body.backtrace or body.stack_trace, whichever is there, one a line."""
    frames = F.from_json(F.get_json_object(body, "$.backtrace"), "array<string>")
    return F.coalesce(F.array_join(frames, "\n"), F.get_json_object(body, "$.stack_trace"), F.lit(""))


def code_entities(logs: DataFrame) -> DataFrame:
    """COD-2: errors and last error per (file, service); a row counts a file once."""
    own = F.when(F.coalesce("source_file", F.lit("")) != "", F.array("source_file")).otherwise(F.array().cast("array<string>"))
    # Rows of one file and back-trace are folded first, so that each is taken apart once.
    rows = logs.filter(is_error()).groupBy("service", own.alias("own"), backtrace_text(F.col("body")).alias("trace")).agg(F.count("*").alias("errors"), F.max("ts").alias("last_error"))
    files = F.array_union("own", extract_files(F.col("trace")))
    rows = rows.select("service", "errors", "last_error", F.explode(files).alias("file"))
    return rows.groupBy("file", "service").agg(F.sum("errors").alias("errors"), F.max("last_error").alias("last_error"))


def investigation_counts(investigations: DataFrame) -> DataFrame:
    """COD-3: (file, service, at) rows counted per file and service."""
    return investigations.groupBy("file", "service").agg(F.count("*").alias("investigations"), F.max("at").alias("last_investigated"))


def risk_scores(entities: DataFrame, as_of: str) -> DataFrame:
    """COD-4: a score from 0 to 1 of errors, investigations and how recent both are."""
    now = F.lit(as_of).cast("timestamp")
    days = lambda c: F.timestamp_diff("SECOND", F.col(c), now) / 86400.0
    d = days("last_error")
    recency = F.when(d < 1, 1.0).when(d < 7, 1 - d / 7).otherwise(0.0)
    looked = F.when(days("last_investigated") < 7, 1.0).otherwise(0.0)
    n = lambda c, most: F.least(F.coalesce(F.col(c), F.lit(0)) / float(most), F.lit(1.0))
    return entities.withColumn("risk", F.round(0.4 * n("errors", 10) + 0.3 * n("investigations", 5) + 0.2 * F.coalesce(recency, F.lit(0.0)) + 0.1 * looked, 4))


def file_risk(scored: DataFrame, files: DataFrame) -> DataFrame:
    """COD-5: the highest risk of each requested file and its word; unknown files have none."""
    worst = scored.groupBy("file").agg(F.max("risk").alias("risk"), F.sum("errors").alias("errors"))
    out = files.select("file").distinct().join(worst, "file", "left").fillna({"risk": 0.0, "errors": 0})
    return out.withColumn("level", F.when(F.col("risk") < 0.3, "low").when(F.col("risk") < 0.7, "medium").otherwise("high"))


def fragile(scored: DataFrame, limit: int = 10) -> DataFrame:
    """COD-6: the riskiest entities."""
    return scored.orderBy(F.desc("risk"), F.desc("errors"), "file", "service").limit(min(limit, 50))
