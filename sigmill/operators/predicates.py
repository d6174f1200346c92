"""FLT: predicates and projections over log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import body
from ..functions.text import tokens

NAMES = ("service", "level", "event_type", "error_class", "source_file", "version", "method")
IDENTIFIERS = ("trace_id", "request_id", "user_id", "tenant_id", "error_fingerprint")
ERRORS = ("error", "fatal")


def is_error(level="level") -> Column:
    return F.col(level).isin(*ERRORS)


def same(c, value: str) -> Column:
    return F.lower(c) == value.lower()


def env_matches(env: str | None, c="env") -> Column:
    """FLT-2: no filter matches all; a row without environment matches any filter."""
    if not env:
        return F.lit(True)
    return (F.coalesce(F.col(c), F.lit("")) == "") | same(c, env)


def is_request() -> Column:
    """FLT-3."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (F.col("kind") == "request") | (F.coalesce("event_type", F.lit("")) == "http.request") | ((F.coalesce("duration_ms", F.lit(0)) > 0) & (some("method") | some("path") | some("handler")))


def handler_matches(wanted: str) -> Column:
    """FLT-4: the whole handler, or the controller before #."""
    return same("handler", wanted) | same(F.substring_index("handler", "#", 1), wanted)


def filter_logs(logs: DataFrame, start=None, end=None, env=None, path=None, min_duration_ms=None, min_db_count=None, n_plus_one=None, after_id=None, exclude=None, metadata=None, query=None, **equal) -> DataFrame:
    """FLT-1: the conjunction of whatever predicates are given. Times are inclusive.

    Names compare without case, identifiers exactly. Unknown keys are an error.
    """
    for c, v in equal.items():
        if v in (None, ""):
            continue
        if c in NAMES:
            logs = logs.filter(same(c, v))
        elif c in IDENTIFIERS:
            logs = logs.filter(F.col(c) == v)
        else:
            raise ValueError(f"no filter {c!r}")
    if start is not None:
        logs = logs.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if env:
        logs = logs.filter(env_matches(env))
    if path:
        logs = logs.filter(F.contains("path", F.lit(path)))
    for c, least in (("duration_ms", min_duration_ms), ("db_count", min_db_count)):
        if least:
            logs = logs.filter(F.col(c) >= least)
    if n_plus_one is not None:
        logs = logs.filter(F.col("n_plus_one") == n_plus_one)
    if after_id is not None:
        logs = logs.filter(F.col("id") > after_id)
    if exclude:
        logs = logs.filter(excluded(logs, exclude))
    if metadata:
        logs = logs.filter(metadata_filter(metadata, body.is_variant(logs)))
    if query is not None:
        logs = full_text(logs, query)
    return logs


def query_tokens(query: str) -> Column:
    return tokens(F.lit(query))


def full_text(logs: DataFrame, query: str, c: str = "message") -> DataFrame:
    """FLT-6: every token of the query is in the text; a query without tokens matches nothing."""
    want = query_tokens(query)
    return logs.filter((F.size(want) > 0) & (F.size(F.array_except(want, tokens(F.col(c)))) == 0))


def posting_table(logs: DataFrame, c: str = "message") -> DataFrame:
    """(token, id): write it once, clustered by token, where many queries follow."""
    return logs.select(F.explode(tokens(F.col(c))).alias("token"), "id")


def full_text_by_postings(logs: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """FLT-6 over a posting table: rows whose id has every token."""
    want = postings.sparkSession.range(1).select(F.explode(query_tokens(query)).alias("token"))
    n = want.agg(F.count("*").alias("n"))
    hits = postings.join(F.broadcast(want), "token").groupBy("id").agg(F.count("*").alias("found")).join(F.broadcast(n), F.col("found") == F.col("n")).select("id")
    return logs.join(hits, "id", "left_semi")


def metadata_filter(wanted: dict[str, str], variant: bool = False) -> Column:
    """FLT-7: every key is in body.metadata with this value as text; `variant` where the body is one."""
    found = body.texts(variant, "$.metadata")
    out = F.lit(True)
    for k, v in wanted.items():
        out &= F.coalesce(F.try_element_at(found, F.lit(k)) == v, F.lit(False))
    return out


def excluded(logs: DataFrame, fields: dict[str, str]) -> Column:
    """FLT-8: drop listed values; empty values stay, unknown fields are ignored."""
    out = F.lit(True)
    for c, listed in fields.items():
        values = [v.strip().lower() for v in listed.split(",") if v.strip()]
        if c in logs.columns and values:
            out &= (F.coalesce(F.col(c), F.lit("")) == "") | ~F.lower(c).isin(*values)
    return out


def project_fields(logs: DataFrame, fields: str) -> DataFrame:
    """FLT-9: a comma-separated projection; id and ts always, unknown names never."""
    wanted = [f.strip() for f in fields.split(",")]
    return logs.select("id", "ts", *[f for f in dict.fromkeys(wanted) if f in logs.columns and f not in ("id", "ts")])


def last_deploy_window(logs: DataFrame, deploys: DataFrame, service=None, env=None) -> DataFrame:
    """FLT-10: rows since the newest deploy in scope; all rows when there is none."""
    scope = deploys
    if service:
        scope = scope.filter(same("service", service))
    if env:
        scope = scope.filter(env_matches(env))
    newest = scope.agg(F.max("first_seen").alias("since"))
    return logs.crossJoin(F.broadcast(newest)).filter(F.col("since").isNull() | (F.col("ts") >= F.col("since"))).drop("since")


def is_critical(patterns: list[str], *columns: str) -> Column:
    """FLT-11: any pattern in any field, without case."""
    found = F.lit(False)
    for c in columns:
        found |= _any(patterns, c)
    return found


def _any(patterns, c):
    low = F.lower(F.coalesce(F.col(c), F.lit("")))
    return F.exists(F.array(*[F.lit(p.lower()) for p in patterns]).cast("array<string>"), lambda p: F.contains(low, p))
