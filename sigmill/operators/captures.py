"""CAP: arrays and objects that requests carry in their body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import body

KINDS = ("sql", "http", "email", "file", "audit")


def captures(logs: DataFrame, kind: str) -> DataFrame:
    """CAP-1: (id, ts, service, pos, item) of body.<kind> or body.metadata.<kind>; only objects, as JSON or variants like the body."""
    if kind not in KINDS:
        raise ValueError(f"no capture {kind!r}")
    v = body.is_variant(logs)
    items = logs.select("id", "ts", "service", F.posexplode(F.coalesce(body.elements(v, f"$.{kind}"), body.elements(v, f"$.metadata.{kind}"))).alias("pos", "item"))
    return items.filter(body.is_object(v, "item"))


def field(name: str, variant: bool = False):
    """A field of a captured item; `variant` where the body was one."""
    return body.part(variant, f"$.{name}", "item")


def request_capture(logs: DataFrame, log_id: int) -> DataFrame:
    """CAP-2: the parts of one request's capture."""
    parts = ("request_headers", "response_headers", "params", "request_body", "response_body", "performance", "timeline", "context", "metadata")
    return logs.filter(F.col("id") == log_id).select("id", *[body.part(body.is_variant(logs), f"$.{p}").alias(p) for p in parts])


def audit_trail(logs: DataFrame, record_type: str, record_id: str) -> DataFrame:
    """CAP-3."""
    of = lambda name: field(name, body.is_variant(logs))
    return captures(logs, "audit").filter((of("record_type") == record_type) & (of("record_id") == record_id)).orderBy("ts", "id", "pos")


def search_audit(logs: DataFrame, as_of: str, actor=None, action=None, hours: int = 24) -> DataFrame:
    """CAP-4: at least one of actor and action."""
    if not actor and not action:
        raise ValueError("an actor or an action is needed")
    rows = captures(logs.filter(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))), "audit")
    for name, value in (("actor", actor), ("action", action)):
        if value:
            rows = rows.filter(field(name, body.is_variant(logs)) == value)
    return rows.orderBy(F.desc("ts"), F.desc("id"), "pos")


def search_sql(logs: DataFrame, fingerprint=None, table=None, min_ms=None, limit: int = 50) -> DataFrame:
    """CAP-5: captured SQL by fingerprint, table or duration; at least one of them."""
    if not (fingerprint or table or min_ms):
        raise ValueError("a filter is needed")
    of = lambda name: field(name, body.is_variant(logs))
    rows = captures(logs, "sql").withColumns({"table": of("table"), "duration_ms": of("duration_ms").try_cast("double"), "fingerprint": of("fingerprint")})
    if fingerprint:
        rows = rows.filter(F.col("fingerprint") == fingerprint)
    if table:
        rows = rows.filter(F.col("table") == table)
    if min_ms:
        rows = rows.filter(F.col("duration_ms") >= min_ms)
    return rows.orderBy(F.desc("ts"), F.desc("id"), "pos").limit(min(limit, 500))


def recent_emails(logs: DataFrame, since: str) -> DataFrame:
    """CAP-6."""
    return captures(logs.filter(F.col("ts") >= F.lit(since).cast("timestamp")), "email").orderBy(F.desc("ts"), F.desc("id"), "pos")
