"""ING: row transforms on the way in."""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.wire import FIELDS, LIMITS

# Keys whose values never pass.
SENSITIVE = ("password", "token", "secret", "authorization", "api_key", "credit_card")
# Names of other logging habits and the field they mean; a dot leads into the body.
ALIASES = {
    "timestamp": "ts", "time": "ts", "@timestamp": "ts", "datetime": "ts", "date": "ts", "when": "ts",
    "severity": "level", "levelname": "level", "log_level": "level", "loglevel": "level", "priority": "level",
    "msg": "message", "text": "message", "content": "message", "summary": "message",
    "logger": "service", "app": "service", "application": "service", "service_name": "service", "component": "service",
    "environment": "env", "stage": "env", "deployment": "env",
    "release": "version", "commit": "version", "sha": "version", "revision": "version", "build": "version",
    "hostname": "host", "server": "host", "pod": "host", "container": "host", "instance": "host",
    "duration": "duration_ms", "elapsed": "duration_ms", "latency": "duration_ms", "took": "duration_ms", "response_time": "duration_ms", "runtime": "duration_ms",
    "status_code": "status", "http_status": "status", "response_status": "status",
    "url": "path", "uri": "path", "request_path": "path",
    "endpoint": "route", "pattern": "route",
    "verb": "method", "http_method": "method", "request_method": "method",
    "controller": "handler", "action": "handler", "function": "handler", "operation": "handler",
    "user": "user_id", "uid": "user_id", "actor": "user_id", "current_user": "user_id",
    "account_id": "tenant_id", "org_id": "tenant_id", "organization_id": "tenant_id", "workspace_id": "tenant_id",
    "trace": "trace_id", "traceid": "trace_id",
    "correlation_id": "request_id", "req_id": "request_id",
    "span": "span_id", "spanid": "span_id", "parent_id": "parent_span_id",
    "exception": "error_class", "error_type": "error_class", "exception_class": "error_class", "class": "error_class",
    "error": "error_message", "err": "error_message", "exception_message": "error_message", "reason": "error_message",
    "file": "source_file", "filename": "source_file", "path_to_file": "source_file",
    "line": "source_line", "lineno": "source_line", "line_number": "source_line",
    "queue": "job_queue", "worker": "job_class", "job": "job_class", "task": "job_class",
    "db_time": "db_ms", "sql_time": "db_ms", "sql_count": "db_count", "query_count": "db_count",
    "metadata": "body", "extra": "body", "fields": "body", "attributes": "body", "attrs": "body", "context": "body", "data": "body", "payload": "body", "details": "body", "queries": "body",
    "stack": "body.backtrace", "stacktrace": "body.backtrace", "backtrace": "body.backtrace", "stack_trace": "body.backtrace", "traceback": "body.backtrace",
    "params": "body.params",
}


def unit_hash(c: Column) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("double") / 2.0**32


def sample_logs(logs: DataFrame, rules: DataFrame, keep_levels: tuple[str, ...] = ("error", "fatal"), key: str = "id") -> DataFrame:
    """ING-1: rows of a service stay at its rule's rate, or that of `*`; the same row always fares the same.

    rules: service, rate, keep_errors; a rule per service, so it is broadcast.
    """
    own = rules.filter("service <> '*'").select("service", F.col("rate").alias("r"), F.col("keep_errors").alias("k"))
    star = rules.filter("service = '*'").agg(F.max("rate").alias("r0"), F.max("keep_errors").alias("k0"))
    j = logs.join(F.broadcast(own), "service", "left").crossJoin(F.broadcast(star))
    rate, keep = F.coalesce("r", "r0", F.lit(1.0)), F.coalesce("k", "k0", F.lit(False))
    return j.filter((keep & F.col("level").isin(*keep_levels)) | (unit_hash(F.col(key)) < rate)).drop("r", "k", "r0", "k0")


def scrub_body_text(body: str | None, sensitive: frozenset, patterns, depth: int = 32) -> str | None:
    """One JSON document with every string leaf redacted and sensitive keys replaced whole."""
    if not body:
        return body
    try:
        data = json.loads(body)
    except ValueError:
        return body

    def leaf(s: str) -> str:
        for p in patterns:
            s = p.sub(text.FILTERED, s)
        return s

    def walk(x, left):
        if left < 0:
            return x
        if isinstance(x, dict):
            return {k: text.FILTERED if k.lower() in sensitive else walk(v, left - 1) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, left - 1) for v in x]
        return leaf(x) if isinstance(x, str) else x

    return json.dumps(walk(data, depth), separators=(",", ":"), ensure_ascii=False)


def scrub_body(c: Column, sensitive: tuple[str, ...] = SENSITIVE) -> Column:
    """ING-3: arbitrary JSON has no fixed shape, so this is the one Arrow function of the ingest path."""
    names = frozenset(s.lower() for s in sensitive)

    @F.pandas_udf("string")
    def run(bodies):
        import re

        patterns = [re.compile(p, re.ASCII) for p in text.SCRUB]
        return bodies.map(lambda b: scrub_body_text(b, names, patterns), na_action="ignore")

    return run(c)


def source_file_from_backtrace(body: Column) -> Column:
    """ING-6: the file of the first frame of body.backtrace, else of the first line of body.stack_trace that has one."""
    def of_frame(f: Column) -> Column:
        f = F.trim(f)
        python = F.regexp_extract(f, '^File "([^"]*)"', 1)
        node = F.when(F.contains(f, F.lit("(")), F.regexp_replace(F.substring_index(f, "(", -1), r"\)$", "")).otherwise(F.regexp_replace(f, "^at ", ""))
        f = F.when(F.startswith(f, F.lit("at ")), node).otherwise(f)
        return F.when(python != "", python).otherwise(F.trim(F.substring_index(f, ":", 1)))

    first = F.get(F.from_json(F.get_json_object(body, "$.backtrace"), "array<string>"), F.lit(0))
    lines = F.transform(F.slice(F.split(F.coalesce(F.get_json_object(body, "$.stack_trace"), F.lit("")), "\n"), 1, 3), F.trim)
    lines = F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("Error:")) & ~F.startswith(s, F.lit("TypeError:")))
    files = F.filter(F.transform(lines, of_frame), lambda s: s != "")
    own = F.nullif(of_frame(first), F.lit(""))
    return F.coalesce(own, F.get(files, F.lit(0)), F.lit(""))


def add_fingerprints(logs: DataFrame) -> DataFrame:
    """ING-4 on error rows."""
    made = text.fingerprint(F.col("service"), F.col("error_class"), F.col("source_file"), F.col("message"))
    return logs.withColumn("error_fingerprint", F.when(F.col("level").isin("error", "fatal"), made).otherwise(""))


INHERITED = ("service", "env", "version", "trace_id", "request_id", "user_id", "tenant_id")


def expand_in_request_logs(logs: DataFrame, most: int = 1000) -> DataFrame:
    """ING-7: parents and the rows that their body.logs hold, at most `most` of each parent."""
    kids = F.from_json(F.get_json_object("body", "$.logs"), "array<struct<level:string,message:string,at:double,metadata:string>>")
    e = logs.select("*", F.posexplode(F.slice(F.coalesce(kids, F.array().cast("array<struct<level:string,message:string,at:double,metadata:string>>")), 1, most)).alias("pos", "kid"))
    e = e.filter("kid is not null")
    own = {
        "ts": F.timestamp_millis(F.unix_millis("ts") + F.coalesce("kid.at", F.lit(0.0)).cast("long")),
        "level": F.lower(F.coalesce(F.nullif(F.col("kid.level"), F.lit("")), F.lit("info"))),
        "message": F.coalesce("kid.message", F.lit("")),
        "event_type": F.lit("in_request_log"),
        "kind": F.lit("log"),
        "body": F.when(F.col("kid.metadata").isNotNull(), F.concat(F.lit('{"metadata":'), "kid.metadata", F.lit("}"))),
        "id": F.col("id"),
    }
    kinds = dict(logs.dtypes)
    rows = e.select(*[(own[c] if c in own else F.col(c) if c in INHERITED else F.lit(None)).cast(kinds[c]).alias(c) for c in logs.columns])
    return logs.unionByName(rows)


def ingest_pipeline(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """ING-8: sample, fingerprint, scrub (both texts and the body), expand, in this order."""
    texts = [c for c in ("message", "error_message") if c in logs.columns]
    scrub = lambda df: df.withColumns({c: text.scrub_text(F.col(c)) for c in texts} | {"body": scrub_body(F.col("body"))})
    return sample_logs(logs, rules).transform(add_fingerprints).transform(scrub).transform(expand_in_request_logs)


def dedup_batches(df: DataFrame, batch: str = "batch_id", row: str = "id") -> DataFrame:
    """ING-9: of batches with one id the first to arrive stays, whole.

    df: batch id, received_at and `row`. The first arrival per batch is an
    aggregate, so a batch sent a million times is one row before the join.
    """
    first = df.groupBy(batch).agg(F.min("received_at").alias("first_received"))
    return df.join(first, batch).filter(F.col("received_at") == F.col("first_received")).drop("first_received")


#: Batch ids are kept in so many buckets, each one state: a micro-batch costs its rows and a fixed number of calls, not a call an id.
BUCKETS = 512


def admit(names: list[str], remember_s: int):
    """The batches of one bucket: rows of first arrivals come out, ids without rows are forgotten once they are due."""
    import pandas as pd

    from ..streaming.streams import packed

    def update(key, parts, state):
        held = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else pd.DataFrame({"batch": pd.Series(dtype="object"), "first": pd.Series(dtype="int64"), "due": pd.Series(dtype="int64")})
        now = state.getCurrentWatermarkMs()
        parts = [] if state.hasTimedOut else [p for p in parts if len(p)]
        shown, fresh = None, None
        if parts:
            rows = pd.concat(parts)
            first = rows.groupby("__batch")["__us"].min().dropna().astype("int64")
            known = held[held["batch"].isin(first.index)].set_index("batch")["first"]
            first.loc[known.index] = known
            due = (first // 1000 + 1000 * remember_s).clip(lower=now + 1)
            fresh = pd.DataFrame({"batch": first.index, "first": first.to_numpy("int64"), "due": due.to_numpy("int64")})
            held = held[~held["batch"].isin(first.index)]
            shown = rows.loc[rows["__us"] == rows["__batch"].map(first), names]
        kept = [k for k in (held[held["due"] >= now], fresh) if k is not None and len(k)]
        if kept:
            kept = pd.concat(kept)
            state.update((packed(kept),))
            state.setTimeoutTimestamp(max(int(kept["due"].min()), now + 1))
        elif state.exists:
            state.remove()
        if shown is not None:
            yield shown

    return update


def dedup_batches_stream(df: DataFrame, batch: str = "batch_id", within: str = "1 hour", remember_s: int = 3600, buckets: int = BUCKETS) -> DataFrame:
    """ING-9 on a stream: every row of a batch's first arrival passes; the batch sent again doesn't.

    The first arrival is the least `received_at` of the first micro-batch that
    has the id; rows of that arrival pass in later ones too. Ids are forgotten
    once the watermark (`received_at` less `within`) is `remember_s` past their
    arrival, so the state holds the ids of that time and no more. Rows without
    an id are never dropped: they pass by, without any state. Ids are told
    apart by their text.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    known = df.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", within)
    ids = F.coalesce(F.col(batch).cast("string"), F.lit(""))
    rows = known.filter(ids != "").withColumns({"__us": F.unix_micros("received_at"), "__batch": ids, "__bucket": F.pmod(F.xxhash64(ids), F.lit(buckets))})
    kept = rows.groupBy("__bucket").applyInPandasWithState(admit(known.columns, remember_s), known.schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.unionByName(known.filter(ids == ""))


KINDS = {"string": "a JSON string", "number": "a JSON number", "boolean": "true or false", "object": "a JSON object"}
# Fields that every sender should give.
RECOMMENDED = ("service", "ts")
REQUEST_ONLY = ("method", "path", "handler", "n_plus_one", "dup_queries")


#: What `infer_kind` looks at beside an explicit kind.
EVIDENCE = ("status", "event_type", "method", "path", "route", "job_class", "job_queue", "job_id")
JSON_KINDS = {"STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array", "VOID": ""}


def json_kind(value: Column) -> Column:
    """The JSON kind of a variant: string, number, boolean, object or array; empty for JSON null."""
    outer = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in JSON_KINDS.items() for x in pair]), outer), F.lit("number"))


def validate_payload(payloads: DataFrame, as_of: str, c: str = "payload") -> DataFrame:
    """ING-10: errors, warnings, unknown fields (and what each may have meant) and the inferred kind of each JSON object.

    The kinds of all fields that were sent come from one parse of the text, to a variant, and the values from another.
    """
    kinds_sent = F.transform_values(F.try_variant_get(F.try_parse_json(F.col(c)), "$", "map<string,variant>"), lambda _, v: json_kind(v))
    known, value = payloads.columns, lambda k: F.col(f"__sent_{k}")
    asked = sorted({"level", "message", "ts", "kind", *EVIDENCE, *LIMITS, *REQUEST_ONLY})
    # Generated, so that what depends on the values doesn't parse the text again for each use.
    payloads = payloads.select("*", F.json_tuple(c, *asked).alias(*[f"__sent_{k}" for k in asked])).select("*", F.explode(F.array(kinds_sent)).alias("__kinds")).withColumn("__kind", infer_kind(value))
    keys = F.json_object_keys(c)
    bad = keys.isNull()
    level = F.lower(value("level"))
    ok_levels = ("debug", "info", "warn", "warning", "error", "fatal")
    ts = F.try_to_timestamp(value("ts"))
    age = F.timestamp_diff("SECOND", ts, F.lit(as_of).cast("timestamp"))
    of = lambda k: F.try_element_at("__kinds", F.lit(k))
    wrong = [F.when((of(k) != t) & (of(k) != ""), f"{k}: expected {KINDS[t]}") for k, t in FIELDS.items()]
    kind = F.col("__kind")
    errors = [
        F.when(bad, "entry must be a JSON object"),
        F.when(~bad & (F.coalesce(value("level"), F.lit("")) == ""), "level: required"),
        F.when((F.coalesce(level, F.lit("")) != "") & ~level.isin(*ok_levels), "level: not one of debug, info, warn, error, fatal"),
        F.when(~bad & (F.coalesce(value("message"), F.lit("")) == ""), "message: required"),
        F.when((F.coalesce(value("ts"), F.lit("")) != "") & ts.isNull(), "ts: not RFC 3339"),
        *wrong,
    ]
    sent = lambda k: F.array_contains(keys, k)
    warnings = [
        F.when(value("level") != level, "level: stored in lower case"),
        F.when(value("level") == "warning", "level: stored as warn"),
        F.when(age > 48 * 3600, "ts: older than 48 hours"),
        F.when(age < -3600, "ts: more than an hour ahead"),
        *[F.when(~bad & ~sent(k), f"{k}: not sent") for k in RECOMMENDED],
        *[F.when(F.octet_length(value(k)) > n, f"{k}: truncated to {n} bytes") for k, n in LIMITS.items()],
        F.when(~bad & (F.coalesce(value("kind"), F.lit("")) == ""), F.concat(F.lit("kind: not sent, inferred as "), kind)),
        *[F.when((kind != "request") & value(k).isNotNull(), f"{k}: kept on request rows only") for k in REQUEST_ONLY],
    ]
    some = lambda xs: F.array_compact(F.array(*xs))
    unknown = F.sort_array(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS))))
    report = payloads.select(*known, some(errors).alias("errors"), some(warnings).alias("warnings"), unknown.alias("unknown"), F.transform(unknown, suggest_field).alias("did_you_mean"), kind.alias("kind"))
    return report.withColumn("valid", F.size("errors") == 0)


def infer_kind(value) -> Column:
    """An explicit kind wins; then HTTP evidence, job fields, an event type. A duration is no evidence."""
    has = lambda *ks: F.lit(False) if not ks else F.greatest(*[F.coalesce(value(k), F.lit("")) != "" for k in ks], F.lit(False))
    given = F.lower(F.trim(F.coalesce(value("kind"), F.lit(""))))
    status = F.coalesce(value("status").try_cast("double"), F.lit(0.0)) > 0
    http = has("method", "path", "route") | status
    return F.when(given != "", given).when(value("event_type") == "http.request", "request").when(http, "request").when(has("job_class", "job_queue", "job_id"), "job").when(has("event_type"), "event").otherwise("log")


def suggest_field(c: Column) -> Column:
    """ING-11: an alias, told with its place where it lies in the body, or the nearest field within two edits; ties go to the smaller name."""
    k = F.lower(F.trim(c))
    place = lambda field: '{}, as "{}" inside it'.format(*field.split(".")) if "." in field else field
    alias = F.try_element_at(F.create_map(*[F.lit(x) for name, field in ALIASES.items() for x in (name, place(field))]), k)
    near = F.array_compact(F.array(*[F.when(F.levenshtein(k, F.lit(f), 2) >= 0, F.struct(F.levenshtein(k, F.lit(f), 2).alias("d"), F.lit(f).alias("f"))) for f in FIELDS]))
    return F.coalesce(alias, F.array_min(near)["f"], F.lit(""))
