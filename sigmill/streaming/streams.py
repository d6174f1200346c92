"""STR: the same operators over unbounded input. Late rows may be an hour late."""

from __future__ import annotations

import io
import json
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.predicates import filter_logs, is_error

LATE = "1 hour"


def marked(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def stream_minute_rollup(stream: DataFrame) -> DataFrame:
    """STR-6: AGG-5's counts, a minute at a time; append mode emits minutes that can't change any more."""
    g = marked(stream).groupBy(F.window("ts", "1 minute"), "service", "env", "level").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.select(F.col("window.start").alias("minute"), "service", "env", "level", "n", "first_id", "last_id")


def stream_error_groups(stream: DataFrame) -> DataFrame:
    """STR-2: ERR-1's counts and times per (fingerprint, env), for update or complete mode."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter(is_error() & (F.col("error_fingerprint") != ""))
    return rows.groupBy(F.col("error_fingerprint").alias("fingerprint"), "env").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max("id").alias("last_log_id"))


def stream_impacts(stream: DataFrame) -> DataFrame:
    """STR-2: ERR-9's counts per (fingerprint, env, user)."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).filter(is_error() & (F.col("error_fingerprint") != "") & (F.coalesce("user_id", F.lit("")) != ""))
    return rows.groupBy(F.col("error_fingerprint").alias("fingerprint"), "env", "user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"))


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for update mode: each batch is a folder of its own, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/update={number}")

    return write


def latest_updates(updates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The newest row per key of a table that `keep_updates` wrote."""
    rest = [c for c in updates.columns if c not in (*keys, "batch", "update")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


#: Of a trace or service that has been silent for so long nothing is kept any more.
FORGET_S = 86_400


def timer(silence_s: int | None, clock: str) -> str:
    """Timers by the watermark ("event"), so that replayed history times out as live data would, or by the machine's clock; none without a silence."""
    if clock not in ("event", "processing"):
        raise ValueError(f"no clock {clock!r}")
    if not silence_s:
        return GroupStateTimeout.NoTimeout
    return GroupStateTimeout.EventTimeTimeout if clock == "event" else GroupStateTimeout.ProcessingTimeTimeout


def wake(state: GroupState, last_ms: int, after_s: int, clock: str) -> None:
    """Times out once `after_s` have passed since `last_ms`, or since now by the machine's clock."""
    if clock == "event":
        state.setTimeoutTimestamp(max(last_ms + 1000 * after_s, state.getCurrentWatermarkMs() + 1))
    else:
        state.setTimeoutDuration(1000 * after_s)


TRACE = "trace_id string, spans long, services string, duration_ms long, has_errors boolean, status string"
#: Traces are kept in so many buckets, each one state: a batch costs its rows and a fixed number of calls, not a call a trace.
BUCKETS = 512
HELD = ("trace_id", "spans", "services", "first", "last", "errors", "status", "due")
#: Between the names of services in a state.
NUL = "\0"


def packed(held: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    held.reset_index(drop=True).to_feather(out, compression="lz4")
    return out.getvalue()


def joined_names(traces: pd.Series, names: pd.Series) -> pd.Series:
    """The sorted distinct names of each trace; traces whose names are all null are left out."""
    pairs = pd.DataFrame({"trace_id": traces, "service": names}).dropna().drop_duplicates().sort_values(["trace_id", "service"])
    return pairs.groupby("trace_id")["service"].agg(NUL.join)


def trace_update(silence_s: int, clock: str):
    """The traces of one bucket: those with rows come out, those silent for long enough once more, and after long silence they are forgotten."""

    def update(key, batches, state: GroupState):
        held = pd.read_feather(io.BytesIO(state.get[0])) if state.exists else pd.DataFrame(columns=list(HELD))
        now = state.getCurrentWatermarkMs() if clock == "event" else state.getCurrentProcessingTimeMs()
        wake_at = lambda last, after_s: np.maximum(last + 1000 * after_s, now + 1) if clock == "event" else now + 1000 * after_s
        rows = [] if state.hasTimedOut else [b for b in batches if len(b)]
        fresh = None
        if rows:
            rows = pd.concat(rows)
            fresh = rows.groupby("trace_id").agg(spans=("ms", "size"), first=("ms", "min"), last=("ms", "max"), errors=("error", "any"))
            known = held[held["trace_id"].isin(fresh.index)]
            split = known[["trace_id", "services"]].dropna()
            split = split.assign(services=split["services"].str.split(NUL)).explode("services")
            if len(known):
                both = pd.concat([fresh.reset_index(), known[["trace_id", "spans", "first", "last", "errors"]]])
                fresh = both.groupby("trace_id").agg(spans=("spans", "sum"), first=("first", "min"), last=("last", "max"), errors=("errors", "any"))
            fresh["services"] = joined_names(pd.concat([rows["trace_id"], split["trace_id"]]), pd.concat([rows["service"], split["services"]])).reindex(fresh.index)
            fresh = fresh.reset_index().assign(status="partial")
            fresh["due"] = wake_at(fresh["last"].astype("int64"), silence_s)
            held = held[~held["trace_id"].isin(fresh["trace_id"])]
        due = held["due"].astype("int64") < now if clock == "event" else held["due"].astype("int64") <= now
        silent = held[due & (held["status"] == "partial")].assign(status="timeout")
        silent["due"] = wake_at(silent["last"].astype("int64"), max(silence_s, FORGET_S))
        parts = [p[list(HELD)] for p in (held[~due], silent, fresh) if p is not None and len(p)]
        if parts:
            kept = pd.concat(parts).astype({"spans": "int64", "first": "int64", "last": "int64", "errors": "bool", "due": "int64"})
            state.update((packed(kept),))
            first_due = int(kept["due"].min())
            if clock == "event":
                state.setTimeoutTimestamp(max(first_due, now + 1))
            else:
                state.setTimeoutDuration(max(first_due - now, 1))
        elif state.exists:
            state.remove()
        shown = [p[list(HELD)] for p in (fresh, silent) if p is not None and len(p)]
        if shown:
            out = pd.concat(shown)
            yield pd.DataFrame({
                "trace_id": out["trace_id"], "spans": out["spans"].astype("int64"), "services": out["services"].fillna("").str.replace(NUL, ",", regex=False),
                "duration_ms": (out["last"] - out["first"]).astype("int64"), "has_errors": out["errors"].astype("bool"), "status": out["status"],
            })

    return update


def stream_trace_status(stream: DataFrame, silence_s: int | None = 30, clock: str = "processing", buckets: int = BUCKETS) -> DataFrame:
    """STR-3: TRC-6 kept per trace; a trace that is silent for 30 s comes out once more, timed out (TRC-7).

    A later row makes it partial again with all its counts, for a day. Without
    a silence there are no timers, and Spark's own aggregates keep the traces.
    """
    kind = timer(silence_s, clock)
    some = F.coalesce("trace_id", F.lit("")) != ""
    if not silence_s:
        rows = stream.filter(some).withColumn("ts", F.col("ts").cast("timestamp"))
        span = F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))
        return rows.groupBy("trace_id").agg(F.count("*").alias("spans"), F.array_join(F.sort_array(F.collect_set("service")), ",").alias("services"), span.alias("duration_ms"), F.max(F.coalesce(is_error(), F.lit(False))).alias("has_errors"), F.lit("partial").alias("status"))
    rows = marked(stream).filter(some & F.col("ts").isNotNull()).select("trace_id", "service", F.coalesce(is_error(), F.lit(False)).alias("error"), "ts", F.unix_millis("ts").alias("ms"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(trace_update(silence_s, clock), TRACE, "held binary", "update", kind)


def live_tail(stream: DataFrame, **params) -> DataFrame:
    """STR-4: a filtered follow."""
    return filter_logs(stream, **params)


def heartbeat_update(silence_s: int | None, clock: str):
    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([{"service": key[0], "last_ms": last, "silent": True}])
            return
        last = max(int(df["ms"].max()) for df in batches)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        if silence_s:
            wake(state, last, silence_s, clock)
        yield pd.DataFrame([{"service": key[0], "last_ms": last, "silent": False}])

    return update


def stream_heartbeat(stream: DataFrame, silence_s: int | None = 900, clock: str = "processing") -> DataFrame:
    """STR-5: the last row of each service, and once more when it has been silent for the threshold."""
    rows = marked(stream).select("service", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("service").applyInPandasWithState(heartbeat_update(silence_s, clock), "service string, last_ms long, silent boolean", "last long", "update", timer(silence_s, clock))


def stream_first_seen_deploys(stream: DataFrame) -> DataFrame:
    """STR-7: the first row of each (version, service, env)."""
    rows = stream.filter(F.coalesce("version", F.lit("")) != "").select("version", "service", "env", F.col("ts").cast("timestamp").alias("first_seen"))
    return rows.dropDuplicates(["version", "service", "env"])


DESCRIBED = ("service", "error_class", "message", "source_file")
GROUP = "fingerprint string, env string, service string, error_class string, message string, source_file string, first_seen timestamp, last_seen timestamp, occurrences long, last_log_id long, status string, reopened long"


def folded(actions: list[list]) -> tuple[str, int]:
    """Status and reopenings after a group's actions [at, what, first and last occurrence until the next action], in order of time."""
    status, reopened = "unresolved", 0
    for _, what, first, _ in actions:
        if what != status and not (what == "reopened" and status == "unresolved"):
            status, reopened = what, reopened + (what == "reopened")
        if status == "resolved" and first is not None:
            status, reopened = "reopened", reopened + 1
    return status if status in ("resolved", "ignored") else "unresolved", reopened


def seen(actions: list[list], times: list[int]) -> None:
    """Notes occurrences (rising) with the action that each of them follows."""
    for i, entry in enumerate(actions):
        until = actions[i + 1][0] if i + 1 < len(actions) else None
        # An occurrence at the time of an action comes before it.
        here = times[bisect_right(times, entry[0]) : None if until is None else bisect_right(times, until)]
        if here:
            entry[2] = here[0] if entry[2] is None else min(entry[2], here[0])
            entry[3] = here[-1] if entry[3] is None else max(entry[3], here[-1])


def acted(actions: list[list], at: int, what: str, last_seen: int | None) -> None:
    """Puts an action in its place; what is known to have occurred after it goes over to it."""
    if any(entry[:2] == [at, what] for entry in actions):
        return
    place = bisect_right([entry[:2] for entry in actions], [at, what])
    first = last = None
    if place:
        before = actions[place - 1]
        if before[3] is not None and before[3] > at:
            first, last = (before[2] if before[2] > at else before[3]), before[3]
            if before[2] > at:
                before[2] = before[3] = None
            else:
                before[3] = before[2]
    elif last_seen is not None and last_seen > at:
        first = last = last_seen
        if actions and actions[0][0] < last_seen:
            first = last = None
    actions.insert(place, [at, what, first, last])


def group_update(key, batches, state: GroupState):
    """One group's first row, counts and actions; rows and actions may come in any order."""
    held = json.loads(state.get[0]) if state.exists else {"n": 0, "first": None, "last": None, "last_id": None, "actions": []}
    rows = pd.concat([b for b in batches if len(b)])
    occurred, actions = rows[rows["action"].isna()], rows[rows["action"].notna()]
    times = sorted(occurred["us"].tolist())
    for at, what in sorted(zip(actions["us"].tolist(), actions["action"], strict=True)):
        acted(held["actions"], at, what, held["last"])
    seen(held["actions"], times)
    if times:
        first = occurred.sort_values(["us", "id"]).iloc[0]
        described = [int(first["us"]), int(first["id"]), *(None if pd.isna(first[c]) else first[c] for c in DESCRIBED)]
        if held["first"] is None or described[:2] < held["first"][:2]:
            held["first"] = described
        held["n"] += len(times)
        held["last"] = max(times[-1], held["last"] if held["last"] is not None else times[-1])
        held["last_id"] = max(int(occurred["id"].max()), held["last_id"] if held["last_id"] is not None else -(1 << 63))
    state.update((json.dumps(held),))
    if held["n"]:
        status, reopened = folded(held["actions"])
        moment = lambda us: pd.Timestamp(us, unit="us")
        row = (*key, *held["first"][2:], moment(held["first"][0]), moment(held["last"]), held["n"], held["last_id"], status, reopened)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in GROUP.split(", ")])


def stream_group_states(stream: DataFrame, actions: DataFrame) -> DataFrame:
    """STR-2: ERR-1's groups with the status and reopenings of ERR-3, kept per (fingerprint, env); update mode.

    `actions` is a stream of (fingerprint, env, at, action). Log rows and
    actions count by their own times, whatever order they come in; of a group's
    actions the first and last occurrence after each are kept. An action that
    comes after the occurrences it precedes may name a later one as the first
    after it; status and number are right.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("us")
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    rows = stream.filter(is_error() & (F.col("error_fingerprint") != ""))
    rows = rows.select(F.col("error_fingerprint").alias("fingerprint"), "env", us("ts"), "id", "service", "error_class", F.substring("message", 1, 500).alias("message"), "source_file", *none("action"))
    acts = actions.select("fingerprint", "env", us("at"), F.lit(None).cast("long").alias("id"), *none(*DESCRIBED), "action")
    return rows.unionByName(acts).groupBy("fingerprint", "env").applyInPandasWithState(group_update, GROUP, "held string", "update", GroupStateTimeout.NoTimeout)


def keep_first(path: str, keys: tuple[str, ...], at: str = "first_seen") -> Callable[[DataFrame, int], None]:
    """STR-7: a foreachBatch sink of first sightings: of a batch's rows the least `at` of each key, where it is new or earlier than what is stored.

    The stored sightings are the memory, so no state grows in the stream; they
    are as many as there are keys once `compact_updates` has run.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..sources import folders

        spark = batch.sparkSession
        found = batch.groupBy(*keys).agg(F.min(at).alias(at))
        if any(c.startswith("update=") and c != f"update={number}" for c in folders.children(spark, path)):
            known = spark.read.parquet(path).filter(F.col("update") != number).groupBy(*keys).agg(F.min(at).alias("known"))
            same = [found[k].eqNullSafe(known[k]) for k in keys]
            found = found.join(known, same, "left").filter(F.col("known").isNull() | (found[at] < F.col("known"))).select(*[found[c] for c in (*keys, at)])
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/update={number}")

    return write


def sightings(stream: DataFrame) -> DataFrame:
    """STR-7: (version, service, env, first_seen) of every row with a version, for `keep_first`."""
    return stream.filter(F.coalesce("version", F.lit("")) != "").select("version", "service", "env", F.col("ts").cast("timestamp").alias("first_seen"))


def compact_updates(spark, path: str, keys: tuple[str, ...]) -> None:
    """Makes one folder of all that `keep_updates` wrote, the newest row of each key; a sink then holds keys, not history.

    Call it between runs of the stream. A crash is made good by the next call.
    """
    from ..sources import folders

    folders.recover(spark, path)
    old = [c for c in folders.children(spark, path) if c.startswith("update=")]
    if len(old) > 1:
        rows = spark.read.parquet(path).drop("update")
        rest = [c for c in rows.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
        # A number that no batch has, so a batch that comes again can't overwrite it.
        folders.replace_folders(spark, path, "updates", {"newest": newest.withColumn("update", F.lit(-1))}, {"newest": ("update",)}, old, flat=True)
