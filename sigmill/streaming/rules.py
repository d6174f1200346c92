"""STR-1: alert rules of all kinds on a live stream.

What rules need of the past is kept per (service, environment): sums of each
minute, when each rule was last judged, and the newest minute. Sums add up, so
a window of any rule is a sum of minutes, and its p95 comes from exact counts
of values. Partitions sum their rows before the shuffle, so a busy service
sends a row for each duration of a minute, not all of its rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.predicates import ERRORS, is_request
from ..operators.watches import COUNTS, METRICS, evaluate_condition
from .streams import LATE, packed

WINDOWS = ("now", "previous", "baseline")
SUMS = ("n", "errors", "d", "timed", "sql", "hits", "reads", "p95", "last")


def count_leaves(watches: list[dict]) -> dict[str, dict]:
    """The count conditions of all rule trees by name; one name, one condition."""
    found: dict[str, dict] = {}

    def walk(tree):
        tree = json.loads(tree) if isinstance(tree, str) else tree
        for key in ("all", "any"):
            for t in tree.get(key, ()):
                walk(t)
        if "not" in tree:
            walk(tree["not"])
        if tree.get("type") == "count":
            leaf = {k: tree.get(k) for k in ("minutes", "field", "level", "service")}
            leaf["minutes"] = leaf["minutes"] or 60
            if found.setdefault(tree["name"], leaf) != leaf:
                raise ValueError(f"two count conditions are called {tree['name']!r}")

    for w in watches:
        walk(w["condition"])
    return found


def minutes(stream: DataFrame, leaves: dict[str, dict]) -> DataFrame:
    """What each batch of rows adds to each minute: SUMS and counts by (service, env, minute), by `value` (a request's duration, 0 for other rows), and by the values that conditions count."""
    timed = is_request() & (F.col("duration_ms") > 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = lambda c: F.when(timed, c).otherwise(0)
    some = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    added = {
        "n": F.lit(1), "errors": F.col("level").isin(*ERRORS), "d": whole(F.col("duration_ms")), "timed": timed, "sql": whole(F.col("db_count")),
        "hits": whole(F.col("cache_hits")), "reads": whole(F.col("cache_hits") + F.col("cache_misses")), "last": us,
    }
    keys, counted = {}, {}
    for i, leaf in enumerate(leaves.values()):
        meant = F.lit(True)
        if leaf["level"]:
            meant &= F.col("level") == leaf["level"].lower()
        if leaf["service"]:
            meant &= F.lower("service") == leaf["service"].lower()
        if leaf["field"]:
            keys[f"leaf{i}"] = F.nullif(F.when(meant, F.col(leaf["field"]).cast("string")), F.lit(""))
        else:
            counted[f"leaf{i}"] = meant
    ranked = F.when((F.col("kind") == "request") & (F.col("duration_ms") > 0), F.col("duration_ms"))
    rows = stream.filter((F.coalesce("service", F.lit("")) != "") & F.col("ts").isNotNull()).select(
        "service", F.coalesce("env", F.lit("")).alias("env"), F.floor(us / 60_000_000).alias("minute"), some(ranked).alias("value"),
        *[c.alias(k) for k, c in keys.items()], *[some(c).alias(k) for k, c in (added | counted).items()],
    )
    by = ["service", "env", "minute", "value", *keys]
    sums = [(c, "max" if c == "last" else "sum") for c in (*added, *counted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in gathered(batches, lambda b: b.num_rows):
            found = pa.Table.from_batches(parts).group_by(by, use_threads=False).aggregate(sums)
            yield from found.rename_columns([c.removesuffix("_sum").removesuffix("_max") for c in found.column_names]).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, rows.schema).withColumn("at", F.timestamp_seconds(F.col("minute") * 60)).withWatermark("at", LATE)


def gathered(parts: Iterator, size: Callable, rows: int = 200_000) -> Iterator[list]:
    """Parts in lists of so many rows, but for the last list."""
    some, n = [], 0
    for part in parts:
        some.append(part)
        n += size(part)
        if n >= rows:
            yield some
            some, n = [], 0
    if n:
        yield some


class Kept:
    """The minutes of one (service, environment): SUMS, counts of durations, and the values that conditions count."""

    FRAMES = ("sums", "times", "values")

    def __init__(self, leaves: dict[str, dict]):
        self.fields = {f"leaf{i}": i for i, leaf in enumerate(leaves.values()) if leaf["field"]}
        self.columns = [s for s in SUMS if s != "p95"] + [f"leaf{i}" for i, leaf in enumerate(leaves.values()) if not leaf["field"]]
        self.sums = pd.DataFrame(columns=["minute", *self.columns], dtype="int64")
        self.times = pd.DataFrame(columns=["minute", "value", "n"], dtype="int64")
        self.values = pd.DataFrame({"minute": pd.Series(dtype="int64"), "leaf": pd.Series(dtype="int64"), "value": pd.Series(dtype="object")})

    def load(self, held: tuple) -> None:
        self.sums, self.times, self.values = (pd.read_feather(io.BytesIO(h)) for h in held)

    def saved(self) -> tuple:
        return tuple(packed(getattr(self, f)) for f in self.FRAMES)

    def add(self, rows: pd.DataFrame) -> None:
        """Adds rows of `minutes`."""
        self.sums = pd.concat([self.sums, rows[self.sums.columns]]).groupby("minute", as_index=False).agg({c: "max" if c == "last" else "sum" for c in self.columns})
        self.times = pd.concat([self.times, rows.loc[rows["value"] > 0, ["minute", "value", "n"]]]).groupby(["minute", "value"], as_index=False)["n"].sum()
        values = [rows.loc[rows[c].notna(), ["minute", c]].rename(columns={c: "value"}).assign(leaf=i) for c, i in self.fields.items()]
        self.values = pd.concat([self.values, *(v[self.values.columns] for v in values)]).drop_duplicates()

    def forget(self, until: int) -> None:
        """Drops the minutes up to `until`."""
        for f in self.FRAMES:
            setattr(self, f, getattr(self, f).loc[lambda x: x["minute"] > until])

    def window(self, start: int, end: int) -> list:
        """SUMS of the minutes in [start, end); p95 is the value of the nearest rank."""
        sums, times = within(self.sums, start, end), within(self.times, start, end).groupby("value")["n"].sum().cumsum()
        if sums.empty:
            return [0] * 7 + [None, None]
        p95 = int(times.index[times.searchsorted(-(-95 * int(times.iloc[-1]) // 100))]) if len(times) else None
        return [*(int(sums[c].sum()) for c in SUMS[:7]), p95, int(sums["last"].max())]

    def counted(self, i: int, start: int, end: int) -> int:
        """What a count condition (by its number) counts in the minutes of [start, end)."""
        if i not in self.fields.values():
            return int(within(self.sums, start, end)[f"leaf{i}"].sum())
        values = within(self.values, start, end)
        return values.loc[values["leaf"] == i, "value"].nunique()


def within(frame: pd.DataFrame, start: int, end: int) -> pd.DataFrame:
    return frame[(frame["minute"] >= start) & (frame["minute"] < end)]


class RuleMemory(StatefulProcessor):
    """The minutes of one (service, environment), and when each rule was last judged on them."""

    def __init__(self, watches: list[dict], leaves: dict[str, dict]):
        self.watches, self.leaves = watches, leaves
        longest = [2 * w["minutes"] for w in watches] + [w["minutes"] + w["baseline_minutes"] for w in watches] + [leaf["minutes"] for leaf in leaves.values()]
        self.keep = max(longest, default=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getValueState("minutes", "sums binary, times binary, values binary")
        self.judged = handle.getMapState("judged", "watch_id string", "at long")
        self.newest = handle.getValueState("newest", "minute long, until long")

    def due(self, service: str, env: str, at: int) -> Iterator[dict]:
        """Rules in scope that weren't judged within half their interval, marked as judged now."""
        for w in self.watches:
            if any(w.get(c) and w[c].lower() != v.lower() for c, v in (("service", service), ("env", env))):
                continue
            key = (w["id"],)
            if self.judged.containsKey(key) and 2 * (at - self.judged.getValue(key)[0]) < w["interval_minutes"]:
                continue
            self.judged.updateValue(key, (at,))
            yield w

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        service, env = key
        kept = Kept(self.leaves)
        if self.minutes.exists():
            kept.load(self.minutes.get())
        for parts in gathered(rows, len):
            kept.add(pd.concat(parts))
            newest = int(kept.sums["minute"].max())
            kept.forget(newest - self.keep)
        self.minutes.update(kept.saved())
        if self.newest.exists():
            self.handle.deleteTimer(self.newest.get()[1])
        # Once nothing of it can matter any more the whole of it is forgotten.
        until = (newest + 1 + self.keep) * 60_000
        self.newest.update((newest, until))
        self.handle.registerTimer(until)
        at, out = newest + 1, []
        for w in self.due(service, env, at):
            spans = {"now": (at - w["minutes"], at), "previous": (at - 2 * w["minutes"], at - w["minutes"]), "baseline": (at - w["minutes"] - w["baseline_minutes"], at - w["minutes"])}
            counted = [kept.counted(i, at - leaf["minutes"], at) for i, leaf in enumerate(self.leaves.values())]
            out.append([w["id"], at, service, env, *(v for n in WINDOWS for v in kept.window(*spans[n])), *counted])
        yield pd.DataFrame(out, columns=[c for c, _ in columns(self.leaves)]).astype({c: "Int64" for c, kind in columns(self.leaves) if kind == "long"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.minutes.clear()
        self.judged.clear()
        self.newest.clear()
        return iter([])

    def close(self) -> None:
        pass


def columns(leaves: dict[str, dict]) -> list[tuple[str, str]]:
    return [("watch_id", "string"), ("minute", "long"), ("service", "string"), ("env", "string"), *((f"{w}_{s}", "long") for w in WINDOWS for s in SUMS), *((name, "long") for name in leaves)]


def metrics_of(name: str, end) -> list:
    """AGG-21's metrics from the sums of a window that ends at `end` (microseconds)."""
    c = lambda s: F.col(f"{name}_{s}")
    made = {
        "log_count": c("n"),
        "error_count": c("errors"),
        "error_rate": F.round(c("errors") / F.nullif(c("n"), F.lit(0)), 6),
        "response_time": F.round(c("d") / F.nullif(c("timed"), F.lit(0)), 4),
        "p95_response": c("p95"),
        "heartbeat": F.floor((end - c("last")) / 1_000_000),
        "sql_count": c("sql"),
        "cache_hit_rate": F.when(c("reads") > 0, F.round(c("hits") / c("reads"), 6)).otherwise(0.0),
    }
    some = lambda m, x: x if m in COUNTS else F.when(c("n") > 0, x)
    return [some(m, made[m]).cast("double").alias(f"{name}_{m}") for m in METRICS]


def stream_rule_frames(stream: DataFrame, watches: list[dict]) -> DataFrame:
    """(watch_id, at, service, env) and the columns of `metrics_frame` and `count_frame` for each rule that is due.

    Rules: id, condition, minutes and baseline_minutes of their windows (60 and
    1440 if not given), interval_minutes (5), and service, env and status. Only
    rules whose status is active (or not given) are judged. A batch with rows of
    a service judges its rules at the end of the newest minute seen, but none
    twice within half its interval. Needs the RocksDB state store.
    """
    active = [{"minutes": 60, "baseline_minutes": 1440, "interval_minutes": 5, **w} for w in watches if w.get("status", "active") == "active"]
    leaves = count_leaves(active)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns(leaves))
    found = minutes(stream, leaves).groupBy("service", "env").transformWithStateInPandas(RuleMemory(active, leaves), schema, "update", "eventtime")
    end = F.col("minute") * 60_000_000
    return found.select("watch_id", F.timestamp_seconds(F.col("minute") * 60).alias("at"), "service", "env", *[m for w in WINDOWS for m in metrics_of(w, end - (F.lit(0) if w == "now" else length(active, "minutes") * 60_000_000))], *leaves)


def length(watches: list[dict], key: str):
    return F.coalesce(*[F.when(F.col("watch_id") == w["id"], w[key]) for w in watches], F.lit(0)).cast("long")


def stream_watches(stream: DataFrame, watches: list[dict]) -> DataFrame:
    """STR-1: (watch_id, at, service, env, breached) for every rule that is due, by the trees of WAT-1; update mode."""
    frames = stream_rule_frames(stream, watches)
    active = [w for w in watches if w.get("status", "active") == "active"]
    breached = F.coalesce(*[F.when(F.col("watch_id") == w["id"], evaluate_condition(w["condition"])) for w in active], F.lit(False))
    return frames.select("watch_id", "at", "service", "env", breached.alias("breached"))
