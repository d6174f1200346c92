"""WAT: alert rules. A rule is a tree of conditions folded into one boolean column.

All rules are judged over one frame that has a row per (service, env) and, per
window, every metric as a column; there is no query per rule.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import measure, measures, one
from .predicates import env_matches, is_error

METRICS = ("log_count", "error_count", "error_rate", "response_time", "p95_response", "heartbeat", "sql_count", "cache_hit_rate")
COUNTS = ("log_count", "error_count", "sql_count")
OPS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}


def compare(a: Column, op: str, b) -> Column:
    if op not in OPS:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(OPS[op](a, F.lit(b)), F.lit(False))


def metrics_frame(logs: DataFrame, as_of: str, minutes: int, baseline_minutes: int, env=None) -> DataFrame:
    """now_*, previous_* and baseline_* metrics per (service, env) in windows that end at `as_of`."""
    at = lambda m: str(datetime.fromisoformat(as_of) - timedelta(minutes=m))
    spans = {"now": (at(minutes), as_of), "previous": (at(2 * minutes), at(minutes)), "baseline": (at(minutes + baseline_minutes), at(minutes))}
    when = lambda t: F.lit(t).cast("timestamp")
    inside = lambda s, e: (F.col("ts") >= when(s)) & (F.col("ts") < when(e))
    # One scan and one shuffle: a row goes to each window that holds it, and windows become columns after the aggregate.
    first = min(s for s, _ in spans.values())
    span = F.explode(F.array_compact(F.array(*[F.when(inside(s, e), F.lit(name)) for name, (s, e) in spans.items()]))).alias("span")
    rows = logs.filter(inside(first, as_of) & env_matches(env)).select("*", span)
    end = F.when(F.col("span") == "now", when(as_of)).otherwise(when(at(minutes)))
    m = rows.groupBy("service", "env", "span").agg(*measures(end))
    out = m.groupBy("service", "env").agg(*[F.max(F.when(F.col("span") == name, F.col(c).cast("double"))).alias(f"{name}_{c}") for name in spans for c in METRICS])
    # A silent window has counts of nothing and a heartbeat of its whole length.
    fill = {f"{n}_{c}": 0.0 for n in spans for c in COUNTS} | {"now_heartbeat": minutes * 60.0}
    return out.fillna(fill)


def threshold(leaf: dict) -> Column:
    """WAT-2."""
    return compare(F.col(f"now_{leaf['metric']}"), leaf["op"], leaf["value"])


def relative(leaf: dict) -> Column:
    """WAT-3: against a multiple of the baseline; without one, or at zero, never."""
    base = F.col(f"baseline_{leaf['metric']}")
    return F.coalesce(base != 0, F.lit(False)) & F.coalesce(OPS[leaf["op"]](F.col(f"now_{leaf['metric']}"), base * leaf["multiple"]), F.lit(False))


def delta(leaf: dict, scale: float = 1.0) -> Column:
    """WAT-4: percent change against the window before; `scale` evens unequal windows for counts."""
    before = F.col(f"previous_{leaf['metric']}") * (scale if leaf["metric"] in COUNTS else 1.0)
    change = F.abs(F.col(f"now_{leaf['metric']}") - before) * 100 / F.nullif(before, F.lit(0.0))
    return F.coalesce(change, F.lit(-1.0)) >= leaf["percent"] if leaf.get("op", "gte") == "gte" else compare(change, leaf["op"], leaf["percent"])


def count_leaf(leaf: dict) -> Column:
    """WAT-5: over columns that `count_frame` adds, named by the leaf."""
    return compare(F.coalesce(F.col(leaf["name"]), F.lit(0)), leaf["op"], leaf["value"])


LEAVES = {"threshold": threshold, "relative": relative, "delta": delta, "count": count_leaf}


def evaluate_condition(tree: dict | str) -> Column:
    """WAT-1: all / any / not over leaves, as one column."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    for key, join in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if key in tree:
            return reduce(join, [evaluate_condition(t) for t in tree[key]])
    if "not" in tree:
        return ~evaluate_condition(tree["not"])
    if tree.get("type") not in LEAVES:
        raise ValueError(f"unknown condition {tree!r}")
    return LEAVES[tree["type"]](tree)


def evaluate_watches(frame: DataFrame, watches: list[dict]) -> DataFrame:
    """(watch_id, service, env, breached) for every rule and every row in its scope.

    Rules are a driver-side list, each tree parsed once; they become one array
    of conditions over the frame, so all rules cost one pass.
    """
    scope = lambda w, c: F.lit(True) if not w.get(c) else F.lower(c) == w[c].lower()
    rules = [F.struct(F.lit(w["id"]).alias("watch_id"), (scope(w, "service") & scope(w, "env")).alias("in_scope"), evaluate_condition(w["condition"]).alias("breached")) for w in watches]
    each = frame.select("service", "env", F.explode(F.array(*rules)).alias("r"))
    return each.filter("r.in_scope").select("r.watch_id", "service", "env", "r.breached")


def count_frame(logs: DataFrame, as_of: str, name: str, minutes: int = 60, field: str | None = None, level=None, service=None) -> DataFrame:
    """WAT-5: rows, or distinct values of a field, per (service, env) in the window."""
    end = F.lit(as_of).cast("timestamp")
    rows = logs.filter((F.col("ts") >= end - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") < end))
    if level:
        rows = rows.filter(F.col("level") == level.lower())
    if service:
        rows = rows.filter(F.lower("service") == service.lower())
    value = F.countDistinct(F.nullif(F.col(field).cast("string"), F.lit(""))) if field else F.count("*")
    return rows.groupBy("service", "env").agg(value.alias(name))


def baseline(logs: DataFrame, start: str, end: str) -> DataFrame:
    """WAT-6: the metrics of a window with its error classes and mean duration per path."""
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    rows = logs.filter(inside)
    classes = rows.filter(is_error() & (F.coalesce("error_class", F.lit("")) != "")).groupBy("service", "env").agg(F.array_join(F.sort_array(F.collect_set("error_class")), ",").alias("error_classes"))
    paths = rows.filter(F.col("duration_ms") > 0).groupBy("service", "env", "path").agg(F.round(F.sum("duration_ms") / F.count("*"), 4).alias("avg_ms"))
    paths = paths.groupBy("service", "env").agg(F.sort_array(F.collect_list(F.struct("path", "avg_ms"))).alias("endpoints"))
    return measure(logs, start, end).join(classes, ["service", "env"], "left").join(paths, ["service", "env"], "left")


def breach_runs(runs: DataFrame, min_consecutive: int) -> DataFrame:
    """WAT-7: runs (watch_id, at, breached) with their place in a streak; alert on the run that reaches the minimum.

    A task sees a day of a rule at most: the streak that a day ends with is one
    row, and goes over to the next day. Runs told apart by plain numbers instead
    of times are one day.
    """
    timed = dict(runs.dtypes)["at"] in ("timestamp", "timestamp_ntz", "date")
    hit, calm = F.when(F.col("breached"), 1).otherwise(0), F.when(F.col("breached"), 0).otherwise(1)
    runs = runs.withColumn("day", F.to_date("at") if timed else F.lit(0))
    today = Window.partitionBy("watch_id", "day")
    runs = runs.withColumn("island", F.sum(calm).over(today.orderBy("at")))
    runs = runs.withColumn("streak", F.sum(hit).over(Window.partitionBy("watch_id", "day", "island").orderBy("at")))
    # The streak at a day's end, and whether the whole day was one.
    days = runs.groupBy("watch_id", "day").agg(F.max_by("streak", F.struct("at", "island", "streak")).alias("tail"), F.max("island").alias("calm"))
    in_days = Window.partitionBy("watch_id").orderBy("day")
    days = days.withColumn("since", F.sum(F.when(F.col("calm") > 0, 1).otherwise(0)).over(in_days))
    days = days.withColumn("end", F.sum("tail").over(Window.partitionBy("watch_id", "since").orderBy("day")))
    carried = days.select("watch_id", "day", F.coalesce(F.lag("end").over(in_days), F.lit(0)).alias("carried"))
    runs = runs.join(carried, ["watch_id", "day"]).withColumn("consecutive", F.col("streak") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0))
    return runs.withColumn("alert", F.col("breached") & (F.col("consecutive") == min_consecutive)).drop("island", "day", "streak", "carried")


def auto_resolve(watches: DataFrame, near: float = 0.10) -> DataFrame:
    """WAT-8: triggered rules whose metric is within 10 % of its baseline, or whose tree no longer breaches."""
    close = F.coalesce((F.col("baseline") != 0) & (F.abs(F.col("value") - F.col("baseline")) / F.abs("baseline") <= near), F.lit(False))
    calm = F.when(F.col("compound"), ~F.col("breached")).otherwise(close)
    return watches.withColumn("status", F.when((F.col("status") == "triggered") & calm, "resolved").otherwise(F.col("status")))


def expire_watches(watches: DataFrame, as_of: str) -> DataFrame:
    """WAT-9."""
    past = (F.col("status") == "active") & (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    return watches.withColumn("status", F.when(past, "expired").otherwise(F.col("status")))


def evidence(logs: DataFrame, start: str, end: str, base_start: str, service: str) -> DataFrame:
    """WAT-10: (part, key, n, detail) of a window against the one before: error classes, slower endpoints, files, traces."""
    rows = logs.filter(F.lower("service") == service.lower())
    inside = lambda a, b: (F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp"))
    now, before = rows.filter(inside(start, end)), rows.filter(inside(base_start, start))
    errors = now.filter(is_error())
    known = before.filter(is_error()).select("error_class").distinct().withColumn("known", F.lit(True))
    classes = errors.groupBy("error_class").agg(F.count("*").alias("n")).join(known, "error_class", "left")
    classes = classes.select(F.lit("error_class").alias("part"), F.col("error_class").alias("key"), "n", F.when(F.col("known"), "known").otherwise("new").alias("detail"))
    mean = lambda df, name: df.filter(F.col("duration_ms") > 0).groupBy("path").agg((F.sum("duration_ms") / F.count("*")).alias(name), F.count("*").alias(f"n_{name}"))
    slower = mean(now, "a").join(mean(before, "b"), "path").filter(F.col("a") > 1.10 * F.col("b"))
    slower = slower.select(F.lit("endpoint").alias("part"), F.col("path").alias("key"), F.col("n_a").alias("n"), F.round((F.col("a") - F.col("b")) * 100 / F.col("b"), 1).cast("string").alias("detail"))
    by = lambda c, part: errors.filter(F.coalesce(c, F.lit("")) != "").groupBy(F.lit(part).alias("part"), F.col(c).alias("key")).agg(F.count("*").alias("n"), F.lit("").alias("detail"))
    return classes.union(slower).union(by("source_file", "file")).union(by("trace_id", "trace"))


def evidence_bundle(logs: DataFrame, watch: dict, value: float, start: str, end: str, base_start: str, newest: int = 20, longest: int = 200) -> DataFrame:
    """WAT-10 in full: (part, key, n, detail) of `evidence`, then the newest rows, the metric against its baseline and the timeline.

    watch: service, metric and created_at; value: what the alert measured. The
    baseline is the metric over [base_start, start), captured at start.
    """
    parts = evidence(logs, start, end, base_start, watch["service"])
    rows = logs.filter((F.lower("service") == watch["service"].lower()) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    recent = rows.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    recent = recent.select(F.lit("row").alias("part"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"), F.concat_ws(" ", "level", F.substring("message", 1, longest)).alias("detail"))
    base = measure(logs.filter(F.lower("service") == watch["service"].lower()), base_start, start, keys=("service",)).agg(F.max(F.col(watch["metric"]).cast("double")).alias("b"))
    percent = F.when(F.coalesce("b", F.lit(0.0)) != 0, F.round((F.lit(float(value)) - F.col("b")) * 100 / F.col("b"), 2))
    said = F.concat_ws(" ", F.lit("baseline"), F.round("b", 4).cast("string"), F.lit("now"), F.lit(str(float(value))), F.concat(percent.cast("string"), F.lit("%")))
    diff = base.select(F.lit("baseline").alias("part"), F.lit(watch["metric"]).alias("key"), F.lit(1).cast("long").alias("n"), said.alias("detail"))
    steps = ((watch["created_at"], "watch_created"), (start, "baseline_captured"), (end, f"alert_triggered: {watch['metric']} = {value:.4f}"))
    timeline = base.select(F.explode(F.array(*[F.struct(F.lit("timeline").alias("part"), F.lit(at).alias("key"), F.lit(i).cast("long").alias("n"), F.lit(what).alias("detail")) for i, (at, what) in enumerate(steps)])).alias("s")).select("s.*")
    return parts.union(recent).union(diff).union(timeline)


def service_rows(logs: DataFrame, service: str, start: str, end: str, limit: int = 20) -> DataFrame:
    """WAT-16: the newest rows of a service in a window, errors before others."""
    rows = logs.filter((F.lower("service") == service.lower()) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.orderBy(F.desc(is_error()), F.desc("ts"), F.desc("id")).limit(limit).select("id", "ts", "level", "error_class", "message")


def default_watches(logs: DataFrame, watches: DataFrame) -> DataFrame:
    """WAT-11: an error-rate and a heartbeat rule for every (service, env) without a rule."""
    bare = logs.select("service", "env").distinct().join(watches.select("service", "env"), ["service", "env"], "left_anti")
    rules = [("error_rate", "gt", 0.05, 5, 2), ("heartbeat", "gt", 900.0, 20, 1)]
    rule = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("metric", "op", "value", "window_min", "min_consecutive"), r, strict=True)]) for r in rules])).alias("r")
    return bare.select("service", "env", rule).select("service", "env", "r.*")


def deploy_watches(deploys: DataFrame, watches: DataFrame) -> DataFrame:
    """WAT-12: for each new (version, service, env) a rule that lives 24 hours."""
    new = deploys.join(watches.select("version", "service", "env"), ["version", "service", "env"], "left_anti")
    tree = json.dumps({"any": [{"type": "threshold", "metric": "error_rate", "op": "gt", "value": 0.05}, {"type": "relative", "metric": "error_rate", "op": "gt", "multiple": 2}]})
    return new.select("version", "service", "env", F.lit(tree).alias("condition"), (F.col("first_seen") + F.make_dt_interval(hours=F.lit(24))).alias("expires_at"))


def watch_status(watches: DataFrame, runs: DataFrame, alerts: DataFrame, status=None) -> DataFrame:
    """WAT-13: rules with how many runs and alerts they have."""
    if status:
        watches = watches.filter(F.col("status") == status)
    n = lambda df, c: df.groupBy("watch_id").agg(F.count("*").alias(c))
    return watches.join(n(runs, "runs"), "watch_id", "left").join(n(alerts, "alerts"), "watch_id", "left").fillna({"runs": 0, "alerts": 0})


def alert_status(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """WAT-15: the newest action on an alert is its status; none leaves it pending."""
    last = actions.groupBy("alert_id").agg(F.max_by("action", F.struct("at", "action")).alias("status"))
    return alerts.drop("status").join(last, "alert_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def list_alerts(alerts: DataFrame, watches: DataFrame, status=None, service=None, env=None) -> DataFrame:
    """WAT-14: alerts by status and by their rule's service and environment."""
    scope = watches
    if service:
        scope = scope.filter(F.lower("service") == service.lower())
    if env:
        scope = scope.filter(F.lower("env") == env.lower())
    found = alerts.join(scope.select("watch_id"), "watch_id", "left_semi")
    return found.filter(F.col("status") == status) if status else found


def pending_count(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'pending'").agg(F.count("*").alias("n"))


def investigate_service(logs: DataFrame, service: str, start: str, end: str) -> DataFrame:
    """WAT-16: (part, key, value) of a service's metrics and error classes in a window."""
    rows = logs.filter(F.lower("service") == service.lower())
    m = measure(rows, start, end, keys=("service",))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in METRICS])
    metrics = m.select(F.explode(pairs).alias("p")).select(F.lit("metric").alias("part"), "p.key", "p.value")
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    classes = rows.filter(inside & is_error()).groupBy(F.lit("error_class").alias("part"), F.col("error_class").alias("key")).agg(F.count("*").cast("double").alias("value"))
    return metrics.union(classes)


def run_history(logs: DataFrame, minutes: int, least_errors: int) -> DataFrame:
    """Runs of a rule "at least so many errors" per service and window: what a scheduler would have recorded."""
    at = F.window("ts", f"{minutes} minutes")["start"]
    return logs.groupBy(F.concat(F.lit("watch-"), "service").alias("watch_id"), "service", at.alias("at")).agg((one(is_error()) >= least_errors).alias("breached"))
