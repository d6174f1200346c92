"""ERR: error groups, their life, and whom they hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import body
from .predicates import env_matches, is_critical, is_error, same
from .search import clamp


def error_groups(logs: DataFrame) -> DataFrame:
    """ERR-1: error rows folded by (fingerprint, env); what describes a group is its first row's (its line too, where rows have one)."""
    rows = logs.filter(is_error() & (F.col("error_fingerprint") != ""))
    line = [c for c in logs.columns if c == "source_line"]
    first = F.min_by(F.struct("service", "error_class", F.substring("message", 1, 500).alias("message"), "source_file", *line), F.struct("ts", "id"))
    g = rows.groupBy(F.col("error_fingerprint").alias("fingerprint"), "env").agg(
        first.alias("first"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max("id").alias("last_log_id")
    )
    return g.select("fingerprint", "env", "first.*", "first_seen", "last_seen", "occurrences", "last_log_id", F.lit("unresolved").alias("status"))


def seen_in_envs(groups: DataFrame) -> DataFrame:
    """ERR-2: groups with every environment their fingerprint was seen in."""
    envs = groups.groupBy("fingerprint").agg(F.sort_array(F.collect_set("env")).alias("seen_in_envs"))
    return groups.join(envs, "fingerprint")


def lifecycle_events(logs: DataFrame, actions: DataFrame) -> DataFrame:
    """ERR-3: the real transitions of every group, (fingerprint, env, at, event).

    Occurrences and actions (fingerprint, env, at, action) are one sequence per
    group. An action counts if it changes the status; an occurrence counts when
    the last status was resolved, and reopens. Occurrences between two actions
    can only matter once, so only the first after each action stays, by an
    aggregate: the windows see a group's actions and one row after each.
    """
    occur = logs.filter(is_error() & (F.col("error_fingerprint") != "")).select(F.col("error_fingerprint").alias("fingerprint"), "env", F.col("ts").alias("at"))
    acts = actions.select("fingerprint", "env", "at", F.col("action").alias("what"))
    times = acts.groupBy("fingerprint", "env").agg(F.collect_list("at").alias("times"))
    after = F.size(F.filter("times", lambda t: t < F.col("at"))).alias("after")
    occur = occur.join(times, ["fingerprint", "env"]).groupBy("fingerprint", "env", after).agg(F.min("at").alias("at")).select("fingerprint", "env", "at", F.lit("occurred").alias("what"))
    w = Window.partitionBy("fingerprint", "env").orderBy("at", F.when(F.col("what") == "occurred", 0).otherwise(1), "what")
    every = occur.unionByName(acts).withColumn("before", F.lag("what").over(w)).filter((F.col("what") != "occurred") | (F.col("before") != "occurred"))
    # What the status is before each event: only an action or a reopening sets it.
    last = F.last(F.when(F.col("what") != "occurred", F.col("what")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    since = F.last(F.when(F.col("what") != "occurred", F.col("at")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seq = every.withColumns({"last": last, "since": since})
    reopened = F.max(F.when((F.col("what") == "occurred") & (F.col("last") == "resolved"), 1).otherwise(0)).over(Window.partitionBy("fingerprint", "env", "since").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    seq = seq.withColumn("status", F.when(F.coalesce(reopened, F.lit(0)) == 1, "reopened").otherwise(F.coalesce("last", F.lit("unresolved"))))
    event = F.when((F.col("what") == "occurred") & (F.col("status") == "resolved"), "reopened").when((F.col("what") != "occurred") & (F.col("what") != F.col("status")) & ~((F.col("what") == "reopened") & (F.col("status") == "unresolved")), F.col("what"))
    return seq.select("fingerprint", "env", "at", event.alias("event")).filter("event is not null")


def with_status(groups: DataFrame, events: DataFrame) -> DataFrame:
    """ERR-3: groups with the status their last transition left and how often they reopened."""
    state = events.groupBy("fingerprint", "env").agg(F.max_by("event", F.struct("at", "event")).alias("event"), F.sum(F.when(F.col("event") == "reopened", 1).otherwise(0)).alias("reopened"))
    status = F.when(F.col("event").isin("resolved", "ignored"), F.col("event")).otherwise("unresolved")
    return groups.drop("status").join(state, ["fingerprint", "env"], "left").withColumn("status", status).withColumn("reopened", F.coalesce("reopened", F.lit(0))).drop("event")


def list_groups(groups: DataFrame, status=None, service=None, env=None, since=None, active_since=None, sort_by="last_seen", limit=50, offset=0) -> DataFrame:
    """ERR-4: `since` bounds the first sighting, `active_since` the last."""
    if status:
        groups = groups.filter(F.col("status") == status)
    if service:
        groups = groups.filter(same("service", service))
    if env:
        groups = groups.filter(F.lower("env") == env.lower())
    if since:
        groups = groups.filter(F.col("first_seen") >= F.lit(since).cast("timestamp"))
    if active_since:
        groups = groups.filter(F.col("last_seen") >= F.lit(active_since).cast("timestamp"))
    return groups.orderBy(F.desc(sort_by), "fingerprint", "env").offset(offset).limit(clamp(limit, 50, 500))


def count_groups(groups: DataFrame, status: str, env=None) -> DataFrame:
    """ERR-5."""
    g = groups.filter(F.col("status") == status)
    return (g.filter(F.col("env") == env) if env else g).agg(F.count("*").alias("n"))


def get_group(groups: DataFrame, fingerprint: str, env: str | None = None) -> DataFrame:
    """ERR-6: the exact environment, or the one seen last."""
    g = groups.filter(F.col("fingerprint") == fingerprint)
    return g.filter(F.col("env") == env) if env is not None else g.orderBy(F.desc("last_seen"), "env").limit(1)


def newest_group_each(groups: DataFrame) -> DataFrame:
    """ERR-6 for every fingerprint at once: the environment seen last."""
    return groups.groupBy("fingerprint").agg(F.max_by("env", F.struct("last_seen", "env")).alias("env"), F.max("last_seen").alias("last_seen"))


def group_events(events: DataFrame, fingerprint: str, env: str, limit=20) -> DataFrame:
    """ERR-7."""
    return events.filter((F.col("fingerprint") == fingerprint) & (F.col("env") == env)).orderBy(F.desc("at"), "event").limit(clamp(limit, 20, 500))


def new_errors(groups: DataFrame, since: str, limit=50) -> DataFrame:
    """ERR-8."""
    return list_groups(groups, since=since, sort_by="first_seen", limit=limit)


def error_impacts(logs: DataFrame) -> DataFrame:
    """ERR-9: per (fingerprint, env, user); rows without a user are skipped."""
    rows = logs.filter(is_error() & (F.col("error_fingerprint") != "") & (F.coalesce("user_id", F.lit("")) != ""))
    last = F.struct("ts", "id")
    return rows.groupBy(F.col("error_fingerprint").alias("fingerprint"), "env", "user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.max_by(body.part(body.is_variant(logs), "$.metadata"), last).alias("context"), F.max_by("id", last).alias("last_log_id")
    )


def impact_scores(impacts: DataFrame, as_of: str) -> DataFrame:
    """ERR-10: users x log2(occurrences + 1) x recency, per group and environment."""
    g = impacts.groupBy("fingerprint", "env").agg(F.count("*").alias("users"), F.sum("occurrences").alias("occurrences"), F.max("last_seen").alias("last_seen"))
    age = F.timestamp_diff("SECOND", F.col("last_seen"), F.lit(as_of).cast("timestamp"))
    recency = F.when(age < 3600, 1.0).when(age < 86400, 0.8).when(age < 7 * 86400, 0.5).otherwise(0.2)
    return g.withColumn("score", F.round(F.col("users") * F.log2(F.col("occurrences") + 1) * recency, 2))


def common_traits(impacts: DataFrame, newest=100, least=0.1) -> DataFrame:
    """ERR-11: (fingerprint, env, key, value, share) over the newest contexts of each group."""
    w = Window.partitionBy("fingerprint", "env").orderBy(F.desc("last_seen"), "user_id")
    rows = impacts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= newest)
    total = rows.groupBy("fingerprint", "env").agg(F.count("*").alias("total"))
    each = rows.select("fingerprint", "env", F.explode(F.from_json("context", "map<string,string>")).alias("key", "value"))
    counted = each.groupBy("fingerprint", "env", "key", "value").agg(F.count("*").alias("n")).join(total, ["fingerprint", "env"])
    return counted.filter(F.col("n") >= least * F.col("total")).select("fingerprint", "env", "key", "value", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def traits_map(traits: DataFrame) -> DataFrame:
    """Traits as the groups' common_context: a map of key to a map of value to share."""
    by_key = traits.groupBy("fingerprint", "env", "key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "share")))).alias("shares"))
    return by_key.groupBy("fingerprint", "env").agg(F.map_from_entries(F.collect_list(F.struct("key", "shares"))).alias("common_context"))


def impact(impacts: DataFrame, as_of: str) -> DataFrame:
    """ERR-12: per fingerprint over all environments, with the best-scoring one."""
    s = impact_scores(impacts, as_of)
    users = impacts.groupBy("fingerprint").agg(F.countDistinct("user_id").alias("users"), F.sum("occurrences").alias("occurrences"))
    return users.join(s.groupBy("fingerprint").agg(F.max_by("env", F.struct("score", "env")).alias("env"), F.max("score").alias("score")), "fingerprint")


def impact_with_traits(impacts: DataFrame, as_of: str, newest=100, least=0.1) -> DataFrame:
    """ERR-12 in full: with the traits of the best-scoring environment as common_context."""
    return impact(impacts, as_of).join(traits_map(common_traits(impacts, newest, least)), ["fingerprint", "env"], "left")


def affected_users(impacts: DataFrame, fingerprint: str, env=None, limit=20) -> DataFrame:
    """ERR-13."""
    i = impacts.filter(F.col("fingerprint") == fingerprint).filter(env_matches(env))
    return i.groupBy("user_id").agg(F.sum("occurrences").alias("occurrences"), F.max("last_seen").alias("last_seen")).orderBy(F.desc("occurrences"), "user_id").limit(limit)


def user_errors(impacts: DataFrame, groups: DataFrame, user: str, since=None) -> DataFrame:
    """ERR-14: what one user hit; groups that are gone count as unresolved."""
    i = impacts.filter(F.col("user_id") == user)
    if since:
        i = i.filter(F.col("last_seen") >= F.lit(since).cast("timestamp"))
    g = groups.select("fingerprint", "env", "error_class", "status")
    return i.join(g, ["fingerprint", "env"], "left").withColumn("status", F.coalesce("status", F.lit("unresolved"))).select("fingerprint", "env", "error_class", "status", "occurrences", "last_seen")


RANKS = {"impact": "score", "users": "users", "occurrences": "occurrences", "last_seen": "last_seen"}


def rank_by_impact(impacts: DataFrame, groups: DataFrame, as_of: str, status=None, service=None, limit=10, top_users=3, since=None, sort_by="impact", critical: list[str] | None = None) -> DataFrame:
    """ERR-15: groups by score (or RANKS), each with its users of most occurrences; of the best `limit`, those of a critical path come first.

    `since` bounds the last sighting. With `critical` patterns there is a column of that name.
    """
    if critical:
        # Who pays comes first, but only among what ranks high.
        top = rank_by_impact(impacts, groups, as_of, status, service, limit, top_users, since, sort_by)
        paths = groups.select("fingerprint", "env", is_critical(critical, "service", "message", "error_class").alias("critical"))
        return top.join(paths, ["fingerprint", "env"]).orderBy(F.desc("critical"), F.desc(RANKS[sort_by]), "fingerprint", "env")
    g = groups.select("fingerprint", "env", "service", "error_class", "status", "last_seen")
    if status:
        g = g.filter(F.col("status") == status)
    if service:
        g = g.filter(same("service", service))
    if since:
        g = g.filter(F.col("last_seen") >= F.lit(since).cast("timestamp"))
    g = g.drop("last_seen")
    w = Window.partitionBy("fingerprint", "env").orderBy(F.desc("occurrences"), "user_id")
    users = impacts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top_users)
    users = users.groupBy("fingerprint", "env").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "user_id"))), lambda u: u["user_id"]), ",").alias("top_users"))
    ranked = impact_scores(impacts, as_of).join(g, ["fingerprint", "env"]).join(users, ["fingerprint", "env"])
    return ranked.orderBy(F.desc(RANKS[sort_by]), "fingerprint", "env").limit(limit)


def recent_occurrences(logs: DataFrame, groups: DataFrame, n=5, hours=24) -> DataFrame:
    """ERR-16: the last rows of each group within the day up to its last sighting."""
    g = groups.select(F.col("fingerprint").alias("error_fingerprint"), "env", "last_seen")
    rows = logs.filter(is_error()).join(g, ["error_fingerprint", "env"]).filter(F.timestamp_diff("SECOND", F.col("ts"), F.col("last_seen")) <= hours * 3600)
    w = Window.partitionBy("error_fingerprint", "env").orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def error_detail(logs: DataFrame, groups: DataFrame, events: DataFrame, fingerprint: str, env: str | None = None, n_events=10, n_rows=5) -> DataFrame:
    """ERR-16 in one answer: (part, n, at, id, what) of the group, its newest life events and its last occurrences; without an environment that seen last."""
    group = get_group(groups, fingerprint, env)
    key = F.broadcast(group.select("fingerprint", "env"))  # one row
    numbered = lambda df, order: df.withColumn("n", F.row_number().over(Window.partitionBy("fingerprint", "env").orderBy(*order)))
    life = numbered(events.join(key, ["fingerprint", "env"]), (F.desc("at"), "event")).filter(F.col("n") <= n_events)
    recent = recent_occurrences(logs.join(key.withColumnRenamed("fingerprint", "error_fingerprint"), ["error_fingerprint", "env"]), group, n_rows)
    part = lambda df, name, n, at, id_, what: df.select(F.lit(name).alias("part"), n.cast("int").alias("n"), F.col(at).alias("at"), id_.cast("long").alias("id"), what.alias("what"))
    one = F.concat_ws(" ", "service", "error_class", "status", "occurrences")
    return part(group, "group", F.lit(0), "last_seen", F.col("last_log_id"), one).union(part(life, "event", F.col("n"), "at", F.lit(None), F.col("event"))).union(part(recent, "occurrence", F.col("n"), "ts", F.col("id"), F.col("message")))


def resolve_trace_anchor(logs: DataFrame, trace_id: str) -> DataFrame:
    """ERR-17: a trace's first error row, else its last row."""
    rows = logs.filter(F.col("trace_id") == trace_id)
    return rows.orderBy(F.desc(is_error()), F.when(is_error(), F.unix_millis("ts")).otherwise(-F.unix_millis("ts")), "id").limit(1)


def investigate_error(logs: DataFrame, groups: DataFrame, log_id: int | None = None, trace_id: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """ERR-17: (part, id, ts, level, service, message) of the anchor, its trace and its neighbours.

    The anchor is a row, or what a trace resolves to. With `fields` of the body
    (of an exception, say) those the anchor has follow, a part of each name, and
    so does its group: status in place of a level, occurrences in that of an id.
    """
    from .search import log_context

    cols = ("id", "ts", "level", "service", "message")
    anchor = logs.filter(F.col("id") == log_id) if log_id is not None else resolve_trace_anchor(logs, trace_id)
    trace = anchor.select("trace_id", F.col("ts").alias("at")).filter("trace_id <> ''")
    same_trace = logs.join(F.broadcast(trace), "trace_id").filter(F.abs(F.timestamp_diff("SECOND", F.col("at"), F.col("ts"))) <= 3600).orderBy("ts", "id").limit(30)
    near = log_context(logs, anchor, 5, 5).filter("side <> 'anchor'")
    part = lambda df, name: df.select((F.lit(name) if isinstance(name, str) else name).alias("part"), *cols)
    out = part(anchor, "anchor").union(part(same_trace, "trace")).union(part(near, F.col("side")))
    if not fields:
        return out
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("part"), F.coalesce(F.get_json_object("body", f"$.{f}"), F.get_json_object("body", f"$.metadata.{f}")).alias("message")) for f in fields])).alias("f")
    body = anchor.select("id", "ts", "level", "service", named).select("f.part", "id", "ts", "level", "service", "f.message").filter("message is not null")
    of_group = groups.join(F.broadcast(anchor.select(F.col("error_fingerprint").alias("fingerprint"), "env")), ["fingerprint", "env"])  # one row
    return out.union(body).union(of_group.select(F.lit("group"), "occurrences", "last_seen", "status", "service", "fingerprint"))


def user_timeline(logs: DataFrame, user=None, tenant=None, since=None, limit=50) -> DataFrame:
    """ERR-18: what one person or tenant hit, newest first, with the number of errors in all."""
    rows = logs.filter(F.col("user_id") == user) if user else logs.filter(F.col("tenant_id") == tenant)
    if since:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    errors = rows.agg(F.sum(F.when(is_error(), 1).otherwise(0)).alias("errors"))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit).crossJoin(F.broadcast(errors))


def prune_groups(groups: DataFrame, impacts: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """ERR-19: groups seen since the cutoff, and the impacts that still have a group."""
    kept = groups.filter(F.col("last_seen") >= F.lit(cutoff).cast("timestamp"))
    return kept, impacts.join(kept.select("fingerprint", "env"), ["fingerprint", "env"], "left_semi")
