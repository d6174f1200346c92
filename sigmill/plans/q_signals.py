"""Queries of errors, traces, deploys, code risk, health, servers and captures, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import body
from ..operators import captures as cap
from ..operators import code_risk as cod
from ..operators import deploys as dep
from ..operators import errors as err
from ..operators import health as hlt
from ..operators import traces as trc
from ..operators.aggregates import metadata_keys
from ..operators.predicates import filter_logs, is_error
from .q_logs import ERR, GROUPS, plain
from .views import AS_OF, VIEWS, Book, logs, table, written

B = Book()
q = B.add

VIEWS["groups"] = VIEWS["logs"] + f""", f AS (SELECT error_fingerprint AS fingerprint, env, arg_min({{'service': service, 'error_class': error_class, 'message': left(message,500), 'source_file': source_file}}, (ts, id)) AS r,
 min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences, max(id) AS last_log_id FROM logs WHERE {ERR} AND error_fingerprint<>'' GROUP BY ALL),
groups AS (SELECT fingerprint, env, r.service AS service, r.error_class AS error_class, r.message AS message, r.source_file AS source_file, first_seen, last_seen, occurrences, last_log_id, 'unresolved' AS status FROM f)"""
VIEWS["impacts"] = VIEWS["groups"] + f""", impacts AS (SELECT error_fingerprint AS fingerprint, env, user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrences, arg_max(CAST(json_extract(body,'$.metadata') AS VARCHAR), (ts, id)) AS context, arg_max(id, (ts, id)) AS last_log_id FROM logs WHERE {ERR} AND error_fingerprint<>'' GROUP BY ALL)"""
RECENCY = f"CASE WHEN datediff('second', date_trunc('second', last_seen), TIMESTAMP '{AS_OF}') <= 3599 THEN 1.0 WHEN datediff('second', date_trunc('second', last_seen), TIMESTAMP '{AS_OF}') <= 86399 THEN 0.8 WHEN datediff('second', date_trunc('second', last_seen), TIMESTAMP '{AS_OF}') <= 604799 THEN 0.5 ELSE 0.2 END"
VIEWS["scores"] = VIEWS["impacts"] + f""", s0 AS (SELECT fingerprint, env, count(*) AS users, CAST(sum(occurrences) AS BIGINT) AS occurrences, max(last_seen) AS last_seen FROM impacts GROUP BY ALL),
scores AS (SELECT *, round(users*log2(occurrences+1)*{RECENCY},2) AS score FROM s0)"""
# Actions per group: one is resolved after three days, some are ignored after five.
VIEWS["acts"] = VIEWS["groups"] + """, acts AS (SELECT fingerprint, env, first_seen + INTERVAL 3 day AS "at", 'resolved' AS action FROM groups WHERE left(fingerprint,1) < '8'
 UNION ALL SELECT fingerprint, env, first_seen + INTERVAL 5 day, 'ignored' FROM groups WHERE left(fingerprint,1) IN ('e','f')),
reopens AS (SELECT a.fingerprint, a.env, min(l.ts) AS "at" FROM acts a JOIN logs l ON l.error_fingerprint=a.fingerprint AND l.env=a.env AND l.level IN ('error','fatal') AND l.ts > a."at" WHERE a.action='resolved' GROUP BY ALL),
evts AS (SELECT fingerprint, env, "at", action AS event FROM acts UNION ALL SELECT fingerprint, env, "at", 'reopened' FROM reopens)"""


def actions(groups):
    day = lambda n: F.col("first_seen") + F.make_dt_interval(days=F.lit(n))
    one = F.substring("fingerprint", 1, 1)
    part = lambda n, what: F.struct(day(n).alias("at"), F.lit(what).alias("action"))
    act = F.when(one < "8", part(3, "resolved")).when(one.isin("e", "f"), part(5, "ignored"))
    return groups.select("fingerprint", "env", act.alias("act")).filter("act is not null").select("fingerprint", "env", "act.*")


def groups_of(spark, d):
    rows = logs(spark, d)
    return rows, err.error_groups(rows)


def events_of(rows, groups):
    return err.lifecycle_events(rows, actions(groups))


def errors_of(spark, d):
    """What groups and their lives need of the error rows, made once: a row's fingerprint costs more than what reads it."""
    rows = logs(spark, d).filter(is_error() & (F.col("error_fingerprint") != ""))
    return written(rows.select("id", "ts", "service", "env", "level", "error_class", "source_file", "message", "error_fingerprint"))


def life_of(spark, d):
    """Error rows, their groups, and the events of these, each made once."""
    rows = errors_of(spark, d)
    groups = written(err.error_groups(rows))
    return rows, groups, written(err.lifecycle_events(rows, actions(groups)))


def impacts_of(spark, d):
    return err.error_impacts(logs(spark, d))


@q("err1_error_groups", "SELECT * FROM groups", ("groups",))
def _(spark, d):
    return plain(groups_of(spark, d)[1])


@q("err1_source_lines", f"SELECT error_fingerprint AS fingerprint, env, arg_min(id % 90, (ts, id)) AS source_line, arg_min(source_file, (ts, id)) AS source_file FROM (SELECT *, coalesce(source_file, '') AS sf FROM logs) WHERE {ERR} AND error_fingerprint<>'' AND sf<>'' GROUP BY ALL")
def _(spark, d):
    rows = logs(spark, d).filter("source_file <> ''").withColumn("source_line", F.col("id") % 90)
    return err.error_groups(rows).select("fingerprint", "env", "source_line", "source_file")


@q("err2_seen_in_envs", "SELECT g.fingerprint, g.env, e.seen_in_envs FROM groups g JOIN (SELECT fingerprint, array_to_string(list_sort(list(DISTINCT env)), ',') AS seen_in_envs FROM groups GROUP BY 1) e USING (fingerprint)", ("groups",))
def _(spark, d):
    return err.seen_in_envs(groups_of(spark, d)[1]).select("fingerprint", "env", F.array_join("seen_in_envs", ",").alias("seen_in_envs"))


@q("err3_lifecycle_events", "SELECT * FROM evts", ("acts",))
def _(spark, d):
    return plain(life_of(spark, d)[2])


@q("err3_group_status", ", st AS (SELECT fingerprint, env, arg_max(event, (\"at\", event)) AS e, CAST(count(*) FILTER (event='reopened') AS BIGINT) AS r FROM evts GROUP BY ALL) SELECT g.fingerprint, g.env, CASE WHEN e IN ('resolved','ignored') THEN e ELSE 'unresolved' END AS status, coalesce(r,0) AS reopened FROM groups g LEFT JOIN st USING (fingerprint, env)", ("acts",))
def _(spark, d):
    _, groups, events = life_of(spark, d)
    return err.with_status(groups, events).select("fingerprint", "env", "status", "reopened")


@q("err4_list_groups", "SELECT fingerprint, env, occurrences, last_seen FROM groups WHERE lower(service)='api' AND first_seen >= TIMESTAMP '2024-01-02' ORDER BY occurrences DESC, fingerprint, env LIMIT 30", ("groups",))
def _(spark, d):
    return plain(err.list_groups(groups_of(spark, d)[1], "unresolved", "API", since="2024-01-02", sort_by="occurrences", limit=30), "fingerprint", "env", "occurrences", "last_seen")


@q("err5_count_groups", "SELECT count(*) AS n FROM groups WHERE env='staging'", ("groups",))
def _(spark, d):
    return err.count_groups(groups_of(spark, d)[1], "unresolved", "staging")


@q("err6_get_group", "SELECT fingerprint, arg_max(env, (last_seen, env)) AS env, max(last_seen) AS last_seen FROM groups GROUP BY 1", ("groups",))
def _(spark, d):
    return plain(err.newest_group_each(groups_of(spark, d)[1]))


@q("err7_group_events", ", one AS (SELECT fingerprint, env FROM evts GROUP BY ALL ORDER BY count(*) DESC, fingerprint, env LIMIT 1) SELECT e.* FROM evts e JOIN one USING (fingerprint, env) ORDER BY \"at\" DESC, event LIMIT 20", ("acts",))
def _(spark, d):
    events = life_of(spark, d)[2]
    one = events.groupBy("fingerprint", "env").count().orderBy(F.desc("count"), "fingerprint", "env").limit(1).first()
    return plain(err.group_events(events, one["fingerprint"], one["env"]))


@q("err8_new_errors", "SELECT fingerprint, env, first_seen FROM groups WHERE first_seen >= TIMESTAMP '2024-01-20' ORDER BY first_seen DESC, fingerprint, env LIMIT 50", ("groups",))
def _(spark, d):
    return plain(err.new_errors(groups_of(spark, d)[1], "2024-01-20"), "fingerprint", "env", "first_seen")


@q("err9_error_impacts", "SELECT * FROM impacts", ("impacts",))
def _(spark, d):
    return plain(impacts_of(spark, d))


@q("err10_impact_scores", "SELECT * FROM scores", ("scores",))
def _(spark, d):
    return plain(err.impact_scores(impacts_of(spark, d), AS_OF))


@q("err11_common_traits", ", r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, env ORDER BY last_seen DESC, user_id) AS rn FROM impacts), n AS (SELECT * FROM r WHERE rn<=100), t AS (SELECT fingerprint, env, count(*) AS total FROM n GROUP BY ALL), c AS (SELECT fingerprint, env, 'k' AS key, json_extract_string(context,'$.k') AS value, count(*) AS m FROM n GROUP BY ALL) SELECT fingerprint, env, key, value, round(m::DOUBLE/total,4) AS share FROM c JOIN t USING (fingerprint, env) WHERE m >= 0.1*total", ("impacts",))
def _(spark, d):
    return err.common_traits(impacts_of(spark, d))


@q("err12_impact", "SELECT u.*, b.env, b.score FROM (SELECT fingerprint, count(DISTINCT user_id) AS users, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM impacts GROUP BY 1) u JOIN (SELECT fingerprint, arg_max(env, (score, env)) AS env, max(score) AS score FROM scores GROUP BY 1) b USING (fingerprint)", ("scores",))
def _(spark, d):
    return err.impact(impacts_of(spark, d), AS_OF)


@q(
    "err12_impact_with_traits",
    """, u AS (SELECT fingerprint, count(DISTINCT user_id) AS users, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM impacts GROUP BY 1), b AS (SELECT fingerprint, arg_max(env, (score, env)) AS env, max(score) AS score FROM scores GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, env ORDER BY last_seen DESC, user_id) AS rn FROM impacts), t0 AS (SELECT fingerprint, env, json_extract_string(context,'$.k') AS value, count(*) AS m FROM r WHERE rn<=100 GROUP BY ALL), t1 AS (SELECT *, sum(m) OVER (PARTITION BY fingerprint, env) AS total FROM t0), t AS (SELECT fingerprint, env, count(*) AS n_traits, round(max(m::DOUBLE/total), 4) AS largest FROM t1 WHERE m >= 0.1*total GROUP BY ALL)
SELECT u.*, b.env, b.score, coalesce(t.n_traits, 0) AS n_traits, t.largest FROM u JOIN b USING (fingerprint) LEFT JOIN t USING (fingerprint, env)""",
    ("scores",),
)
def _(spark, d):
    i = err.impact_with_traits(impacts_of(spark, d), AS_OF)
    shares = F.map_values(F.try_element_at("common_context", F.lit("k")))
    return i.select("fingerprint", "users", "occurrences", "env", "score", F.coalesce(F.cardinality(shares), F.lit(0)).cast("long").alias("n_traits"), F.array_max(shares).alias("largest"))


TOP = "SELECT fingerprint FROM impacts GROUP BY 1 ORDER BY sum(occurrences) DESC, fingerprint LIMIT 1"


def top_fingerprint(impacts):
    return impacts.groupBy("fingerprint").agg(F.sum("occurrences").alias("n")).orderBy(F.desc("n"), "fingerprint").first()[0]


@q("err13_affected_users", f"SELECT user_id, CAST(sum(occurrences) AS BIGINT) AS occurrences, max(last_seen) AS last_seen FROM impacts WHERE fingerprint=({TOP}) GROUP BY 1 ORDER BY occurrences DESC, user_id LIMIT 20", ("impacts",))
def _(spark, d):
    i = impacts_of(spark, d)
    return plain(err.affected_users(i, top_fingerprint(i)))


@q("err14_user_errors", "SELECT i.fingerprint, i.env, g.error_class, coalesce(g.status,'unresolved') AS status, i.occurrences, i.last_seen FROM impacts i LEFT JOIN groups g USING (fingerprint, env) WHERE user_id='user-42'", ("impacts",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return plain(err.user_errors(err.error_impacts(rows), groups, "user-42"))


@q("err15_rank_by_impact", ", w AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, env ORDER BY occurrences DESC, user_id) AS n FROM impacts), t AS (SELECT fingerprint, env, string_agg(user_id, ',' ORDER BY n) AS top_users FROM w WHERE n<=3 GROUP BY ALL) SELECT s.*, g.service, g.error_class, g.status, t.top_users FROM scores s JOIN groups g USING (fingerprint, env) JOIN t USING (fingerprint, env) ORDER BY score DESC, fingerprint, env LIMIT 10", ("scores",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return plain(err.rank_by_impact(err.error_impacts(rows), groups, AS_OF))


@q("err15_critical_first", ", t AS (SELECT s.fingerprint, s.env, s.score, s.users, contains(lower(g.service), 'bill') OR contains(lower(g.message), 'bill') OR contains(lower(g.error_class), 'bill') AS critical FROM scores s JOIN groups g USING (fingerprint, env) WHERE g.last_seen >= TIMESTAMP '2024-01-12' ORDER BY users DESC, fingerprint, env LIMIT 25) SELECT * FROM t", ("scores",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return err.rank_by_impact(err.error_impacts(rows), groups, AS_OF, "unresolved", limit=25, since="2024-01-12", sort_by="users", critical=["BILL"]).select("fingerprint", "env", "score", "users", "critical")


@q("err16_error_detail", f""", one AS (SELECT fingerprint, env FROM evts GROUP BY ALL ORDER BY count(*) DESC, fingerprint, env LIMIT 1), g AS (SELECT * FROM groups JOIN one USING (fingerprint, env)), l AS (SELECT l.*, row_number() OVER (ORDER BY l.ts DESC, l.id DESC) AS n FROM logs l JOIN g ON l.error_fingerprint=g.fingerprint AND l.env=g.env WHERE l.{ERR} AND epoch_us(g.last_seen)-epoch_us(l.ts) < 86401000000)
SELECT 'group' AS part, 0 AS n, last_seen AS "at", last_log_id AS id, concat_ws(' ', service, error_class, status, occurrences) AS what FROM g UNION ALL SELECT 'event', CAST(row_number() OVER (ORDER BY "at" DESC, event) AS INT), "at", NULL, event FROM evts JOIN one USING (fingerprint, env) UNION ALL SELECT 'occurrence', CAST(n AS INT), ts, id, message FROM l WHERE n<=5""", ("acts",))
def _(spark, d):
    rows, groups, events = life_of(spark, d)
    one = events.groupBy("fingerprint", "env").count().orderBy(F.desc("count"), "fingerprint", "env").limit(1).first()
    return plain(err.error_detail(rows, groups, events, one["fingerprint"], one["env"]))


@q("err16_recent_occurrences", f", r AS (SELECT l.error_fingerprint, l.env, l.id, row_number() OVER (PARTITION BY l.error_fingerprint, l.env ORDER BY l.ts DESC, l.id DESC) AS n FROM logs l JOIN groups g ON l.error_fingerprint=g.fingerprint AND l.env=g.env WHERE l.{ERR} AND epoch_us(g.last_seen)-epoch_us(l.ts) < 86401000000) SELECT error_fingerprint, env, id, CAST(n AS INT) AS n FROM r WHERE n<=5", ("groups",))
def _(spark, d):
    rows = errors_of(spark, d)
    return err.recent_occurrences(rows, err.error_groups(rows)).select("error_fingerprint", "env", "id", F.col("n").cast("int").alias("n"))


@q("err17_investigate_error", ", a AS (SELECT * FROM logs WHERE id=505), nb AS (SELECT l.*, CASE WHEN (l.ts,l.id) < (a.ts,a.id) THEN 'before' ELSE 'after' END AS side FROM logs l, a WHERE l.env=a.env AND l.id<>a.id AND abs(epoch_us(l.ts)-epoch_us(a.ts)) < 86401000000), nr AS (SELECT *, CASE side WHEN 'before' THEN row_number() OVER (PARTITION BY side ORDER BY ts DESC, id DESC) ELSE row_number() OVER (PARTITION BY side ORDER BY ts, id) END AS n FROM nb) SELECT 'anchor' AS part, id, ts, level, service, message FROM a UNION ALL (SELECT 'trace', l.id, l.ts, l.level, l.service, l.message FROM logs l, a WHERE l.trace_id=a.trace_id AND abs(epoch_us(l.ts)-epoch_us(a.ts)) < 3601000000 ORDER BY l.ts, l.id LIMIT 30) UNION ALL SELECT side, id, ts, level, service, message FROM nr WHERE n<=5")
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return plain(err.investigate_error(rows, groups, 505))


@q("err17_investigate_trace", f""", tr AS (SELECT trace_id FROM logs WHERE {ERR} GROUP BY 1 ORDER BY count(*) DESC, trace_id LIMIT 1), a AS (SELECT * FROM logs WHERE trace_id=(SELECT trace_id FROM tr) AND {ERR} ORDER BY ts, id LIMIT 1), nb AS (SELECT l.*, CASE WHEN (l.ts,l.id) < (a.ts,a.id) THEN 'before' ELSE 'after' END AS side FROM logs l, a WHERE l.env=a.env AND l.id<>a.id AND abs(epoch_us(l.ts)-epoch_us(a.ts)) < 86401000000),
nr AS (SELECT *, CASE side WHEN 'before' THEN row_number() OVER (PARTITION BY side ORDER BY ts DESC, id DESC) ELSE row_number() OVER (PARTITION BY side ORDER BY ts, id) END AS n FROM nb) SELECT 'anchor' AS part, id, ts, level, service, message FROM a UNION ALL (SELECT 'trace', l.id, l.ts, l.level, l.service, l.message FROM logs l, a WHERE l.trace_id=a.trace_id AND abs(epoch_us(l.ts)-epoch_us(a.ts)) < 3601000000 ORDER BY l.ts, l.id LIMIT 30)
UNION ALL SELECT side, id, ts, level, service, message FROM nr WHERE n<=5 UNION ALL SELECT 'k', id, ts, level, service, json_extract_string(body, '$.metadata.k') FROM a UNION ALL SELECT 'group', g.occurrences, g.last_seen, 'unresolved', g.service, g.fingerprint FROM groups g, a WHERE g.fingerprint=a.error_fingerprint AND g.env=a.env""", ("groups",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    busiest = rows.filter("level in ('error', 'fatal')").groupBy("trace_id").count().orderBy(F.desc("count"), "trace_id").first()[0]
    return plain(err.investigate_error(rows, groups, trace_id=busiest, fields=("exception", "k")))


@q("err18_user_timeline", f"SELECT id, ts, level, count(*) FILTER ({ERR}) OVER () AS errors FROM logs WHERE tenant_id='tenant-3' ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, d):
    return plain(err.user_timeline(logs(spark, d), tenant="tenant-3"), "id", "ts", "level", "errors")


@q("err19_prune_groups", "SELECT i.fingerprint, i.env, i.user_id FROM impacts i JOIN groups g USING (fingerprint, env) WHERE g.last_seen >= TIMESTAMP '2024-01-15'", ("impacts",))
def _(spark, d):
    rows, groups = groups_of(spark, d)
    return err.prune_groups(groups, err.error_impacts(rows), "2024-01-15")[1].select("fingerprint", "env", "user_id")




@q("trc1_trace_timeline", f"SELECT trace_id, id, service, level, (epoch_us(ts) // 1000) - (epoch_us(min(ts) OVER w) // 1000) AS elapsed_ms, (epoch_us(max(ts) OVER w) // 1000) - (epoch_us(min(ts) OVER w) // 1000) AS total_ms, bool_or({ERR}) OVER w AS has_errors, n AS n_services FROM logs JOIN (SELECT trace_id, count(DISTINCT service) AS n FROM logs GROUP BY 1) USING (trace_id) WINDOW w AS (PARTITION BY trace_id)")
def _(spark, d):
    return trc.trace_timeline(logs(spark, d))


@q("trc2_service_summary", f"SELECT trace_id, service, count(*) AS entries, count(*) FILTER ({ERR}) AS errors, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms FROM logs GROUP BY ALL")
def _(spark, d):
    return trc.trace_service_summary(logs(spark, d))


@q("trc3_trace_gaps", ", g AS (SELECT trace_id, id, service, lag(id) OVER w AS from_id, lag(service) OVER w AS from_service, (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000) AS gap_ms FROM logs WINDOW w AS (PARTITION BY trace_id ORDER BY ts, id)) SELECT trace_id, from_id, id, from_service, service, gap_ms FROM g WHERE gap_ms > 500 AND service <> from_service")
def _(spark, d):
    return trc.trace_gaps(logs(spark, d))


@q("trc4_first_error", f"SELECT trace_id, arg_min(id, (ts, id)) AS id, arg_min(service, (ts, id)) AS service, arg_min(message, (ts, id)) AS message FROM logs WHERE {ERR} GROUP BY 1")
def _(spark, d):
    return trc.trace_first_error(logs(spark, d))


@q("trc5_trace_context", ", p AS (SELECT trace_id, service, min(ts) AS a, max(ts) AS b FROM logs WHERE id % 20 < 5 GROUP BY ALL), n AS (SELECT p.trace_id AS of_trace, l.service, l.id, row_number() OVER (PARTITION BY p.trace_id, l.service ORDER BY l.ts, l.id) AS n FROM logs l JOIN p ON l.service=p.service AND l.trace_id<>p.trace_id AND (epoch_us(l.ts) // 1000) >= (epoch_us(p.a) // 1000)-60000 AND (epoch_us(l.ts) // 1000) <= (epoch_us(p.b) // 1000)+60000) SELECT of_trace, service, id, CAST(n AS INT) AS n FROM n WHERE n<=50")
def _(spark, d):
    rows = logs(spark, d)
    return trc.trace_context(rows, rows.filter("id % 20 < 5"), margin_s=60)


@q("trc6_trace_status", f"SELECT trace_id, count(*) AS spans, arg_min(span_id, (ts, id)) FILTER (parent_span_id IS NULL) AS root_span, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, min(ts) AS first_seen, max(ts) AS last_updated, (epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000) AS duration_ms, bool_or({ERR}) AS has_errors, 'partial' AS status FROM logs GROUP BY 1")
def _(spark, d):
    return plain(trc.trace_status(logs(spark, d)))


@q("trc7_stale_traces", ", t AS (SELECT trace_id, max(ts) AS u FROM logs GROUP BY 1) SELECT CASE WHEN u < TIMESTAMP '2024-01-20' - INTERVAL 30 second THEN 'timeout' ELSE 'partial' END AS status, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    return trc.mark_stale_traces(trc.trace_status(logs(spark, d)), "2024-01-20").groupBy("status").agg(F.count("*").alias("n"))


@q("trc8_recent_traces", ", t AS (SELECT trace_id, max(ts) AS last_updated FROM logs GROUP BY 1) SELECT *, (SELECT count(*) FROM t) AS total FROM t ORDER BY last_updated DESC, trace_id LIMIT 50")
def _(spark, d):
    return plain(trc.recent_traces(trc.trace_status(logs(spark, d))), "trace_id", "last_updated", "total")


DEP = ", deploys AS (SELECT version, service, env, min(ts) AS first_seen FROM logs GROUP BY ALL)"


@q("dep1_deploys", DEP + " SELECT * FROM deploys")
def _(spark, d):
    return plain(dep.deploys(logs(spark, d)))


@q("dep2_list_deploys", DEP + " SELECT * FROM deploys WHERE first_seen >= TIMESTAMP '2024-01-10' AND (env='' OR lower(env)='production') ORDER BY first_seen DESC, version, service, env LIMIT 10")
def _(spark, d):
    return plain(dep.list_deploys(dep.deploys(logs(spark, d)), "2024-01-10", env="production", limit=10))


def _side(c, name):
    return f"count(*) FILTER ({c}) AS logs_{name}, round(count(*) FILTER ({c} AND {ERR})::DOUBLE/nullif(count(*) FILTER ({c}),0),6) AS error_rate_{name}, round(sum(duration_ms) FILTER ({c} AND duration_ms>0)::DOUBLE/count(*) FILTER ({c} AND duration_ms>0),4) AS response_{name}"


@q("dep3_deploy_report", DEP + f", j AS (SELECT d.version AS version, l.service, l.env, l.level, l.duration_ms, (epoch_us(l.ts) // 1000)-(epoch_us(d.first_seen) // 1000) AS dt FROM logs l JOIN deploys d ON l.service=d.service AND l.env=d.env), r AS (SELECT version, service, env, {_side('dt >= 0 AND dt < 3600000*24', 'after')}, {_side('dt < 0 AND dt >= -86400000', 'before')} FROM j WHERE dt < 3600000*24 AND dt >= -86400000 GROUP BY ALL) SELECT *, CASE WHEN response_before>0 THEN round((response_after-response_before)*100/response_before,2) END AS response_delta FROM r")
def _(spark, d):
    rows = logs(spark, d)
    return dep.deploy_report(rows, dep.deploys(rows), after_hours=24)


VIEWS["entities"] = VIEWS["logs"] + f", entities AS (SELECT source_file AS file, service, count(*) AS errors, max(ts) AS last_error FROM logs WHERE {ERR} AND coalesce(source_file,'')<>'' GROUP BY ALL), inv AS (SELECT source_file AS file, service, count(*) AS investigations, max(ts) AS last_investigated FROM logs WHERE level='fatal' AND coalesce(source_file,'')<>'' GROUP BY ALL)"
_D = f"(datediff('second', date_trunc('second', {{}}), TIMESTAMP '{AS_OF}') - CASE WHEN {{}} > date_trunc('second', {{}}) THEN 1 ELSE 0 END)/86400.0::DOUBLE"
_E, _I = _D.format(*["last_error"] * 3), _D.format(*["last_investigated"] * 3)
VIEWS["risk"] = VIEWS["entities"] + f", risk AS (SELECT e.*, i.investigations, i.last_investigated, round(0.4*least(e.errors/10.0::DOUBLE,1)+0.3*least(coalesce(i.investigations,0)/5.0::DOUBLE,1)+0.2*CASE WHEN {_E}<1 THEN 1.0 WHEN {_E}<7 THEN 1-{_E}/7 ELSE 0 END+0.1*CASE WHEN {_I}<7 THEN 1 ELSE 0 END,4) AS risk FROM entities e LEFT JOIN inv i USING (file, service))"


def risk_of(spark, d):
    rows = logs(spark, d)
    entities = cod.code_entities(rows)
    looked = rows.filter("level = 'fatal' and source_file <> ''").select(F.col("source_file").alias("file"), "service", F.col("ts").alias("at"))
    return cod.risk_scores(entities.join(cod.investigation_counts(looked), ["file", "service"], "left"), AS_OF)


@q("cod1_extract_files", "SELECT DISTINCT source_file AS file FROM logs WHERE source_file IS NOT NULL")
def _(spark, d):
    rows = logs(spark, d).filter("source_file is not null")
    trace = F.concat(F.col("source_file"), F.lit(":12:in `call'\n/usr/gems/x.rb:3\n  File \"notes.txt\", line 3"))
    return cod.trace_files(rows.select(trace.alias("trace"))).select(F.explode("files").alias("file")).distinct()


FRAME_SQL = " || chr(10) || ".join(f"'{a}' || id % 13 || '{b}'" for a, b in (("src/Main", ".java:12"), ("at src/m", ".rs:10"), ("lib/a@1+b", ".ex:3"), ("a", ".php:2"), ("x/t", ".exs:9 (x)"), ("at f (web/ui", ".tsx:3:14)"), ("/srv/node_modules/y", ".js:1"), ("main/go", ".go:77 +0x1d"), ("config", ".yml:3"))) + """ || chr(10) || '  File "py/m' || id % 13 || '.py", line 3'"""
_ALL = "list_concat(list_concat(regexp_extract_all(t, '([^\\s:]+\\.\\w+):\\d+', 1), regexp_extract_all(t, '([^\\s]+\\.go):\\d+', 1)), list_concat(regexp_extract_all(t, '\\(([^)]+\\.[jt]sx?):\\d+:\\d+\\)', 1), regexp_extract_all(t, 'File \"([^\"]+\\.py)\", line \\d+', 1)))"


@q("cod1_all_endings", f", f AS (SELECT DISTINCT id % 13 AS k, {FRAME_SQL} AS t FROM logs) SELECT k, array_to_string(list_sort(list_distinct(list_filter({_ALL}, lambda p: regexp_matches(p, '\\.(rb|go|js|ts|jsx|tsx|py|java|rs|ex|exs|php)$') AND NOT contains(p, '/node_modules/')))), ' ') AS files FROM f")
def _(spark, d):
    k = F.col("id") % 13
    frames = [("src/Main", ".java:12"), ("at src/m", ".rs:10"), ("lib/a@1+b", ".ex:3"), ("a", ".php:2"), ("x/t", ".exs:9 (x)"), ("at f (web/ui", ".tsx:3:14)"), ("/srv/node_modules/y", ".js:1"), ("main/go", ".go:77 +0x1d"), ("config", ".yml:3"), ('  File "py/m', '.py", line 3')]
    trace = F.concat_ws("\n", *[F.concat(F.lit(a), k, F.lit(b)) for a, b in frames])
    found = cod.trace_files(logs(spark, d).select(k.alias("k"), trace.alias("trace")), "k")
    return found.select("k", F.array_join(F.array_sort("files"), " ").alias("files")).distinct()


@q("cod2_code_entities", "SELECT * FROM entities", ("entities",))
def _(spark, d):
    return plain(cod.code_entities(logs(spark, d)))


@q("cod3_investigation_counts", "SELECT * FROM inv", ("entities",))
def _(spark, d):
    looked = logs(spark, d).filter("level = 'fatal' and source_file <> ''").select(F.col("source_file").alias("file"), "service", F.col("ts").alias("at"))
    return plain(cod.investigation_counts(looked))


@q("cod4_risk_scores", "SELECT file, service, errors, risk FROM risk", ("risk",))
def _(spark, d):
    return risk_of(spark, d).select("file", "service", "errors", "risk")


@q("cod5_file_risk", ", w AS (SELECT DISTINCT 'app/f' || (event_id % 15) || '.rb' AS file FROM events), m AS (SELECT file, max(risk) AS risk, CAST(sum(errors) AS BIGINT) AS errors FROM risk GROUP BY 1), o AS (SELECT w.file, coalesce(m.risk,0.0) AS risk, coalesce(m.errors,0) AS errors FROM w LEFT JOIN m USING (file)) SELECT *, CASE WHEN risk<0.3 THEN 'low' WHEN risk<0.7 THEN 'medium' ELSE 'high' END AS level FROM o", ("risk",))
def _(spark, d):
    wanted = logs(spark, d).select(F.concat(F.lit("app/f"), F.col("id") % 15, F.lit(".rb")).alias("file"))
    return cod.file_risk(risk_of(spark, d), wanted)


@q("cod6_fragile", "SELECT file, service, errors, risk FROM risk ORDER BY risk DESC, errors DESC, file, service LIMIT 10", ("risk",))
def _(spark, d):
    return cod.fragile(risk_of(spark, d)).select("file", "service", "errors", "risk")


VIEWS["probes"] = """probes AS (SELECT *, CASE WHEN status_code=200 AND response_ms > 5000 THEN 'degraded' WHEN status_code=200 THEN 'up' WHEN status_code BETWEEN 200 AND 399 THEN 'degraded' ELSE 'down' END AS status FROM (
 SELECT 'check-' || (o_custkey % 8) AS "check", CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS checked_at, CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 302 ELSE 500 END AS status_code, CAST(floor(o_totalprice) AS BIGINT) % 9000 AS response_ms FROM orders))"""


def probes(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(F.lit("check-"), F.col("o_custkey") % 8).alias("check"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("checked_at"),
        F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 302).otherwise(500).alias("status_code"),
        (F.floor("o_totalprice").cast("long") % 9000).alias("response_ms"),
    )
    return hlt.classify_probe(o.withColumns({"expected_code": F.lit(200), "timeout_ms": F.lit(10000), "body_found": F.lit(True)}))


ORD = "(checked_at, response_ms, status_code)"


@q("hlt1_classify_probe", 'SELECT "check", status, count(*) AS n FROM probes GROUP BY ALL', ("probes",))
def _(spark, d):
    return probes(spark, d).groupBy("check", "status").agg(F.count("*").alias("n"))


SINCE = "1997-01-01"


@q("hlt2_uptime", f""", a AS (SELECT "check", arg_max(status, {ORD}) AS status, count(*) FILTER (s) AS total, count(*) FILTER (s AND status='down') AS downs, round(sum(response_ms) FILTER (s)::DOUBLE/count(*) FILTER (s),4) AS avg_response_ms, round(count(*) FILTER (s AND status='up')*100.0::DOUBLE/count(*) FILTER (s),4) AS uptime FROM (SELECT *, checked_at >= TIMESTAMP '{SINCE}' AS s FROM probes) GROUP BY 1) SELECT * FROM a UNION ALL SELECT 'check-none', 'unknown', 0, 0, NULL, NULL""", ("probes",))
def _(spark, d):
    p = probes(spark, d)
    checks = p.select("check").union(p.select(F.lit("check-none"))).distinct()
    return hlt.uptime(checks, p, SINCE)


@q("hlt3_transitions", f""", l AS (SELECT *, lag(status) OVER (PARTITION BY "check" ORDER BY checked_at, response_ms, status_code) AS before FROM probes) SELECT "check", checked_at, before, status FROM l WHERE checked_at >= TIMESTAMP '{SINCE}' AND checked_at <= TIMESTAMP '1997-03-01' AND before<>status""", ("probes",))
def _(spark, d):
    return plain(hlt.transitions(probes(spark, d), SINCE, "1997-03-01"))


@q("hlt4_reliability", """, r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY checked_at DESC, response_ms DESC, status_code DESC) AS n FROM probes) SELECT "check", round(count(*) FILTER (status='up')*100.0::DOUBLE/count(*),4) AS reliability FROM r WHERE n<=5 GROUP BY 1""", ("probes",))
def _(spark, d):
    return hlt.reliability(probes(spark, d))


@q("hlt5_consecutive_failures", f""", u AS (SELECT "check", max({ORD}) FILTER (status='up') AS up FROM probes GROUP BY 1) SELECT p."check", count(*) FILTER (u.up IS NULL OR {ORD} > u.up) AS failures FROM probes p JOIN u USING ("check") GROUP BY 1""", ("probes",))
def _(spark, d):
    return hlt.consecutive_failures(probes(spark, d))


@q("hlt6_latest_results", """SELECT "check", checked_at, status FROM probes WHERE "check"='check-3' ORDER BY checked_at DESC, response_ms DESC, status_code DESC LIMIT 20""", ("probes",))
def _(spark, d):
    return plain(hlt.latest_results(probes(spark, d), "check-3"), "check", "checked_at", "status")


VIEWS["metrics"] = "metrics AS (SELECT 'server-' || l_suppkey AS server, CASE l_linenumber WHEN 1 THEN 'cpu' WHEN 2 THEN 'mem' WHEN 3 THEN 'gc' ELSE 'disk' END AS name, CAST(l_quantity AS DOUBLE) AS value, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)"


def metrics(spark, d):
    name = F.when(F.col("l_linenumber") == 1, "cpu").when(F.col("l_linenumber") == 2, "mem").when(F.col("l_linenumber") == 3, "gc").otherwise("disk")
    return table(spark, d, "lineitem").select(F.concat(F.lit("server-"), "l_suppkey").alias("server"), name.alias("name"), F.col("l_quantity").cast("double").alias("value"), F.col("l_shipdate").cast("timestamp").alias("ts"))


@q("srv1_query_metrics", "SELECT * FROM metrics WHERE server='server-7' AND name='cpu' AND ts >= TIMESTAMP '1995-01-01' ORDER BY ts DESC, name, value LIMIT 100", ("metrics",))
def _(spark, d):
    return plain(hlt.query_metrics(metrics(spark, d), "server-7", "cpu", "1995-01-01"))


@q("srv2_latest_metrics", "SELECT server, name, ts, value FROM metrics JOIN (SELECT server, name, max(ts) AS ts FROM metrics GROUP BY ALL) USING (server, name, ts)", ("metrics",))
def _(spark, d):
    return plain(hlt.latest_metrics(metrics(spark, d)))


@q("srv3_register_servers", "SELECT server, min(ts) AS registered_at, max(ts) AS last_seen, arg_max(name, (ts, name)) AS last_metric, 'online' AS status FROM metrics GROUP BY 1", ("metrics",))
def _(spark, d):
    return plain(hlt.register_servers(metrics(spark, d)))


@q("srv4_mark_stale_offline", ", s AS (SELECT server, max(ts) AS t FROM metrics GROUP BY 1) SELECT server, CASE WHEN t < TIMESTAMP '1998-11-01' - INTERVAL 30 day THEN 'offline' ELSE 'online' END AS status FROM s", ("metrics",))
def _(spark, d):
    return hlt.mark_stale_offline(hlt.register_servers(metrics(spark, d)), "1998-11-01", 30).select("server", "status")


@q("cap1_captures", "SELECT id, json_extract_string(body,'$.sql[0].table') AS \"table\" FROM logs")
def _(spark, d):
    return cap.captures(logs(spark, d), "sql").select("id", cap.field("table").alias("table"))


@q("cap2_request_capture", "SELECT id, json_extract_string(body,'$.metadata.k') AS k FROM logs WHERE id=99")
def _(spark, d):
    return cap.request_capture(logs(spark, d), 99).select("id", F.get_json_object("metadata", "$.k").alias("k"))


def audited(spark, d):
    """Rows whose body carries an audit entry made of the row's own columns."""
    one = lambda *kv: F.to_json(F.struct(F.array(F.struct(*[F.col(c).cast("string").alias(k) for k, c in kv])).alias("x")))
    item = lambda *kv: F.get_json_object(one(*kv), "$.x")
    audit = item(("record_type", "event_type"), ("record_id", "tenant_id"), ("actor", "user_id"), ("action", "level"))
    mail = item(("to", "user_id"), ("subject", "level"))
    return logs(spark, d).withColumn("body", F.concat(F.lit('{"audit":'), audit, F.lit(',"email":'), mail, F.lit("}")))


@q("cap3_audit_trail", "SELECT id, user_id AS actor FROM logs WHERE event_type='purchase' AND tenant_id='tenant-4'")
def _(spark, d):
    return cap.audit_trail(audited(spark, d), "purchase", "tenant-4").select("id", cap.field("actor").alias("actor"))


@q("cap4_search_audit", f"SELECT id, user_id AS actor FROM logs WHERE level='error' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 240 hour")
def _(spark, d):
    return cap.search_audit(audited(spark, d), AS_OF, action="error", hours=240).select("id", cap.field("actor").alias("actor"))


@q("cap5_search_sql", ", s AS (SELECT id, ts, json_extract_string(body,'$.sql[0].table') AS \"table\", CAST(json_extract(body,'$.sql[0].duration_ms') AS DOUBLE) AS duration_ms FROM logs) SELECT id, \"table\", duration_ms FROM s WHERE \"table\"='t2' AND duration_ms >= 30 ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, d):
    return cap.search_sql(logs(spark, d), table="t2", min_ms=30).select("id", "table", "duration_ms")


@q("cap6_recent_emails", "SELECT id, user_id AS \"to\" FROM logs WHERE ts >= TIMESTAMP '2024-01-29'")
def _(spark, d):
    return cap.recent_emails(audited(spark, d), "2024-01-29").select("id", cap.field("to").alias("to"))


def stored(rows):
    """Rows as an ingest job stores them: the body parsed once, to a variant."""
    return written(body.parsed(rows))


def of_variant(name, f):
    """The question of a query, asked of stored variants."""
    B.queries[f"{name}_variant"], B.sql[f"{name}_variant"] = f, B.sql[name]


of_variant("cap1_captures", lambda spark, d: cap.captures(stored(logs(spark, d)), "sql").select("id", cap.field("table", True).alias("table")))
of_variant("cap2_request_capture", lambda spark, d: cap.request_capture(stored(logs(spark, d)), 99).select("id", F.get_json_object("metadata", "$.k").alias("k")))
of_variant("cap3_audit_trail", lambda spark, d: cap.audit_trail(stored(audited(spark, d)), "purchase", "tenant-4").select("id", cap.field("actor", True).alias("actor")))
of_variant("cap4_search_audit", lambda spark, d: cap.search_audit(stored(audited(spark, d)), AS_OF, action="error", hours=240).select("id", cap.field("actor", True).alias("actor")))
of_variant("cap5_search_sql", lambda spark, d: cap.search_sql(stored(logs(spark, d)), table="t2", min_ms=30).select("id", "table", "duration_ms"))
of_variant("cap6_recent_emails", lambda spark, d: cap.recent_emails(stored(audited(spark, d)), "2024-01-29").select("id", cap.field("to", True).alias("to")))


@q("flt7_metadata_filter_variant", "SELECT id FROM logs WHERE json_extract_string(body,'$.metadata.k')='7'")
def _(spark, d):
    return filter_logs(stored(logs(spark, d)), metadata={"k": "7"}).select("id")


@q("agg8_metadata_keys_variant", "SELECT 'k' AS key, count(*) AS n FROM logs WHERE json_extract_string(body,'$.metadata.k') IS NOT NULL")
def _(spark, d):
    return metadata_keys(stored(logs(spark, d)))


QUERIES, SQL = B.queries, B.sql
