"""SRC-5 with all that stands beside the rows: minute summaries, dictionaries and postings by arrival hour.

    root/rows/arrival_hour=H/append=A            the rows
    root/minutes/arrival_hour=H/append=A         AGG-5 and AGG-21 by minute, service, env and level
    root/dictionaries/arrival_hour=H/append=A    distinct values with their first and last time
    root/postings/arrival_hour=H/bucket=B/append=A   (token, id)
    root/common/arrival_hour=H/append=A          tokens that too many rows of the hour have
    root/merged/arrival_hour=H/append=A          which appends a sealed hour has taken in

An append writes its own folders and, repeated, overwrites them. Sealing an
hour merges its appends into one: summaries add up, rows become few files, and
the common tokens leave the postings. Questions about a span of time are
answered from summaries, and from rows for the two minutes at its edges alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators.predicates import env_matches, filter_logs, full_text, is_error, is_request, same
from . import folders
from .tables import HOUR

KEYS = ("minute", "service", "env", "level")
SUMMED = ("n", "timed", "duration_sum", "sql_count", "cache_hits", "cache_reads")
LISTED = ("service", "env", "level", "version", "error_class", "source_file", "method", "kind", "event_type", "tenant_id")
SEALED = "sealed"
#: A token that this share of an hour's rows and so many of them have is common there.
COMMON, COMMON_LEAST = 0.1, 1000
# A table keeps the layout that it was begun with.
@dataclass(frozen=True)
class Layout:
    """Hours of arrival in one folder (1 to 24, dividing a day), buckets of tokens and files of rows in it."""

    hours: int = 1
    buckets: int = 16
    files: int = 1

    def folder(self, received: Column) -> Column:
        day = F.date_trunc("day", received)
        return F.date_format(day + F.make_dt_interval(hours=F.floor(F.hour(received) / self.hours).cast("int") * self.hours), "yyyy-MM-dd-HH")

    def of(self, t: datetime) -> str:
        return t.replace(hour=t.hour // self.hours * self.hours).strftime("%Y-%m-%d-%H")


HOURLY = Layout()
TABLES = ("rows", "minutes", "dictionaries", "postings", "common", "merged")


def summary_columns() -> list[Column]:
    timed = is_request() & (F.col("duration_ms") > 0)
    of = lambda c: F.coalesce(F.sum(F.when(timed, F.col(c))), F.lit(0))
    return [
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(timed, 1).otherwise(0)).alias("timed"), of("duration_ms").alias("duration_sum"), of("db_count").alias("sql_count"), of("cache_hits").alias("cache_hits"),
        F.coalesce(F.sum(F.when(timed, F.col("cache_hits") + F.col("cache_misses"))), F.lit(0)).alias("cache_reads"),
    ]


def ranked() -> Column:
    """The duration that p95 ranks."""
    return F.when((F.col("kind") == "request") & (F.col("duration_ms") > 0), F.col("duration_ms"))


LEAST, MOST = ("first_id", "first_ts"), ("last_id", "last_ts")


def folded(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of summaries, one row a key and duration (value, times), as one row a key: durations as an array, sorted by value, null if there are none."""
    listed = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "times"))))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED] + [F.min(c).alias(c) for c in LEAST] + [F.max(c).alias(c) for c in MOST]
    return parts.groupBy(*keys).agg(*sums, listed.alias("durations")).withColumn("durations", F.when(F.size("durations") > 0, F.col("durations")))


def summarise(rows: DataFrame, *more: str) -> DataFrame:
    """AGG-5 and all of AGG-21 of each minute, service, env and level (and `more`), in a form that adds up."""
    keys = [*more, *KEYS]
    rows = rows.withColumn("minute", F.date_trunc("minute", "ts"))
    return folded(rows.groupBy(*keys, ranked().alias("value")).agg(*summary_columns(), F.count("*").alias("times")), keys)


def added(summaries: DataFrame, *keys: str) -> DataFrame:
    """Summaries of one key as one."""
    keys = list(keys)
    each = summaries.select(*keys, *SUMMED, *LEAST, *MOST, F.posexplode_outer("durations").alias("pos", "d"))
    # The sums of a summary count once, with its first duration.
    sums = [F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c))).alias(c) for c in SUMMED] + [F.min(c).alias(c) for c in LEAST] + [F.max(c).alias(c) for c in MOST]
    return folded(each.groupBy(*keys, F.col("d.value").alias("value")).agg(*sums, F.sum("d.times").alias("times")), keys)


def dictionaries(rows: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in LISTED])).alias("e")
    found = rows.select(HOUR, "append", "ts", each).filter(F.coalesce("e.value", F.lit("")) != "")
    return found.groupBy(HOUR, "append", "e.column", "e.value").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def bucket(token, layout: Layout) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(layout.buckets)).cast("int")


def postings(rows: DataFrame, layout: Layout) -> DataFrame:
    found = rows.select(HOUR, "append", "id", F.explode(tokens(F.col("message"))).alias("token"))
    return found.withColumn("bucket", bucket("token", layout))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows brought together by folder; what is too much for one task becomes several files."""
    return df.hint("rebalance", *by)


def in_files(rows: DataFrame, layout: Layout) -> DataFrame:
    return dealt(rows.withColumn("__file", F.pmod(F.xxhash64("id"), F.lit(layout.files))), HOUR, "__file").drop("__file")


def _parts(table: str) -> tuple[str, ...]:
    return (HOUR, "bucket", "append") if table == "postings" else (HOUR, "append")


def read(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table below root with its folders as strings; None before anything was written."""
    where = f"{root}/{table}"
    if not any("=" in c for c in folders.children(spark, where)):
        return None
    df = spark.read.option("basePath", where).parquet(where)
    return df.withColumns({HOUR: F.col(HOUR).cast("string"), "append": F.col("append").cast("string")})


def append_logs(df: DataFrame, root: str, append: str, layout: Layout = HOURLY) -> None:
    """SRC-5: the rows of one append (a name, not `sealed`) with all that stands beside them; run again, it changes nothing.

    Hours that have taken this append in are left alone.
    """
    if append == SEALED or not append or "/" in append or "=" in append:
        raise ValueError(f"no name for an append: {append!r}")
    spark = df.sparkSession
    folders.recover(spark, root)
    rows = df.withColumns({HOUR: layout.folder(F.col("received_at")), "append": F.lit(append)})
    merged = read(spark, root, "merged")
    if merged is not None:
        rows = rows.join(merged.filter(F.col("merged_append") == append).select(HOUR).distinct(), HOUR, "left_anti")

    def put(table: str, part: DataFrame) -> None:
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_parts(table)).parquet(f"{root}/{table}")

    put("rows", in_files(rows, layout))
    if not folders.exists(spark, f"{root}/rows"):
        return
    # What stands beside comes from the rows as written: the frame is asked once, and few columns are read.
    there = spark.read.schema(rows.schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows").filter(F.col("append") == append)
    put("minutes", dealt(summarise(there, HOUR, "append"), HOUR))
    put("dictionaries", dictionaries(there).repartition(HOUR))
    put("postings", dealt(postings(there, layout), HOUR, "bucket"))


def open_hours(spark: SparkSession, root: str, before: str | None = None) -> list[str]:
    """Hours (before one) that hold appends not merged yet; names of folders, nothing is read."""
    found = []
    for child in folders.children(spark, f"{root}/rows"):
        hour = child.removeprefix(f"{HOUR}=")
        if hour != child and (before is None or hour < before) and any(a.startswith("append=") and a != f"append={SEALED}" for a in folders.children(spark, f"{root}/rows/{child}")):
            found.append(hour)
    return found


def seal(spark: SparkSession, root: str, before: str | None = None, layout: Layout = HOURLY) -> list[str]:
    """SRC-5: merges the appends of each open hour (before one); returns the hours. A crash is made good by the next call."""
    folders.recover(spark, root)
    hours = open_hours(spark, root, before)
    if not hours:
        return []
    inside = lambda table: (df := read(spark, root, table)) is not None and df.filter(F.col(HOUR).isin(hours))
    rows, known = inside("rows"), inside("common")
    names = rows.select(HOUR, F.col("append").alias("merged_append")).distinct().filter(F.col("merged_append") != SEALED)
    if (earlier := inside("merged")) is not False:
        names = names.union(earlier.select(HOUR, "merged_append")).distinct()
    size = rows.groupBy(HOUR).agg(F.count("*").alias("rows"))
    posts = inside("postings").select(HOUR, "bucket", "token", "id")
    counted = posts.groupBy(HOUR, "token").agg(F.count("*").alias("n")).join(size, HOUR)
    common = counted.filter((F.col("n") >= COMMON_LEAST) & (F.col("n") >= COMMON * F.col("rows"))).select(HOUR, "token")
    if known is not False:
        # A token that was common once has no full list of ids any more.
        common = common.union(known.select(HOUR, "token")).distinct()
    lists = inside("dictionaries").groupBy(HOUR, "column", "value").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    tables = {
        "rows": in_files(rows.drop("append"), layout).sortWithinPartitions(HOUR, "ts"),
        "minutes": dealt(added(inside("minutes"), HOUR, *KEYS), HOUR),
        "dictionaries": lists.repartition(HOUR),
        "postings": dealt(posts.join(common, [HOUR, "token"], "left_anti"), HOUR, "bucket").sortWithinPartitions(HOUR, "bucket", "token"),
        "common": common.repartition(HOUR),
        "merged": names.repartition(HOUR),
    }
    old = []
    for h in hours:
        for table in TABLES:
            here = f"{table}/{HOUR}={h}"
            for a in folders.children(spark, f"{root}/{here}"):
                old += [f"{here}/{a}"] if table != "postings" else [f"{here}/{a}/{b}" for b in folders.children(spark, f"{root}/{here}/{a}")]
    folders.replace_folders(spark, root, "hours", {t: df.withColumn("append", F.lit(SEALED)) for t, df in tables.items()}, {t: _parts(t) for t in tables}, old)
    return hours


def drop_hours(spark: SparkSession, root: str, before: str) -> list[str]:
    """SRC-10: deletes hours before one from the rows and from all that stands beside them."""
    gone = [h for c in folders.children(spark, f"{root}/rows") if (h := c.removeprefix(f"{HOUR}=")) != c and h < before]
    for h in gone:
        for table in TABLES:
            folders.delete(spark, f"{root}/{table}/{HOUR}={h}")
    return gone


# Answers from summaries
def _moment(t) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(t)


def edges(start: str, end: str) -> tuple[datetime, datetime, list[datetime]]:
    """Whole minutes in [start, end] from the first up to (not including) the second, and the minutes at the edges."""
    s, e = _moment(start), _moment(end)
    first, last = s.replace(second=0, microsecond=0), e.replace(second=0, microsecond=0)
    whole = first if first == s else first + timedelta(minutes=1)
    return whole, last, sorted({last} | ({first} if first != s else set()))


def summaries(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Summaries (KEYS and sums) of exactly the rows with ts in [start, end].

    Whole minutes come from the minute table; the one or two at the edges are
    summed from rows, of the arrival hours that the minute table names for them.
    """
    lit = lambda t: F.lit(str(t)).cast("timestamp")
    first, last, cut = edges(start, end)
    minutes = read(spark, root, "minutes")
    whole = minutes.filter((F.col("minute") >= lit(first)) & (F.col("minute") < lit(last)))
    # Where rows of a minute have arrived: an hour or two.
    hours = [r[0] for r in minutes.filter(F.col("minute").isin([lit(c) for c in cut])).select(HOUR).distinct().collect()]
    rows = read(spark, root, "rows").filter(F.col(HOUR).isin(hours) & (F.col("ts") >= lit(start)) & (F.col("ts") <= lit(end)) & F.date_trunc("minute", "ts").isin([lit(c) for c in cut]))
    columns = [*KEYS, *SUMMED, "first_id", "last_id", "first_ts", "last_ts", "durations"]
    return whole.select(columns).unionByName(summarise(rows).select(columns))


def scoped(parts: DataFrame, service=None, env=None, level=None) -> DataFrame:
    for c, v in (("service", service), ("level", level)):
        if v:
            parts = parts.filter(same(c, v))
    return parts.filter(env_matches(env))


def count_by_level(spark, root, start, end, **scope) -> DataFrame:
    """AGG-1 from summaries."""
    return scoped(summaries(spark, root, start, end), **scope).groupBy("level").agg(F.sum("n").alias("n"))


def _errors() -> Column:
    return F.sum(F.when(is_error(), F.col("n")).otherwise(0))


def error_rate(spark, root, start, end, **scope) -> DataFrame:
    """AGG-2 from summaries."""
    a = scoped(summaries(spark, root, start, end), **scope).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(_errors(), F.lit(0)).alias("errors"))
    return a.withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("errors") * 100.0 / F.col("total"), 4)).otherwise(0.0))


def count_by_service(spark, root, start, end, **scope) -> DataFrame:
    """AGG-3 from summaries."""
    return scoped(summaries(spark, root, start, end), **scope).groupBy("service").agg(F.sum("n").alias("total"), _errors().alias("errors"))


def histogram(spark, root, start, end, interval_s: int, **scope) -> DataFrame:
    """AGG-4 for ts in [start, end): from summaries where buckets are made of whole minutes, else from the rows of the span's hours."""
    from ..operators import aggregates as agg

    s, e = _moment(start), _moment(end)
    seconds = int((e - s).total_seconds())
    width = max(interval_s, 1, -(-seconds // 10_000))
    if s.second or s.microsecond or width % 60:
        from .tables import scan_logs

        return agg.histogram(scan_logs(spark, f"{root}/rows", start, end), start, end, interval_s, **scope)
    last = e - timedelta(microseconds=1)
    counted = scoped(summaries(spark, root, start, str(last)), **scope).select((F.floor((F.unix_timestamp("minute") - F.unix_timestamp(F.lit(str(s)).cast("timestamp"))) / width)).alias("i"), "n")
    counted = counted.groupBy("i").agg(F.sum("n").alias("n"))
    every = spark.range(seconds // width + 1).withColumnRenamed("id", "i")
    return every.join(counted, "i", "left").select(F.timestamp_seconds(F.unix_timestamp(F.lit(str(s)).cast("timestamp")) + F.col("i") * width).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def measure(spark, root, start, end, env=None, keys=("service", "env")) -> DataFrame:
    """AGG-21 for ts in [start, end), p95 and all, from summaries: one row of metrics per key."""
    last = _moment(end) - timedelta(microseconds=1)
    parts = scoped(summaries(spark, root, start, str(last)), env=env)
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMMED], _errors().alias("errors"), F.max("last_ts").alias("last"))
    # Nearest rank over exact counts: a window over the distinct durations of a key, not over its rows.
    counted = parts.select(*keys, F.explode("durations").alias("d")).groupBy(*keys, F.col("d.value").alias("value")).agg(F.sum("d.times").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*keys).orderBy("value"))
    total = F.sum("times").over(Window.partitionBy(*keys))
    p95 = counted.withColumns({"upto": upto, "total": total}).filter(F.col("upto") * 100 >= F.col("total") * 95).groupBy(*keys).agg(F.min("value").cast("long").alias("p95_response"))
    out = sums.join(p95, [sums[k].eqNullSafe(p95[k]) for k in keys], "left")
    n = F.col("n")
    return out.select(
        *[sums[k] for k in keys], n.alias("log_count"), F.col("errors").alias("error_count"), F.round(F.col("errors") / n, 6).alias("error_rate"),
        F.round(F.col("duration_sum") / F.nullif(F.col("timed"), F.lit(0)), 4).alias("response_time"), "p95_response", F.timestamp_diff("SECOND", F.col("last"), F.lit(end).cast("timestamp")).alias("heartbeat"),
        "sql_count", F.when(F.col("cache_reads") > 0, F.round(F.col("cache_hits") / F.col("cache_reads"), 6)).otherwise(0.0).alias("cache_hit_rate"),
    )


def distinct_values(spark, root, column: str, start: str, end: str) -> DataFrame:
    """AGG-6 from dictionaries: a value whose first or last time in an hour lies in [start, end] is there.

    Rows are read of hours alone in which a value stands both before and after
    the whole span and nowhere else: those that a short span lies within.
    """
    if column not in LISTED:
        raise ValueError(f"no dictionary of {column!r}")
    lit = lambda t: F.lit(str(_moment(t))).cast("timestamp")
    inside = lambda c: (F.col(c) >= lit(start)) & (F.col(c) <= lit(end))
    words = read(spark, root, "dictionaries").filter((F.col("column") == column) & (F.col("first_ts") <= lit(end)) & (F.col("last_ts") >= lit(start)))
    sure = words.filter(inside("first_ts") | inside("last_ts")).select("value")
    open_ = words.filter(~(inside("first_ts") | inside("last_ts"))).join(sure.distinct(), "value", "left_anti")
    hours = [r[0] for r in open_.select(HOUR).distinct().collect()]  # at most the hours around one span
    rows = read(spark, root, "rows").filter(F.col(HOUR).isin(hours) & inside("ts")).select(F.col(column).alias("value")).filter(F.coalesce("value", F.lit("")) != "")
    return sure.union(rows).distinct().orderBy("value")


# Full text
def full_text_hours(spark: SparkSession, root: str, query: str, start: str, end: str, margin_hours: int = 1, layout: Layout = HOURLY) -> DataFrame:
    """FLT-6 from stored postings: rows with ts in [start, end] whose message has every token of the query.

    The query's tokens name the buckets to read. In an hour where some of them
    are common the others decide, and where all are, all its rows do; the text
    is asked again, so nothing is lost and nothing is wrong.
    """
    name = lambda t, h: layout.of(_moment(t) + timedelta(hours=h))
    low, high = name(start, -margin_hours), name(end, margin_hours)
    near = (F.col(HOUR) >= low) & (F.col(HOUR) <= high)
    rows = read(spark, root, "rows")
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") <= F.lit(end).cast("timestamp"))
    words = spark.range(1).select(tokens(F.lit(query)).alias("t"), F.transform(tokens(F.lit(query)), lambda t: bucket(t, layout)).alias("b")).first()
    if not words.t:
        return rows.filter(F.lit(False)).drop("append")
    posts = read(spark, root, "postings").filter(near & F.col("bucket").isin(sorted(set(words.b))) & F.col("token").isin(words.t))
    common = read(spark, root, "common")
    if common is not None:
        # An append that came after sealing has postings of common tokens too; they can't count.
        common = common.filter(near & F.col("token").isin(words.t)).select(HOUR, "token").distinct()
        posts = posts.join(common, [HOUR, "token"], "left_anti")
    hits = posts.groupBy(HOUR, "id").agg(F.countDistinct("token").alias("found"))
    if common is None:
        hits = hits.filter(F.col("found") == len(words.t)).select(HOUR, "id")
        hours, whole = [r[0] for r in hits.select(HOUR).distinct().collect()], []
    else:
        # One row for each hour of the span.
        often = {r[HOUR]: r.n for r in common.groupBy(HOUR).agg(F.count("*").cast("int").alias("n")).collect()}
        wanted = F.create_map(*[x for h, n in often.items() for x in (F.lit(h), F.lit(len(words.t) - n))]) if often else F.create_map().cast("map<string,int>")
        hits = hits.filter(F.col("found") == F.coalesce(F.try_element_at(wanted, F.col(HOUR)), F.lit(len(words.t)))).select(HOUR, "id")
        whole = sorted(h for h, n in often.items() if n == len(words.t))
        hours = [r[0] for r in hits.select(HOUR).distinct().collect()]
    some = rows.filter(F.col(HOUR).isin(hours) & inside).join(hits, [HOUR, "id"], "left_semi")
    every = rows.filter(F.col(HOUR).isin(whole) & inside)
    return full_text(some.select(rows.columns).union(every.select(rows.columns)), query).drop("append")


# Newest first
def search_newest(spark: SparkSession, root: str, as_of: str, start=None, end=None, limit=50, offset=0, margin_hours: int = 1, layout: Layout = HOURLY, **params) -> DataFrame:
    """SRT-1 over hours, newest first: the newest hour is asked, then twice as many, until the page is full.

    Rows that arrived in older hours have times an hour after their end at
    most, so a page whose last row is later than that is final. Each step asks
    for one number; only the last one's hours are read for the page.
    """
    from ..operators.search import clamp, search_logs

    begin = _moment(start) if start else _moment(as_of) - timedelta(hours=1)
    until = _moment(end) if end else None
    name = lambda t, h: layout.of(t + timedelta(hours=h))
    there = [h for c in folders.children(spark, f"{root}/rows") if (h := c.removeprefix(f"{HOUR}=")) != c]
    hours = sorted((h for h in there if h >= name(begin, -margin_hours) and (until is None or h <= name(until, margin_hours))), reverse=True)
    rows, wanted = read(spark, root, "rows").drop("append"), max(0, offset) + clamp(limit, 50, 500)
    n = 1
    while n < len(hours):
        final = datetime.strptime(hours[n - 1], "%Y-%m-%d-%H") + timedelta(hours=margin_hours)
        sure = filter_logs(rows.filter(F.col(HOUR) >= hours[n - 1]), start=str(max(begin, final)), end=end, **params)
        if sure.limit(wanted).count() == wanted:
            break
        n *= 2
    last = hours[min(n, len(hours)) - 1] if hours else name(begin, 0)
    return search_logs(rows.filter(F.col(HOUR) >= last), as_of, str(begin), end, limit, offset, **params)
