"""SRC-5 to SRC-10: tables laid out by arrival hour, retention, relational sources, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = "arrival_hour"


def arrival_hour(c: str = "received_at"):
    return F.date_format(F.date_trunc("hour", c), "yyyy-MM-dd-HH")


def write_logs(df: DataFrame, path: str, mode: str = "append", files_per_hour: int = 1, beside: str | None = None) -> None:
    """SRC-5: append to the table at `path`, one folder an arrival hour; with `beside`, its rollup and dictionaries there.

    Rows are dealt by hour and, for busy tables, over several files an hour, so
    an hour is neither many small files nor one task's work.
    """
    out = df.withColumn(HOUR, arrival_hour())
    out.repartition(HOUR, F.pmod(F.xxhash64("id"), F.lit(files_per_hour))).write.mode(mode).partitionBy(HOUR).parquet(path)
    if beside:
        write_rollup(df, f"{beside}/minutes", mode)
        hour_dictionaries(df).write.mode(mode).partitionBy(HOUR).parquet(f"{beside}/dictionaries")


def write_rollup(df: DataFrame, path: str, mode: str = "append") -> None:
    """SRC-5: the minute rollup beside the rows, one folder a day."""
    from ..operators.aggregates import rollup_minute

    rollup_minute(df).withColumn("day", F.to_date("minute")).write.mode(mode).partitionBy("day").parquet(path)


def hour_dictionaries(df: DataFrame, columns: tuple[str, ...] = ("service", "env", "level", "version")) -> DataFrame:
    """SRC-5: (arrival_hour, column, value, n): the distinct values of low-cardinality columns in each hour."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    return df.select(arrival_hour().alias(HOUR), each).groupBy(HOUR, "e.column", "e.value").agg(F.count("*").alias("n")).filter("value is not null")


def scan_logs(spark: SparkSession, path: str, start: str, end: str, margin_hours: int = 1) -> DataFrame:
    """SRC-6: rows with ts in [start, end]; folders an hour outside are not read."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    margin = F.make_dt_interval(hours=F.lit(margin_hours))
    name = lambda t: F.date_format(F.date_trunc("hour", t), "yyyy-MM-dd-HH")
    rows = spark.read.option("basePath", path).parquet(path).withColumn(HOUR, F.col(HOUR).cast("string"))
    return rows.filter((F.col(HOUR) >= name(s - margin)) & (F.col(HOUR) <= name(e + margin)) & (F.col("ts") >= s) & (F.col("ts") <= e))


def read_jdbc_query(spark: SparkSession, url: str, query: str, max_rows: int | None = 1000, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """SRC-7: the rows of a query, which must only read; the driver's jar must be on the class path.

    At most `max_rows`, which ones the database decides, or all with None. With
    `split` (column, least, most, parts) the database is asked for that many
    ranges of a column at once, a task each.
    """
    if query.split(None, 1)[0].lower() not in ("select", "with") or ";" in query:
        raise ValueError("only one SELECT may be asked")
    asked = spark.read.format("jdbc").options(url=url, **options)
    if split:
        column, low, high, n = split
        rows = asked.options(dbtable=f"({query}) asked", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n).load()
    else:
        rows = asked.option("query", query).load()
    return rows if max_rows is None else rows.limit(max_rows)


def profile_table(df: DataFrame, few: int = 50, samples: int = 5) -> DataFrame:
    """SRC-8: (column, type, rows, distinct, samples): samples where fewer than `few` values exist.

    Two passes: approximate distinct counts of all columns at once, then the
    values of the few-valued ones at once.
    """
    spark = df.sparkSession
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
    counts = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(plain)]).first()
    low = [c for i, c in enumerate(plain) if counts[f"d{i}"] < few]
    picked = {}
    if low:
        row = df.agg(*[F.slice(F.sort_array(F.collect_set(F.col(c).cast("string"))), 1, samples).alias(f"s{i}") for i, c in enumerate(low)]).first()
        picked = {c: row[f"s{i}"] for i, c in enumerate(low)}
    kinds = dict(df.dtypes)
    rows = [(c, kinds[c], counts["n"], counts[f"d{i}"], picked.get(c)) for i, c in enumerate(plain)]
    return spark.createDataFrame(rows, "column string, type string, rows long, distinct_values long, samples array<string>")


def append_metrics(df: DataFrame, path: str | None = None) -> DataFrame:
    """SRC-9: long-format samples with labels as a map; appended to `path` when given."""
    out = df.withColumn("labels", F.from_json("labels", "map<string,string>"))
    if path:
        out.write.mode("append").parquet(path)
    return out


def seconds_of(ttl: str) -> int | None:
    """`never`, `30d`, or hours, minutes and seconds such as `36h` or `1h30m`."""
    import re

    if ttl == "never":
        return None
    parts = re.findall(r"(\d+)([dhms])", ttl)
    if not parts or "".join(n + u for n, u in parts) != ttl:
        raise ValueError(f"bad time to live {ttl!r}")
    return sum(int(n) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[u] for n, u in parts)


def prune(df: DataFrame, ttl: str, as_of: str, time_col: str = "ts") -> DataFrame:
    """SRC-10 for tables with a time column: what is young enough."""
    s = seconds_of(ttl)
    if s is None:
        return df
    return df.filter(F.col(time_col) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(s)))


def prune_log_hours(logs: DataFrame, ttl: str, as_of: str) -> DataFrame:
    """SRC-10 for logs: whole arrival hours go, once their last arrival is before the cutoff.

    Only the hour that the cutoff lies in needs a look at its rows; all others are told by their name.
    """
    s = seconds_of(ttl)
    if s is None:
        return logs
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(s))
    hour, edge = F.date_trunc("hour", "received_at"), F.date_trunc("hour", cutoff)
    alive = logs.filter((hour == edge) & (F.col("received_at") >= cutoff)).select(F.lit(1)).limit(1)
    # A cross join with one row or none: the hour at the edge stays or goes as a whole.
    return logs.filter(hour > edge).unionByName(logs.filter(hour == edge).crossJoin(F.broadcast(alive)).select(logs.columns))


def drop_old_hours(spark: SparkSession, path: str, ttl: str, as_of: str) -> list[str]:
    """SRC-10: deletes the folders of a table of `write_logs` whose hour and rows are before the cutoff; returns the hours."""
    s = seconds_of(ttl)
    if s is None:
        return []
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(s))
    edge = F.date_format(F.date_trunc("hour", cutoff), "yyyy-MM-dd-HH")
    rows = spark.read.parquet(path).withColumn(HOUR, F.col(HOUR).cast("string"))
    old = rows.select(HOUR).filter(F.col(HOUR) < edge).distinct().union(rows.filter(F.col(HOUR) == edge).groupBy(HOUR).agg(F.max("received_at").alias("last")).filter(F.col("last") < cutoff).select(HOUR))
    hours = sorted(r[0] for r in old.collect())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for h in hours:
        folder = hadoop(f"{path}/{HOUR}={h}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return hours
