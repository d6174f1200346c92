"""Ingest queries work on all rows, also on those without children."""

from __future__ import annotations

from sigmill.operators import ingest as ing
from sigmill.plans import q_ingest
from sigmill.plans.views import logs

D = "/root/testdata/sf0.001"


def test_rows_without_children_are_expanded_too(spark):
    n, held = logs(spark, D).count(), logs(spark, D).filter("id % 4 = 0").count()
    rows = q_ingest.with_children(spark, D)
    assert (rows.count(), ing.expand_in_request_logs(rows).count()) == (n, n + 2 * held)


def test_old_hours_go_as_folders(spark, tmp_path):
    from pathlib import Path

    from sigmill.sources import tables as src

    rows, where = logs(spark, D), str(tmp_path / "logs")
    src.write_logs(rows, where, beside=str(tmp_path / "beside"))
    as_of = "2024-01-31 00:00:00"
    gone = src.drop_old_hours(spark, where, "100h", as_of)
    assert gone and not any(Path(where, f"{src.HOUR}={h}").exists() for h in gone)
    left = sorted(r.id for r in spark.read.parquet(where).collect())
    assert left == sorted(r.id for r in src.prune_log_hours(rows, "100h", as_of).collect())
    assert spark.read.parquet(str(tmp_path / "beside/minutes")).agg({"n": "sum"}).first()[0] == rows.count()
    assert src.drop_old_hours(spark, where, "never", as_of) == []


def test_only_selects_are_asked(spark):
    import pytest

    from sigmill.sources import tables as src

    for bad in ("DELETE FROM t", "SELECT 1; DROP TABLE t"):
        with pytest.raises(ValueError):
            src.read_jdbc_query(spark, "jdbc:derby:memory:x", bad)


def test_a_database_is_read_in_ranges_and_up_to_a_bound(spark):
    from sigmill.sources import tables as src

    url, driver = "jdbc:derby:memory:ranges;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(2500).write.jdbc(url, "numbers", properties=driver)
    whole = src.read_jdbc_query(spark, url, 'SELECT "id" FROM numbers', max_rows=None, split=('"id"', 0, 2499, 5), **driver)
    assert whole.rdd.getNumPartitions() == 5 and sorted(r.id for r in whole.collect()) == list(range(2500))
    assert src.read_jdbc_query(spark, url, 'SELECT "id" FROM numbers', **driver).count() == 1000


def test_newest_deploy_and_pending_alerts(spark):
    from sigmill.operators import deploys as dep
    from sigmill.operators import watches as wat

    rows = spark.createDataFrame([("v1", "api", "prod", "2024-01-01"), ("v2", "api", "prod", "2024-01-03"), ("v3", "web", "prod", "2024-01-04")], "version string, service string, env string, first_seen string").selectExpr("version", "service", "env", "cast(first_seen as timestamp) first_seen")
    assert [r.version for r in dep.latest_deploy(rows, "api", "prod").collect()] == ["v2"]
    alerts = spark.createDataFrame([("a", "pending"), ("b", "dismissed"), ("c", "pending")], "alert_id string, status string")
    assert wat.pending_count(alerts).first().n == 2


def test_body_aliases_say_where(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("Traceback",), ("@timestamp",), (" LATENCY ",), ("servcie",), (None,)], "f string").select(ing.suggest_field(F.col("f")).alias("s"))
    assert [r.s for r in got.collect()] == ['body, as "backtrace" inside it', "ts", "duration_ms", "service", ""]
