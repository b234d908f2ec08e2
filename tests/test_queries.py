"""Every registered query against its SQL, and the known counts of the sensor view."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from conftest import SF_SMALL
from pulsegrid.operators import kpi
from pulsegrid.plans.queries import REGISTRY, kpi_range_table

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_sql_has_its_query():
    assert not set(SQL) - set(QUERIES)


def test_every_query_of_the_library_has_sql():
    assert set(REGISTRY) <= set(SQL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    status, rows, _, detail = compare(spark, con, SF_SMALL, name, QUERIES[name], SQL.get(name))
    assert status == "ok", detail
    assert rows > 0


@pytest.mark.parametrize(
    "name",
    [
        "alerts_all", "devices_apply_changes", "ingest_validate", "kpis_incremental", "kpis_upserted", "logs_enriched",
        "rate_alerts_5m", "recent_by_sensor_type", "reconcile_counts", "telemetry_scan", "throughput_delta", "upsert_latest",
    ],
)
def test_plans_stay_in_the_jvm_and_join_on_keys(spark, plan, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    for unwanted in ("Python", "Pandas", "NestedLoop", "CartesianProduct"):
        assert unwanted not in text
    assert not single_partitions(QUERIES[name](spark, SF_SMALL))


def single_partitions(df):
    """Exchanges into one partition outside of scalar subqueries, which end in one row."""
    found, todo = [], [df._jdf.queryExecution().sparkPlan(), df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange" and "SinglePartition" in node.simpleString(1000):
            found.append(node.simpleString(200))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_the_single_partition_check_sees_one(spark):
    assert single_partitions(spark.range(100).repartition(3).selectExpr("sum(id) OVER ()"))


def test_unneeded_columns_are_not_read(spark, plan):
    assert "ReadSchema: struct<>" in plan(QUERIES["telemetry_count"](spark, SF_SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan(QUERIES["telemetry_partitions"](spark, SF_SMALL))
    text = plan(QUERIES["metric_telemetry_received"](spark, SF_SMALL))
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def counts(spark):
    def of(name, *by):
        df = QUERIES[name](spark, SF_SMALL)
        if not by:
            return df.count()
        return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*by).count().collect()}

    return of


def test_known_counts(spark, counts):
    """Fixed expectations of FIXTURES.md for the smallest tables."""
    assert counts("telemetry_scan") == 1000
    assert counts("reading_value") == 961
    assert counts("upsert_latest") == 90
    assert counts("alerts_rapid_change") == 409
    assert counts("alerts_stuck_sensor") == 12
    assert counts("kpis_incremental") == 570
    # the figure is that of the range
    assert kpi.collapse_sensors(kpi_range_table(spark, SF_SMALL)).count() == 497


def test_known_threshold_counts(spark):
    def of(name):
        df = QUERIES[name](spark, SF_SMALL).where("alert_type = 'threshold_breach'")
        kind = "substring_index(sensor_id, '-', 1)"
        return {(r["t"], r["severity"]): r["count"] for r in df.groupBy(df.severity, _expr(kind).alias("t")).count().collect()}

    rest = {
        ("humidity", "critical"): 24, ("humidity", "warning"): 16, ("pressure", "critical"): 26, ("pressure", "warning"): 65,
        ("vibration", "critical"): 23, ("vibration", "warning"): 49,
    }
    assert of("alerts_all") == {**rest, ("temperature", "warning"): 21}
    assert of("alerts_all_merged_limits") == {**rest, ("temperature", "critical"): 37, ("temperature", "warning"): 33}


def _expr(text):
    from pyspark.sql import functions as F

    return F.expr(text)
