"""Metrics, rates, health rules and the device registry."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import devices, health, metrics, recent
from pulsegrid.schemas import DEVICE_TABLE
from pulsegrid.streaming import progress

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_rate_counts_before_it_copies_rows_into_windows(spark, plan):
    rows = [(START + timedelta(seconds=s), "a") for s in (0, 1, 14, 15, 59, 60)]
    df = spark.createDataFrame(rows, "time timestamp, label string")
    out = metrics.rate(df, "time", 60, ("label",))
    got = {int(r["sample_ts"].timestamp()) - int(START.timestamp()): r["events"]
           for r in out.withColumn("sample_ts", F.col("sample_ts")).collect()}
    expected = {}
    for t in range(15, 136, 15):
        n = sum(t - 60 <= s < t for s in (0, 1, 14, 15, 59, 60))
        if n:
            expected[t] = n
    assert got == expected
    text = plan(out)
    assert text.index("Generate") < text.rindex("HashAggregate")  # a count lies below the copying
    with pytest.raises(ValueError):
        metrics.rate(df, "time", 50)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.005,), (0.3,), (42.0,)], "s double")
    rows = {r["le"]: r["bucket"] for r in metrics.histogram(df, "s").collect()}
    assert rows[0.005] == 1 and rows[0.25] == 1 and rows[0.5] == 2 and rows[10.0] == 2 and rows[float("inf")] == 3


def test_active_alerts(spark):
    layout = "device_id string, alert_type string, acknowledged boolean"
    df = spark.createDataFrame([("d", "a", True), ("d", "a", False), ("d", "b", True)], layout)
    assert metrics.active_alert_count(df).first()[0] == 2
    assert metrics.active_alert_count(df, unacked_only=True).first()[0] == 1
    assert metrics.active_alert_count(df.limit(0)).first()[0] == 0
    assert metrics.total(metrics.counter(df.limit(0), ("alert_type",)), "n").first()[0] == 0


def test_snapshot(spark):
    df = spark.createDataFrame([("hvac", "power"), ("hvac", "power")], "device_type string, sensor_type string")
    rows = metrics.snapshot("job", telemetry_received_total=df, telemetry_stored_total=df).collect()
    assert {(r["metric"], tuple(sorted(r["labels"].items())), r["value"]) for r in rows} == {
        ("telemetry_received_total", (("device_type", "hvac"), ("sensor_type", "power")), 2),
        ("telemetry_stored_total", (("device_type", "hvac"),), 2),
    }


def test_lag_and_health(spark):
    report = {"sources": [{"latestOffset": {"t": {"0": 1500, "1": 30}}, "endOffset": {"t": {"0": 400}}}]}
    offsets = progress.offsets(spark, report, "g")
    assert health.with_health(health.consumer_lag(offsets)).first().asDict() == {
        "group_id": "g", "topic": "t", "lag": 1130, "health": "high",
    }
    lags = spark.createDataFrame([(1000,), (100,), (0,), (1001,)], "lag long")
    assert [r["health"] for r in health.with_health(lags).collect()] == ["processing", "healthy", "healthy", "high"]


def test_reconcile(spark):
    sent = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "device_id string, id long")
    stored = sent.where("id not in (3, 9)")
    rows = {r["device_id"]: (r["sent"], r["stored"], r["lost"], r["rate"])
            for r in health.reconcile_counts(sent, stored, "device_id", 2.0).collect()}
    assert rows == {"a": (5, 4, 1, 2.0), "b": (1, 0, 1, 0.0)}
    assert {r["id"] for r in health.lost_records(sent, stored, ("id",)).collect()} == {3, 9}


def test_bottleneck_last_rule_wins(spark):
    layout = "lag long, sent long, errors long, ingestion_cpu long, worker_cpu long, database_cpu long"
    rows = [
        (0, 100, 0, 0, 0, 0), (1001, 100, 0, 0, 0, 0), (1001, 105, 11, 0, 0, 0), (0, 105, 10, 0, 0, 0),
        (1001, 100, 50, 801, 0, 0), (0, 100, 50, 900, 900, 0), (2000, 100, 50, 900, 900, 900), (None, 100, None, None, 900, None),
    ]
    got = [r["bottleneck"] for r in health.bottleneck(spark.createDataFrame(rows, layout)).collect()]
    assert got == ["none", "worker", "ingestion", "none", "ingestion", "worker", "database", "worker"]


def test_tuning(spark):
    rows = [(500, 500, 99), (500, 500, 100), (100, 500, 501), (249, 500, 0), (250, 500, 0)]
    df = spark.createDataFrame(rows, "throughput long, target long, lag long")
    assert [r["decision"] for r in health.tuning_decision(df).collect()] == ["done", "worker", "worker", "ingestion", "worker"]


def test_newest(spark, plan):
    df = spark.createDataFrame([(START + timedelta(hours=i), f"d{i % 2}", i) for i in range(6)], "time timestamp, device_id string, n int")
    assert [r["n"] for r in recent.newest(df, device_id="d1").collect()] == [5, 3, 1]
    top = recent.newest(df, tie=("n",), limit=2)
    assert "TakeOrderedAndProject" in plan(top) and [r["n"] for r in top.collect()] == [5, 4]
    spread = recent.newest_per(df, ("device_id",), 2, tie=("n",), spread=3)
    assert {(r["device_id"], r["recency"], r["n"]) for r in spread.collect()} == {("d0", 1, 4), ("d0", 2, 2), ("d1", 1, 5), ("d1", 2, 3)}
    per = recent.newest_per(df, ("device_id",), 1)
    assert plan(per).count("WindowGroupLimit") == 2  # before and after the shuffle
    assert {(r["device_id"], r["n"]) for r in per.collect()} == {("d0", 4), ("d1", 5)}


# --- devices ---


def registry(spark):
    rows = [("1", "a", "t", "active", "x", START), ("2", "b", "t", "active", None, START)]
    return spark.createDataFrame(rows, DEVICE_TABLE)


def changes(spark, *rows):
    layout = "change_id long, id string, op string, name string, type string, status string, location string, changed_at timestamp"
    return spark.createDataFrame([(i, *row, START + timedelta(hours=i + 1)) for i, row in enumerate(rows)], layout)


def state(df):
    return {r["id"]: (r["name"], r["status"], r["location"]) for r in df.collect()}


def test_create_has_defaults(spark):
    df = spark.createDataFrame([("n", "t", None, None)], "name string, type string, status string, location string")
    row = devices.create(df).first()
    assert row["status"] == "inactive" and len(row["id"]) == 36 and row["created_at"] is not None


def test_get_update_delete(spark):
    base = registry(spark)
    assert devices.get(base, "9").count() == 0 and devices.get(base, "1").count() == 1
    updated = devices.update(base, changes(spark, ("1", "update", "new", "t2", None, None), ("9", "update", "x", "x", None, None)))
    assert state(updated) == {"1": ("new", "inactive", None), "2": ("b", "active", None)}
    assert state(devices.delete(base, changes(spark, ("1", "delete", None, None, None, None)))) == {"2": ("b", "active", None)}


def test_mixed_change_set(spark):
    log = changes(
        spark,
        ("3", "create", "c", "t", "active", "y"),
        ("3", "update", "c2", "t", None, None),
        ("1", "update", "a2", "t", "active", None),
        ("1", "update", "a3", "t", "broken", None),
        ("2", "delete", None, None, None, None),
        ("2", "update", "late", "t", None, None),
        ("8", "update", "unknown", "t", None, None),
        ("4", "create", "d", "t", None, None),
        ("4", "delete", None, None, None, None),
    )
    out = devices.apply_changes(registry(spark), log)
    assert state(out) == {"1": ("a3", "broken", None), "3": ("c2", "inactive", None)}
    born = {r["id"]: r["created_at"] for r in out.withColumn("created_at", F.unix_seconds("created_at")).collect()}
    assert born == {"1": int(START.timestamp()), "3": int(START.timestamp()) + 3600}
