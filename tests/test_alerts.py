"""Alert rules, threshold lookup, and exactness of the split of large series."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid import datasets
from pulsegrid.operators import alerts, health, thresholds
from pulsegrid.operators.ordered import with_previous
from pulsegrid.schemas import THRESHOLD_TABLE

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LAYOUT = "event_id long, time timestamp, device_id string, device_type string, sensor_id string, sensor_type string, v double"


def readings(spark, values, sensor_type="power", device_type="motor"):
    rows = [
        (i, START + timedelta(seconds=i), "d1", device_type, f"{sensor_type}-0", sensor_type, v)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, LAYOUT)


def raised(spark, values, kinds=alerts.KINDS, sensor_type="power", **options):
    df = readings(spark, values, sensor_type, options.pop("device_type", "motor"))
    found = alerts.detect(df, datasets.thresholds(spark), F.col("time"), kinds, **options)
    return [(r["event_id"], r["alert_type"]) for r in found.orderBy("event_id", "alert_type").collect()]


def test_first_reading_never_is_a_rapid_change(spark):
    assert raised(spark, [500.0], (alerts.RAPID,)) == []


def test_rapid_change_is_strict(spark):
    assert raised(spark, [0.0, 10.0, 20.5, 10.4], (alerts.RAPID,)) == [(2, "rapid_change"), (3, "rapid_change")]


def test_stuck_sensor_fires_on_the_fifth_and_every_further_reading(spark):
    assert [i for i, _ in raised(spark, [3.0] * 6 + [4.0] * 4, (alerts.STUCK,))] == [4, 5]


def test_nan_raises_nothing(spark):
    nan = float("nan")
    assert raised(spark, [nan, 50.0, nan, nan, nan, nan, nan, nan], sensor_type="temperature") == []


def test_a_null_reading_does_not_break_a_stuck_run(spark):
    from pulsegrid.sources.messages import with_reading

    payloads = ['{"value": 3}'] * 3 + ['{"other": 1}'] + ['{"value": 3}'] * 2
    rows = [(i, START + timedelta(seconds=i), "d", "motor", "s", "power", p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, LAYOUT.replace("v double", "value string"))
    found = alerts.detect(with_reading(df), created_at=F.col("time"), kinds=(alerts.STUCK,))
    assert [r["event_id"] for r in found.collect()] == [5]


def test_one_reading_can_raise_all_three(spark):
    found = raised(spark, [3.0, 96.0, 96.0, 96.0, 96.0, 96.0], sensor_type="humidity")
    assert [kind for i, kind in found if i == 5] == ["stuck_sensor", "threshold_breach"]
    assert [kind for i, kind in found if i == 1] == ["rapid_change", "threshold_breach"]


def test_alert_fields(spark):
    df = readings(spark, [96.5], "humidity")
    row = alerts.detect(df, datasets.thresholds(spark), F.col("time"), (alerts.THRESHOLD,)).first()
    assert (row["severity"], row["threshold"], row["value"], row["breached_limit"]) == ("critical", 95.0, 96.5, 95.0)
    assert row["message"] == "humidity value 96.50 exceeds limit 95.0"
    again = alerts.detect(df, datasets.thresholds(spark), F.col("time"), (alerts.THRESHOLD,)).first()
    assert row["alert_id"] == again["alert_id"] and len(row["alert_id"]) == 64


def test_low_breach_reports_the_first_set_limit(spark):
    merged = alerts.detect(
        readings(spark, [1.0], "temperature"), datasets.thresholds(spark), F.col("time"), (alerts.THRESHOLD,), "merge"
    ).first()
    assert (merged["severity"], merged["threshold"], merged["breached_limit"]) == ("warning", 85.0, 5.0)


def test_duplicate_rows_last_wins_or_merge(spark):
    source = datasets.thresholds(spark)
    last = {(r[0], r[1]): r for r in thresholds.resolve(source).collect()}
    assert last["temperature", None]["warning_high"] is None and last["temperature", None]["warning_low"] == 5.0
    merged = {(r[0], r[1]): r for r in thresholds.resolve(source, "merge").collect()}
    assert merged["temperature", None]["critical_high"] == 85.0 and merged["temperature", None]["warning_low"] == 5.0
    with pytest.raises(ValueError):
        thresholds.resolve(source, "other")


def test_fallback_takes_the_whole_row(spark):
    source = spark.createDataFrame(
        [(1, "pressure", None, 1.0, 8.0, 0.5, 10.0), (2, "pressure", "hvac", None, 3.0, None, None)], THRESHOLD_TABLE
    )
    df = readings(spark, [9.0], "pressure", "hvac").unionByName(readings(spark, [9.0], "pressure", "pump"))
    df = df.unionByName(readings(spark, [9.0], "speed", "pump"))
    rows = {(r["sensor_type"], r["device_type"]): r for r in thresholds.lookup(df, thresholds.resolve(source)).collect()}
    assert rows["pressure", "hvac"]["limits"]["critical_high"] is None
    assert rows["pressure", "pump"]["limits"]["critical_high"] == 10.0
    assert rows["speed", "pump"]["limits"] is None


# --- exactness of the split ---


def brute_force(rows, depth):
    """(key, time, id, value) -> {id: [previous values]}"""
    out, series = {}, {}
    for key, at, number, value in sorted(rows, key=lambda r: (r[1], r[2])):
        before = series.setdefault(key, [])
        out[number] = [before[-i] if len(before) >= i else None for i in range(1, depth + 1)]
        before.append(value)
    return out


def split_case(name):
    rng = random.Random(7)
    if name == "third_of_rows":
        keys = ["hot"] * 400 + [f"k{i % 40}" for i in range(800)]
        return [(k, rng.randrange(10_000), i, float(rng.randrange(3))) for i, k in enumerate(keys)]
    if name == "one_instant":  # every row of the hot series carries the same time
        keys = ["hot"] * 300 + ["cold"] * 30
        return [(k, 5, i, float(rng.randrange(3))) for i, k in enumerate(keys)]
    # chunks shorter than the depth
    return [("hot", i, i, float(i % 2)) for i in range(11)]


@pytest.mark.parametrize("name", ["third_of_rows", "one_instant", "short_chunks"])
@pytest.mark.parametrize("hot_rows", [None, 5, 100])
def test_split_series_equals_brute_force(spark, many_chunks, name, hot_rows):
    rows = split_case(name)
    df = spark.createDataFrame(rows, "key string, at long, number long, v double").repartition(4)
    out = with_previous(df, ("key",), ("at", "number"), "v", 4, hot_rows)
    got = {r["number"]: [r[f"prev_{i}"] for i in range(1, 5)] for r in out.collect()}
    assert got == brute_force(rows, 4)


def test_split_without_keys_spreads_over_tasks(spark, many_chunks):
    rows = split_case("third_of_rows")
    df = spark.createDataFrame(rows, "key string, at long, number long, v double").repartition(4)
    out = with_previous(df, (), ("at", "number"), "v", 2)
    single = [("all", at, number, v) for _, at, number, v in rows]
    assert {r["number"]: [r["prev_1"], r["prev_2"]] for r in out.collect()} == brute_force(single, 2)
    spread = df.repartitionByRange("at", "number").select(F.spark_partition_id()).distinct().count()
    assert spread > 1


@pytest.mark.parametrize("cached", [False, True])
def test_chunks_are_cut_once(spark, many_chunks, cached):
    # every sampling of the range partitions cuts elsewhere, so rows would be lost or doubled if the cuts were made twice
    df = spark.range(20_000).selectExpr("CAST(id % 50 AS STRING) AS key", "hash(id) AS at", "id AS number", "CAST(id % 3 AS DOUBLE) AS v").repartition(7)
    df = df.persist() if cached else df
    want = with_previous(df, ("key",), ("at", "number"), "v", 4, None)
    for _ in range(3):
        out = with_previous(df, ("key",), ("at", "number"), "v", 4, 100)
        assert out.count() == 20_000 and out.exceptAll(want.select(out.columns)).isEmpty()
    df.unpersist()


def test_a_hot_series_decodes_every_payload_once(spark, many_chunks):
    rows = [("hot" if i % 3 else f"k{i}", i, '{"value": 1.5}') for i in range(300)] + [(None, i, '{"value": 2.5}') for i in range(300, 360)]
    decoded = spark.sparkContext.accumulator(0)

    def number(text):
        decoded.add(1)
        return float(text[10:-1])

    raw = spark.createDataFrame(rows, "key string, at long, value string").repartition(3)
    df = raw.withColumn("v", F.udf(number, "double")("value"))
    out = with_previous(df, ("key",), ("at",), "v", 2, 50, sizes=raw)
    got = {r["at"]: [r["prev_1"], r["prev_2"]] for r in out.collect()}
    assert got == brute_force([(key, at, at, float(value[10:-1])) for key, at, value in rows], 2)
    assert decoded.value == len(rows)


def test_without_hot_series_one_shuffle(spark, plan):
    text = plan(alerts.detect(readings(spark, [1.0, 2.0]), datasets.thresholds(spark), F.col("time")))
    assert text.count("Exchange hashpartitioning(device_id") == 1 and "Exchange rangepartitioning" not in text and "Union" not in text


def test_alerts_do_not_depend_on_the_split(spark, many_chunks):
    from pulsegrid.sources.messages import with_reading

    telemetry = datasets.telemetry(spark, "/root/testdata/sf0.001")
    runs = [
        sorted(
            (r["event_id"], r["alert_type"])
            for r in alerts.detect(
                with_reading(telemetry), datasets.thresholds(spark), F.col("time"), hot_rows=limit, sizes=telemetry
            ).collect()
        )
        for limit in (None, 8)
    ]
    assert runs[0] == runs[1] and len(runs[0]) > 600


def test_both_series_rules_share_one_shuffle_and_sort(spark, plan):
    text = plan(alerts.detect(readings(spark, [1.0]), datasets.thresholds(spark), F.col("time"), hot_rows=None))
    assert "Python" not in text
    assert text.count("Exchange hashpartitioning(device_id") == 1
    assert text.count("Window [") == 1
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_threshold_alerts_alone_do_not_shuffle_readings(spark, plan):
    text = plan(alerts.detect(readings(spark, [1.0]), datasets.thresholds(spark), F.col("time"), (alerts.THRESHOLD,)))
    assert "Exchange hashpartitioning(device_id" not in text and "Window" not in text


def test_throughput_first_sample_counts_from_zero(spark):
    rows = [(START, 100), (START + timedelta(seconds=10), 150), (START + timedelta(seconds=20), 150)]
    out = health.throughput_delta(spark.createDataFrame(rows, "sample_ts timestamp, count long")).orderBy("sample_ts")
    assert [(r["delta"], r["per_second"]) for r in out.collect()] == [(100, None), (50, 5.0), (0, 0.0)]


def test_configuration_is_broadcast_only_up_to_its_limit(spark, plan):
    source = spark.createDataFrame([(1, "power", None, None, 1.0, None, 2.0), (2, "power", "motor", None, 1.0, None, 3.0)], THRESHOLD_TABLE)
    df, resolved = readings(spark, [2.5]), thresholds.resolve(source)
    small, large = thresholds.lookup(df, resolved), thresholds.lookup(df, resolved, max_rows=1)
    assert plan(small).count("BroadcastHashJoin") == 2
    assert "BroadcastHashJoin" not in plan(large)
    assert small.first()["limits"] == large.first()["limits"] and small.first()["limits"]["critical_high"] == 3.0
