"""Payload extraction, the limit ladder and text rules."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import payload as pay
from pulsegrid.functions import text
from pulsegrid.functions.limits import breached_limit, reported_limit, severity
from pulsegrid.sources.messages import with_reading


@pytest.mark.parametrize(
    "value, sensor, expected",
    [
        ('{"value": 42.5}', "temperature", 42.5),
        ('{"value": 100}', "power", 100.0),
        ('{"value": 61.25, "@type": "scalar"}', "temperature", 61.25),
        # fixed values: inputs whose results must agree
        ('{"x": 3, "y": 4, "z": 0}', "vibration", 5.0),
        ('{"x": 1, "y": 2, "z": 2}', "vibration", 3.0),
        ('{"x": 3}', "vibration", 3.0),
        ('{"reading": 7}', "vibration", 0.0),
        ('{"reading": 7}', "temperature", None),
        ('{"x": 1}', "temperature", None),
        ('{"value": "12.5"}', "temperature", 12.5),
        ('{"value": true}', "temperature", 1.0),
        ('{"value": "n/a"}', "temperature", None),
        ('{"value": null}', "temperature", None),
        ('{"state": false}', "contact", None),
        ("no json", "vibration", None),
        ('{"x":"n/a","y":4}', "vibration", None),
        ('{"x":null,"y":4}', "vibration", None),
        ('{"x":"3","y":4}', "vibration", None),
        ('{"x":[3],"y":4}', "vibration", None),
        ("[1]", "vibration", None),
        ("7", "vibration", None),
        ("{}", "vibration", 0.0),
    ],
)
def test_reading_value(spark, value, sensor, expected):
    df = spark.createDataFrame([(value, sensor)], "value string, sensor_type string")
    assert with_reading(df, keep_null=True).first()["v"] == expected


def test_reading_key_can_be_extended(spark):
    df = spark.createDataFrame([('{"reading": 7}', "temperature")], "value string, sensor_type string")
    assert with_reading(df, ("value", "reading")).first()["v"] == 7.0


def test_vibration_rms_is_null_for_other_sensors(spark):
    df = spark.createDataFrame([('{"x":1,"y":2,"z":3}', "temperature")], "value string, sensor_type string")
    out = df.withColumn("p", pay.payload("value")).select(pay.vibration_rms(F.col("p"), F.col("sensor_type")))
    assert out.first()[0] is None


def test_conversion_errors_by_name(spark):
    rows = [
        ('{"value": 1}', "power", None),
        ('{"other": 1}', "power", None),
        ('{"value": null}', "power", "TypeError"),
        ('{"value": "n/a"}', "power", "ValueError"),
        ('{"value": [1]}', "power", "TypeError"),
        ('{"x": "a"}', "vibration", "TypeError"),
        ('{"x": 1, "y": null}', "vibration", "TypeError"),
        ('{"reading": 1}', "vibration", None),
    ]
    df = spark.createDataFrame(rows, "value string, sensor_type string, expected string")
    out = df.withColumn("p", pay.payload("value")).withColumn(
        "got", pay.conversion_error(F.col("p"), F.col("sensor_type"))
    )
    assert [(r["value"], r["got"]) for r in out.collect()] == [(r[0], r[2]) for r in rows]


def check(spark, rows, **kwargs):
    """(cl, wl, wh, ch, value) -> [(severity, reported, breached)]"""
    df = spark.createDataFrame(
        rows, "critical_low double, warning_low double, warning_high double, critical_high double, v double"
    ).withColumn("l", F.struct("critical_low", "warning_low", "warning_high", "critical_high"))
    out = df.select(
        severity(F.col("v"), F.col("l"), **kwargs),
        reported_limit(F.col("l"), **kwargs),
        breached_limit(F.col("v"), F.col("l"), **kwargs),
    )
    return [tuple(r) for r in out.collect()]


def test_limit_ladder(spark):
    rows = [
        (0.0, 10.0, 30.0, 40.0, 45.0),
        (0.0, 10.0, 30.0, 40.0, 35.0),
        (0.0, 10.0, 30.0, 40.0, 5.0),
        (0.0, 10.0, 30.0, 40.0, 20.0),
        (5.0, 10.0, 30.0, 40.0, -5.0),
        (None, None, 80.0, 95.0, 50.0),
        (None, None, 80.0, 95.0, 85.0),
        (None, None, 80.0, 95.0, 98.0),
        (10.0, 20.0, 80.0, 90.0, 80.0),
        (10.0, 20.0, 80.0, 90.0, 80.1),
        (None, None, None, None, 1e9),
        (None, None, 80.0, 95.0, float("nan")),
    ]
    levels = [r[0] for r in check(spark, rows)]
    assert levels == [
        "critical", "warning", "warning", None, "critical", None, "warning", "critical", None, "warning", None, None,
    ]


def test_zero_limit_is_not_set_unless_asked_for(spark):
    rows = [(0.0, 5.0, None, None, -3.0)]
    assert check(spark, rows) == [("warning", 5.0, 5.0)]
    assert check(spark, rows, zero_is_limit=True) == [("critical", 0.0, 0.0)]


def test_reported_limit_is_the_first_set_not_the_crossed_one(spark):
    assert check(spark, [(5.0, 10.0, 30.0, 40.0, 7.0)]) == [("warning", 40.0, 10.0)]


@pytest.mark.parametrize("value", [2.675, 0.125, 0.375, 1.005, -0.001, 12.0, 1234567.891, 99.995, 0.0, 2.5, 8.125])
def test_two_decimals_round_like_the_binary_value(spark, value):
    got = spark.createDataFrame([(value,)], "v double").select(text.two_decimals(F.col("v"))).first()[0]
    assert got == f"{value:.2f}"


def test_iso_timestamps(spark):
    rows = ["2024-01-15T10:30:00Z", "2024-01-15T12:30:00+02:00", "2024-01-15T10:30:00.123456789Z", "yesterday", "2024", None]
    out = spark.createDataFrame([(r,) for r in rows], "t string").select(
        text.iso_timestamp(F.col("t")).cast("timestamp_ntz").cast("string")
    )
    assert [r[0] for r in out.collect()] == [
        "2024-01-15 10:30:00", "2024-01-15 10:30:00", "2024-01-15 10:30:00.123456", None, None, None,
    ]


@pytest.mark.parametrize(
    "line, level, strict, service",
    [
        ('{"level":"WARN","service":"svc"}', "WARN", "WARN", "svc"),
        ('{"level": "ERROR", "service": "svc"}', "ERROR", "info", "svc"),
        ("ts=1 level=Warn service=s2 x", "warn", "warn", "s2"),
        ("2024-01-01 ERROR worker", "error", "error", "app"),
        ("INFO", "info", "info", "app"),
        ("MYERROR x", "info", "info", "app"),
        ('{"service":"a"} service=b', "info", "info", "b"),
        ("plain", "info", "info", "app"),
    ],
)
def test_log_labels(spark, line, level, strict, service):
    df = spark.createDataFrame([(line,)], "line string")
    c = F.col("line")
    row = df.select(text.log_level(c), text.log_level(c, True), text.log_service(c, F.lit("app"))).first()
    assert tuple(row) == (level, strict, service)


def test_typed_payload(spark):
    rows = [
        ('{"@type": "scalar", "value": 65.5}',),
        ('{"@type": "vibration", "x": 0.12, "y": -0.08, "z": 1.02}',),
        ('{"@type": "power", "voltage": 380.2, "current": 45.8, "power": 17200, "powerFactor": 0.92}',),
        ('{"@type": "boolean", "state": false}',),
    ]
    df = spark.createDataFrame(rows, "value string").withColumn("p", pay.payload("value"))
    out = [r.asDict() for r in df.select(*pay.typed_payload(F.col("p"))).collect()]
    assert out[0]["scalar"] == 65.5 and out[0]["x"] is None
    assert (out[1]["x"], out[1]["y"], out[1]["z"]) == (0.12, -0.08, 1.02)
    assert (out[2]["voltage"], out[2]["current"], out[2]["power"], out[2]["power_factor"]) == (380.2, 45.8, 17200.0, 0.92)
    assert out[3]["state"] is False and out[3]["scalar"] is None
