"""Alerts from readings: crossed limits, rapid changes, stuck sensors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text
from pulsegrid.functions.limits import breached_limit, reported_limit, severity
from pulsegrid.operators.ordered import HOT_ROWS, previous_columns, with_previous
from pulsegrid.operators.thresholds import lookup, resolve
from pulsegrid.schemas import EVENT_ORDER, SERIES_KEYS

# Fixed rule values.
STUCK_READINGS = 5
RATE_LIMIT = 10.0

THRESHOLD = "threshold_breach"
RAPID = "rapid_change"
STUCK = "stuck_sensor"
KINDS = (THRESHOLD, RAPID, STUCK)

ROW_COLUMNS = (
    "created_at", "alert_id", "device_id", "device_type", "alert_type", "severity", "message", "threshold", "value",
)


def with_series_context(
    readings: DataFrame,
    stuck_readings: int = STUCK_READINGS,
    hot_rows: int | None = HOT_ROWS,
    sizes: DataFrame | None = None,
    order: tuple[str, ...] = EVENT_ORDER,
    scratch: str | None = None,
) -> DataFrame:
    """Adds ``prev_1`` (the sensor's previous reading) and ``stuck`` (the last readings are all equal)."""
    depth = stuck_readings - 1
    context = with_previous(readings, SERIES_KEYS, order, "v", depth, hot_rows, sizes, scratch)
    names = previous_columns(depth)
    equal = ~F.isnan("v")
    for name in names:
        equal = equal & (F.col("v") == F.col(name))
    return context.withColumn("stuck", F.coalesce(equal, F.lit(False))).drop(*names[1:])


def emit(
    context: DataFrame,
    created_at: Column | datetime | None = None,
    kinds: tuple[str, ...] = KINDS,
    rate_limit: float = RATE_LIMIT,
    stuck_readings: int = STUCK_READINGS,
    zero_is_limit: bool = False,
) -> DataFrame:
    """0 to 3 alerts per reading, in the order of ``KINDS``, from one pass over the readings.

    Needs ``limits`` for threshold alerts and ``prev_1``/``stuck`` for the other two.
    """
    v = F.col("v")

    def alert(when: Column, kind: str, level: Column, message: Column, threshold: Column, breached: Column) -> Column:
        fields = F.struct(
            F.lit(kind).alias("alert_type"),
            level.alias("severity"),
            message.alias("message"),
            threshold.cast("double").alias("threshold"),
            breached.cast("double").alias("breached_limit"),
        )
        return F.when(when, fields)

    none, warning = F.lit(None), F.lit("warning")
    found = []
    if THRESHOLD in kinds:
        limits = F.col("limits")
        level = severity(v, limits, zero_is_limit)
        reported = reported_limit(limits, zero_is_limit)
        message = text.breach_message(F.col("sensor_type"), v, reported)
        breached = breached_limit(v, limits, zero_is_limit)
        found.append(alert(level.isNotNull(), THRESHOLD, level, message, reported, breached))
    if RAPID in kinds:
        delta = F.abs(v - F.col("prev_1"))
        message = text.rapid_message(F.col("sensor_type"), delta)
        # NaN compares above every number in Spark but exceeds nothing here
        fires = (delta > rate_limit) & ~F.isnan(delta)
        found.append(alert(fires, RAPID, warning, message, F.lit(rate_limit), F.lit(rate_limit)))
    if STUCK in kinds:
        message = text.stuck_message(F.col("sensor_id"), v, stuck_readings)
        found.append(alert(F.col("stuck"), STUCK, warning, message, none, none))

    at = F.current_timestamp() if created_at is None else created_at
    at = at if isinstance(at, Column) else F.lit(at)
    keys = [F.col(name) for name in ("device_id", "device_type", "sensor_id", "sensor_type", "time", "event_id")]
    exploded = context.select(*keys, v.alias("value"), F.inline(F.array_compact(F.array(*found))))
    return exploded.select(
        at.alias("created_at"),
        text.alert_id(
            F.col("device_id"), F.col("sensor_id"), F.col("time"), F.col("alert_type"), F.col("event_id")
        ).alias("alert_id"),
        *[name for name in ROW_COLUMNS[2:]],
        "sensor_id",
        "sensor_type",
        "time",
        "event_id",
        "breached_limit",
    )


def detect(
    readings: DataFrame,
    thresholds: DataFrame | None = None,
    created_at: Column | datetime | None = None,
    kinds: tuple[str, ...] = KINDS,
    resolve_mode: str = "last",
    rate_limit: float = RATE_LIMIT,
    stuck_readings: int = STUCK_READINGS,
    zero_is_limit: bool = False,
    hot_rows: int | None = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """All alerts of a table of readings (``v`` not null).

    Rapid change and stuck sensor share one shuffle and sort by sensor; very long series are found when this is called. The thresholds are looked up
    after it, so that the limits do not travel through the shuffle. Threshold alerts alone do not
    shuffle at all.
    """
    if THRESHOLD in kinds and thresholds is None:
        raise ValueError("threshold alerts need the threshold table")
    context = readings
    if RAPID in kinds or STUCK in kinds:
        context = with_series_context(context, stuck_readings, hot_rows, sizes)
    if THRESHOLD in kinds:
        context = lookup(context, resolve(thresholds, resolve_mode), source=thresholds)
    return emit(context, created_at, kinds, rate_limit, stuck_readings, zero_is_limit)


def to_rows(alerts: DataFrame) -> DataFrame:
    """Alerts as stored: the table's columns, not yet acknowledged."""
    return alerts.select(*ROW_COLUMNS, F.lit(False).alias("acknowledged"))
