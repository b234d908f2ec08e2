"""Key figures per sensor: one hash aggregate over the readings, then long format."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.upsert import upsert_latest
from pulsegrid.schemas import KPI_KEYS

KPIS = (
    "avg", "min", "max", "count", "std_dev", "range", "rms", "crest_factor", "rate_of_change", "energy",
)


def _order_key() -> Column:
    """(time, event_id) as one fixed-width number.

    A struct would order the same way but is no mutable aggregation buffer: it turns the hash
    aggregate into a sort of all input rows.
    """
    return F.expr("cast(unix_micros(time) AS decimal(19, 0)) * 10000000000000000000BD + coalesce(event_id, 0)")


def kpis_wide(readings: DataFrame, keys: Sequence[str | Column] = KPI_KEYS) -> DataFrame:
    """One row per sensor with every figure as a column, null where it does not apply.

    Partial aggregation on the map side leaves one row per sensor and task for the shuffle, however
    many readings a sensor has.
    """
    v, kind = F.col("v"), F.col("sensor_type")
    n, rms = F.col("sample_count"), F.col("rms")
    grouped = (
        readings.withColumn("_at", F.when(kind == "temperature", _order_key()))
        .groupBy(*keys)
        .agg(
            F.count(v).alias("sample_count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.stddev_samp(v).alias("std_dev"),
            F.sum(v).alias("_sum"),
            F.sum(v * v).alias("_squares"),
            F.max_by(v, F.col("_at")).alias("_last"),
            F.min_by(v, F.col("_at")).alias("_first"),
        )
    )
    return (
        # what follows from other aggregates is not aggregated again: the shuffled rows stay narrow
        grouped.withColumn("avg", F.col("_sum") / n)
        .withColumn("count", n.cast("double"))
        .withColumn("range", F.when(n >= 2, F.col("max") - F.col("min")))
        .withColumn("rms", F.when(kind == "vibration", F.sqrt(F.col("_squares") / n)))
        .withColumn("crest_factor", F.when(rms > 0, F.greatest(F.abs("min"), F.abs("max")) / rms))
        .withColumn("rate_of_change", F.when((kind == "temperature") & (n >= 2), F.col("_last") - F.col("_first")))
        .withColumn("energy", F.when(kind == "power", F.col("_sum")))
        .drop("_sum", "_squares", "_last", "_first")
    )


# what is kept of a sensor's readings in a window; two such rows of one sensor and window are merged by ``merged_partials``
PARTIAL = ("n", "total", "mean", "spread", "squares", "low", "high", "first_at", "first_v", "last_at", "last_v")


def partials(readings: DataFrame, keys: Sequence[str | Column] = KPI_KEYS) -> DataFrame:
    """One row per key: count, sum, mean, squared distance from the mean, sum of squares, bounds, first and last reading."""
    v = F.col("v")
    return (
        readings.withColumn("_at", _order_key())
        .groupBy(*keys)
        .agg(
            F.count(v).alias("n"),
            F.sum(v).alias("total"),
            F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("spread"),
            F.sum(v * v).alias("squares"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.min("_at").alias("first_at"),
            F.min_by(v, F.col("_at")).alias("first_v"),
            F.max("_at").alias("last_at"),
            F.max_by(v, F.col("_at")).alias("last_v"),
        )
    )


def merged_partials(rows: DataFrame, keys: Sequence[str] = KPI_KEYS) -> DataFrame:
    """Partial rows merged to one per key, whatever their number and order.

    The distance between the parts' means is taken as n (mean - pivot)^2 around one of them, the smallest, so large values
    that lie close together lose no digits.
    """
    lowest = rows.groupBy(*keys).agg(F.min("mean").alias("_pivot"))
    away = F.col("mean") - F.col("_pivot")
    grouped = rows.join(lowest, list(keys)).groupBy(*keys, "_pivot").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("spread").alias("_spread"), F.sum(F.col("n") * away).alias("_away"), F.sum(F.col("n") * away * away).alias("_squared"),
        F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first_at").alias("first_at"), F.min_by("first_v", "first_at").alias("first_v"), F.max("last_at").alias("last_at"), F.max_by("last_v", "last_at").alias("last_v"),
    )
    n, moved = F.col("n"), F.col("_away")
    return (
        grouped.withColumn("mean", F.col("_pivot") + moved / n)
        .withColumn("spread", F.col("_spread") + F.greatest(F.col("_squared") - moved * moved / n, F.lit(0.0)))
        .drop("_pivot", "_spread", "_away", "_squared")
    )


def figures(rows: DataFrame) -> DataFrame:
    """The figures of ``kpis_wide`` from one partial row per sensor."""
    n, kind, rms = F.col("n"), F.col("sensor_type"), F.col("rms")
    return (
        rows.withColumn("sample_count", n)
        .withColumn("avg", F.col("total") / n)
        .withColumn("min", F.col("low"))
        .withColumn("max", F.col("high"))
        .withColumn("count", n.cast("double"))
        .withColumn("std_dev", F.when(n >= 2, F.sqrt(F.col("spread") / (n - 1))))
        .withColumn("range", F.when(n >= 2, F.col("high") - F.col("low")))
        .withColumn("rms", F.when(kind == "vibration", F.sqrt(F.col("squares") / n)))
        .withColumn("crest_factor", F.when(rms > 0, F.greatest(F.abs("low"), F.abs("high")) / rms))
        .withColumn("rate_of_change", F.when((kind == "temperature") & (n >= 2), F.col("last_v") - F.col("first_v")))
        .withColumn("energy", F.when(kind == "power", F.col("total")))
        .drop(*PARTIAL)
    )


def kpi(readings: DataFrame, name: str, keys: Sequence[str] = KPI_KEYS) -> DataFrame:
    """One figure for the sensors it applies to; Catalyst drops the aggregates it does not need."""
    return kpis_wide(readings, keys).select(*keys, F.col(name).alias("kpi_value"), "sample_count").where(
        F.col("kpi_value").isNotNull()
    )


def to_long(wide: DataFrame) -> DataFrame:
    """One row per figure, named ``<sensor_type>_<figure>``; figures that do not apply are dropped."""
    ids = [name for name in wide.columns if name not in KPIS]
    return (
        wide.unpivot(ids, list(KPIS), "_kpi", "kpi_value")
        .where(F.col("kpi_value").isNotNull())
        .withColumn("kpi_name", F.concat_ws("_", "sensor_type", "_kpi"))
        .drop("_kpi")
    )


def kpis_long(readings: DataFrame) -> DataFrame:
    return to_long(kpis_wide(readings))


def window_end(scanned: DataFrame) -> Column:
    """Latest time of all scanned rows, with or without a reading, as a scalar subquery."""
    return scanned.select(F.max("time")).scalar()


def kpi_rows(
    readings: DataFrame, start: datetime | Column, end: datetime | Column, created_at: datetime | Column
) -> DataFrame:
    """KPI table rows at sensor grain for a window; the unit is not known."""

    def literal(value: datetime | Column) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return kpis_long(readings).select(
        literal(created_at).alias("created_at"),
        "device_id",
        "device_type",
        "sensor_id",
        "kpi_name",
        "kpi_value",
        F.lit(None).cast("string").alias("unit"),
        literal(start).alias("window_start"),
        literal(end).alias("window_end"),
        "sample_count",
    )


def kpi_rows_of_partials(rows: DataFrame, created_at: datetime) -> DataFrame:
    """KPI table rows from one partial row per window and sensor."""
    return to_long(figures(rows)).select(
        F.lit(created_at).alias("created_at"), "device_id", "device_type", "sensor_id", "kpi_name", "kpi_value",
        F.lit(None).cast("string").alias("unit"), "window_start", "window_end", "sample_count",
    )


def kpi_rows_of_windows(readings: DataFrame, bounds: Sequence[datetime], created_at: datetime) -> DataFrame:
    """KPI table rows of several windows (bound, next bound] at once; readings outside of them are left out."""
    times = F.array(*[F.lit(b) for b in bounds])
    # how many bounds lie before the reading: its window is between the last of them and the next
    place = F.size(F.filter(times, lambda b: b < F.col("time")))
    placed = readings.withColumn("_window", place).where(F.col("_window").between(1, len(bounds) - 1))
    rows = to_long(kpis_wide(placed, ("_window", *KPI_KEYS)))
    start, end = (F.element_at(times, F.col("_window") + step) for step in (0, 1))
    return rows.select(
        F.lit(created_at).alias("created_at"), "device_id", "device_type", "sensor_id", "kpi_name", "kpi_value",
        F.lit(None).cast("string").alias("unit"), start.alias("window_start"), end.alias("window_end"), "sample_count",
    )


def collapse_sensors(rows: DataFrame) -> DataFrame:
    """KPI rows under the upsert key, which has no sensor: of a device's sensors of one type the last wins."""
    keys = ("device_id", "kpi_name", "window_start", "created_at")
    return upsert_latest(rows, keys, ("sensor_id", "device_type")).drop("sensor_id")


def kpis_tumbling(readings: DataFrame, size: str = "5 minutes", lateness: str | None = None) -> DataFrame:
    """KPIs in fixed windows of event time; with ``lateness`` also on an unbounded stream."""
    timed = readings.withWatermark("time", lateness) if lateness else readings
    wide = kpis_wide(timed, (F.window("time", size), *KPI_KEYS))
    return (
        to_long(wide)
        .withColumn("window_start", F.col("window.start"))
        .withColumn("window_end", F.col("window.end"))
        .select("window_start", "window_end", "device_id", "device_type", "sensor_id", "kpi_name", "kpi_value", "sample_count")
    )
