"""Counters, gauges and rates, computed from the rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the default histogram buckets of the metrics client, in seconds.
DURATION_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
SCRAPE_SECONDS = 15

# Metric name -> labels.
COUNTERS = {
    "telemetry_received_total": ("device_type", "sensor_type"),
    "telemetry_stored_total": ("device_type",),
    "alerts_generated_total": ("alert_type", "severity"),
    "threshold_checks_total": ("sensor_type",),
    "alerts_stored_total": ("alert_type", "severity"),
    "kpis_computed_total": ("kpi_name",),
    "processing_errors_total": ("worker", "error_type"),
}


def counter(rows: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    """Rows counted by label values."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias(value))


def metric(rows: DataFrame, name: str) -> DataFrame:
    return counter(rows, COUNTERS[name])


def active_alerts(alerts: DataFrame, unacked_only: bool = False) -> DataFrame:
    """Gauge 1 for every (device, alert type) that has raised an alert; it never goes back by itself."""
    rows = alerts.where(~F.col("acknowledged")) if unacked_only else alerts
    return rows.select("device_id", "alert_type").distinct().withColumn("value", F.lit(1))


def active_alert_count(alerts: DataFrame, unacked_only: bool = False) -> DataFrame:
    """How many gauges stand at 1; 0 when there are none."""
    return active_alerts(alerts, unacked_only).agg(F.count(F.lit(1)).alias("active_alerts"))


def total(counts: DataFrame, name: str, value: str = "value") -> DataFrame:
    return counts.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def histogram(rows: DataFrame, seconds: str, labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets (``le``), with the sum and the count of observations repeated on each."""
    counts = [F.count_if(F.col(seconds) <= bound).alias(f"b{i}") for i, bound in enumerate(DURATION_BUCKETS)]
    wide = rows.groupBy(*labels).agg(
        *counts, F.sum(seconds).alias("sum_seconds"), F.count(seconds).alias("observations")
    )
    entries = F.array(
        *[F.struct(F.lit(bound).alias("le"), F.col(f"b{i}").alias("bucket")) for i, bound in enumerate(DURATION_BUCKETS)]
    )
    return wide.select(*labels, "sum_seconds", "observations", F.inline(entries))


def rate(
    rows: DataFrame, time: str, window_seconds: int, labels: Sequence[str] = (), step_seconds: int = SCRAPE_SECONDS
) -> DataFrame:
    """Events per second over the last ``window_seconds``, sampled every ``step_seconds``.

    A sample at ``t`` covers ``[t - window, t)``. A series has a sample only where its window holds an
    event. The rows are first counted per step; only those few counts are then copied into the
    windows that contain them, instead of every row into window/step windows.
    """
    if window_seconds % step_seconds:
        raise ValueError("the window must be a whole number of steps")
    step = F.floor(F.unix_seconds(F.date_trunc("second", F.col(time))) / step_seconds)
    per_step = rows.groupBy(*labels, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    samples = F.sequence(F.col("_step") + 1, F.col("_step") + window_seconds // step_seconds)
    return (
        per_step.select(*labels, "_n", F.explode(samples).alias("_sample"))
        .groupBy(*labels, "_sample")
        .agg(F.sum("_n").alias("events"))
        .select(
            F.timestamp_seconds(F.col("_sample") * step_seconds).alias("sample_ts"),
            *labels,
            "events",
            (F.col("events") / window_seconds).alias("per_second"),
        )
    )


def snapshot(job: str | Column, **rows: DataFrame) -> DataFrame:
    """Counters of several metrics as one table (job, metric, labels, value), ready to be appended.

    Name the metrics by the keys of ``COUNTERS``.
    """
    at = job if isinstance(job, Column) else F.lit(job)
    parts = []
    for name, source in rows.items():
        pairs = [part for label in COUNTERS[name] for part in (F.lit(label), F.col(label))]
        parts.append(
            metric(source, name).select(
                at.alias("job"), F.lit(name).alias("metric"), F.create_map(*pairs).alias("labels"), "value"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
