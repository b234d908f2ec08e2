"""Threshold configuration: duplicate resolution and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.limits import LIMITS, severity
from pulsegrid.operators.joins import CONFIG_ROWS, is_small

KEY = ("sensor_type", "device_type")


def resolve(thresholds: DataFrame, mode: str = "last") -> DataFrame:
    """One row per (sensor_type, device_type), an empty device type counting as none.

    ``last``: the whole row with the highest id replaces earlier ones. ``merge``: rows complete each
    other, per limit the latest one that is set.
    """
    keyed = thresholds.withColumn("device_type", F.nullif("device_type", F.lit("")))
    if mode == "last":
        # limit by limit: a struct is no buffer that a hash aggregate can hold
        return keyed.groupBy(*KEY).agg(*[F.max_by(name, "id").alias(name) for name in LIMITS])
    if mode == "merge":
        picks = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("id"))).alias(name) for name in LIMITS]
        return keyed.groupBy(*KEY).agg(*picks)
    raise ValueError(f"unknown mode {mode!r}: use 'last' or 'merge'")


def lookup(
    readings: DataFrame, resolved: DataFrame, max_rows: int = CONFIG_ROWS, source: DataFrame | None = None
) -> DataFrame:
    """Adds the struct ``limits``: the row of (device type, sensor type), else the sensor type's own row.

    The fallback takes the row as a whole. Readings without any row keep a null ``limits``. With up to
    ``max_rows`` thresholds the readings are not shuffled. The rows are counted on ``source``, the table
    before it was resolved, where it is given: it has no fewer rows and is cheaper to count.
    """
    limits = F.struct(*LIMITS)
    small = is_small(resolved if source is None else source, max_rows)
    specific = resolved.where(F.col("device_type").isNotNull()).select(*KEY, limits.alias("_specific"))
    generic = resolved.where(F.col("device_type").isNull()).select("sensor_type", limits.alias("_generic"))
    if small:
        specific, generic = F.broadcast(specific), F.broadcast(generic)
    return (
        readings.join(specific, list(KEY), "left")
        .join(generic, "sensor_type", "left")
        .withColumn("limits", F.coalesce("_specific", "_generic"))
        .drop("_specific", "_generic")
    )


def check(readings: DataFrame, resolved: DataFrame, zero_is_limit: bool = False) -> DataFrame:
    """Readings with ``severity``, null where nothing is crossed."""
    looked_up = lookup(readings, resolved)
    return looked_up.withColumn("severity", severity(F.col("v"), F.col("limits"), zero_is_limit))

