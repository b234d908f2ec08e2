"""Limit ladder of a threshold row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMITS = ("warning_low", "warning_high", "critical_low", "critical_high")

# Checked in this order, the first crossed limit decides: (limit, is upper bound, severity).
LADDER = (
    ("critical_high", True, "critical"),
    ("critical_low", False, "critical"),
    ("warning_high", True, "warning"),
    ("warning_low", False, "warning"),
)
# The limit named in an alert is the first one set in this order, crossed or not.
REPORTED = ("critical_high", "warning_high", "critical_low", "warning_low")


def effective(limit: Column, zero_is_limit: bool = False) -> Column:
    """A limit of 0 means "not set" unless ``zero_is_limit``."""
    return limit if zero_is_limit else F.nullif(limit, F.lit(0.0))


def _ladder(value: Column, limits: Column, result: int, zero_is_limit: bool) -> Column:
    out = F.when(F.isnan(value), F.lit(None))  # NaN crosses nothing, though Spark sorts it highest
    for name, upper, severity in LADDER:
        limit = effective(limits[name], zero_is_limit)
        out = out.when(value > limit if upper else value < limit, (limit, F.lit(severity))[result])
    return out


def severity(value: Column, limits: Column, zero_is_limit: bool = False) -> Column:
    """critical, warning or null; comparisons are strict."""
    return _ladder(value, limits, 1, zero_is_limit)


def breached_limit(value: Column, limits: Column, zero_is_limit: bool = False) -> Column:
    """The limit that was really crossed."""
    return _ladder(value, limits, 0, zero_is_limit)


def reported_limit(limits: Column, zero_is_limit: bool = False) -> Column:
    return F.coalesce(*[effective(limits[name], zero_is_limit) for name in REPORTED])
