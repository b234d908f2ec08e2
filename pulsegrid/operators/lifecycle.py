"""Retention and layout of day-partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.upsert import upsert_latest
from pulsegrid.sources import ledger
from pulsegrid.sources.tables import BATCH, DAY, drop_folder, since

RETENTION = timedelta(days=30)
TOPIC_RETENTION = timedelta(hours=168)
COMPACT_AFTER = timedelta(days=7)
SEGMENT = ("device_id", "sensor_type")


def _at(value: datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def partitions(telemetry: DataFrame, time: str = "time") -> DataFrame:
    """Day partitions with their row count and time bounds."""
    return telemetry.groupBy(F.to_date(time).alias(DAY)).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def retain(df: DataFrame, as_of: datetime | Column, keep: timedelta = RETENTION, time: str = "time") -> DataFrame:
    """Rows that are at most ``keep`` old at ``as_of``; day partitions older than that are not read."""
    return since(df, _at(as_of) - F.lit(keep), time)


def compaction_candidates(
    telemetry: DataFrame, as_of: datetime | Column, after: timedelta = COMPACT_AFTER, time: str = "time"
) -> DataFrame:
    """Segments (day, device, sensor type) of the days that lie wholly before ``as_of - after``."""
    limit = F.to_date(_at(as_of) - F.lit(after))
    old = telemetry.where(F.col(time) < limit.cast("timestamp"))
    if DAY in telemetry.columns:
        old = old.where(F.col(DAY) < limit)
    return old.groupBy(F.to_date(time).alias(DAY), *SEGMENT).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def compact_day(spark: SparkSession, path: str, day: str, target: str, time: str = "time") -> None:
    """Rewrite one day, sorted by segment and time, into ``target``.

    Range partitioning includes the time, so a device that dominates the day is spread over several
    files, each of which still covers a narrow key range for min/max skipping.
    """
    rows = spark.read.parquet(path).where(F.col(DAY) == F.lit(day).cast("date")).drop(BATCH)
    order = (*SEGMENT, time)
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(DAY)
        .parquet(target)
    )


# batch number of compacted rows; no stream counts to it
COMPACTED = -1


def compact_days(spark: SparkSession, path: str, days: Sequence[str], time: str = "time") -> bool:
    """Rewrite what landed on some days, sorted by segment and time; the table's ledger swaps it in at once.

    Readers see either the old rows or the new ones. A batch that is replayed afterwards is known to the ledger and lands no
    second time. ``ledger.tidy`` deletes the replaced files later.
    """
    return ledger.rewrite_days(spark, path, days, (*SEGMENT, time), COMPACTED)


def compact_versions(versions: DataFrame, keys: Sequence[str], version: Sequence[str], target: str) -> None:
    """Rewrite a versioned table to its latest rows, so that reads stop paying for old versions."""
    upsert_latest(versions, keys, version).write.mode("overwrite").parquet(target)


def expired_days(telemetry: DataFrame, as_of: datetime | Column, keep: timedelta = RETENTION) -> DataFrame:
    """Day partitions that hold only rows past their retention, found from the partition column alone."""
    limit = F.to_date(_at(as_of) - F.lit(keep))
    return telemetry.select(DAY).where(F.col(DAY) < limit).distinct()


def drop_expired(spark: SparkSession, path: str, as_of: datetime, keep: timedelta = RETENTION) -> int:
    """Remove the expired day folders of a table; returns how many. The list is one entry per day."""
    days = [row[DAY].isoformat() for row in expired_days(spark.read.parquet(path), as_of, keep).collect()]
    for day in days:
        drop_folder(spark, f"{path.rstrip('/')}/{DAY}={day}")
    return len(days)
