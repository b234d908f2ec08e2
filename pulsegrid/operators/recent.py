"""Newest-first reads: whole histories, top-k lists, and top-k per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.sources.tables import DAY, file_system, read_table


def newest(df: DataFrame, time: str = "time", tie: Sequence[str] = (), limit: int | None = None, **equal) -> DataFrame:
    """Rows matching ``column=value``, newest first; with ``limit`` a top-k that sorts nothing globally."""
    out = df
    for name, wanted in equal.items():
        out = out.where(F.col(name) == wanted)
    out = out.orderBy(F.desc(time), *[F.desc(name) for name in tie])
    return out.limit(limit) if limit is not None else out


def day_folders(spark: SparkSession, path: str) -> list[str]:
    """The days of a day-partitioned table, newest first, from the names of its folders alone."""
    fs, at = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at(path))]
    return sorted((n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=") and n[-1].isdigit()), reverse=True)


def newest_stored(
    spark: SparkSession, path: str, limit: int, time: str = "time", tie: Sequence[str] = (), where: Column | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """The newest ``limit`` rows of a day-partitioned table, without opening days that cannot hold one.

    A day's rows are all newer than those of the days before it. So days are taken from the newest on, twice as many each time,
    until they hold ``limit`` rows that match; older folders are never read. ``rows`` is the table as read (through its
    ledger, say); rows without time lie in no day and come last.
    """
    table = read_table(spark, path) if rows is None else rows
    table = table if where is None else table.where(where)
    days, taken, step = day_folders(spark, path), 0, 1
    while taken < len(days):
        taken, step = min(taken + step, len(days)), 2 * step
        some = table.where(F.col(DAY) >= F.lit(days[taken - 1]).cast("date"))
        if some.limit(limit).count() >= limit:
            return newest(some, time, tie, limit)
    return newest(table, time, tie, limit)


def newest_per(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    time: str = "time",
    tie: Sequence[str] = (),
    rank: str = "recency",
    spread: int = 1,
) -> DataFrame:
    """The newest ``k`` rows of every key with their rank; at most ``k`` rows per key and task are shuffled.

    With few keys and very many tasks that is still ``k`` x tasks rows for the task of a key. ``spread``
    first takes the newest ``k`` of that many random parts of each key, so the last step sees
    ``k * spread`` rows per key.
    """
    order = [F.desc(time), *[F.desc(name) for name in tie]]
    rows = df
    if spread > 1:
        part = F.pmod(F.xxhash64(time, *tie), F.lit(spread))
        within = Window.partitionBy(*keys, "_part").orderBy(*order)
        rows = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(within))
        rows = rows.where(F.col("_rank") <= k).drop("_part", "_rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def unacknowledged(alerts: DataFrame, tie: Sequence[str] = ("alert_id",)) -> DataFrame:
    """Alerts nobody has acknowledged yet, newest first."""
    return newest(alerts.where(~F.col("acknowledged")), "created_at", tie)


def late_rows(telemetry: DataFrame, watermark: datetime | Column, arrival: str = "arrived_at") -> DataFrame:
    """Rows that arrived after the watermark had passed their time: an incremental job never scans them."""
    at = watermark if isinstance(watermark, Column) else F.lit(watermark)
    return telemetry.where((F.col("time") <= at) & (F.col(arrival) > at)).withColumn(
        "late_by_s", (F.unix_micros(F.col(arrival)) - F.unix_micros(F.col("time"))) / 1_000_000
    )
