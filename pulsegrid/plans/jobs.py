"""Incremental KPI job with its control table.

The control table keeps one appended row per advance, the newest is the state of a job. Results are
written first, the control row last: a crash in between re-runs the same range, and since a batch is
named by the watermark it starts from, the re-run replaces the half-done batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from time import monotonic

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import kpi
from pulsegrid.operators.joins import checked_broadcast
from pulsegrid.operators.metrics import snapshot
from pulsegrid.operators.upsert import upsert_latest
from pulsegrid.schemas import KPI_KEYS, WATERMARK_TABLE
from pulsegrid.sources import ledger
from pulsegrid.sources.messages import with_reading
from pulsegrid.sources.tables import BATCH, DAY, in_range, with_day, write_batch

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# The jobs known to the control table and the window each stands for.
JOBS = {"kpi_5min": timedelta(minutes=5), "kpi_1hr": timedelta(hours=1)}


def latest_watermarks(control: DataFrame) -> DataFrame:
    """One row per job: the most advanced watermark."""
    return upsert_latest(control, ("job_name",), ("last_processed_at", "updated_at"))


def seed_control(spark: SparkSession, path: str) -> None:
    """Start every known job at 1970-01-01."""
    rows = [(name, EPOCH, size, EPOCH) for name, size in JOBS.items()]
    spark.createDataFrame(rows, WATERMARK_TABLE).coalesce(1).write.mode("append").parquet(path)


def get_watermark(spark: SparkSession, path: str, job_name: str) -> datetime:
    """Where the job stands; 1970-01-01 if the job is not in the table."""
    rows = spark.read.schema(WATERMARK_TABLE).parquet(path).where(F.col("job_name") == job_name)
    micros = rows.agg(F.unix_micros(F.max("last_processed_at"))).first()[0]
    return EPOCH if micros is None else EPOCH + timedelta(microseconds=micros)


def advance_watermark(spark: SparkSession, path: str, job_name: str, to: datetime, updated_at: datetime) -> None:
    """Record the new position; a job without a row gets one. One small file per advance."""
    row = [(job_name, to, JOBS.get(job_name, timedelta(minutes=5)), updated_at)]
    spark.createDataFrame(row, WATERMARK_TABLE).coalesce(1).write.mode("append").parquet(path)


@dataclass(frozen=True)
class JobRun:
    job_name: str
    window_start: datetime
    window_end: datetime | None
    duration_seconds: float

    @property
    def advanced(self) -> bool:
        return self.window_end is not None


def scan_range(telemetry: DataFrame, after: datetime, as_of: datetime) -> DataFrame:
    """The rows of a run: later than the given time, up to now."""
    return in_range(telemetry, after, as_of).select(
        "device_id", "device_type", "sensor_id", "sensor_type", "time", "event_id", "value"
    )


def past_windows(spark: SparkSession, path: str, job_name: str, watermark: datetime, lateness: timedelta) -> list[datetime]:
    """Ascending bounds of the finished windows that rows late by up to ``lateness`` fall into; the last is the watermark.

    A handful of scalars: as many as the job ran within ``lateness``. The first window is taken whole.
    """
    rows = spark.read.schema(WATERMARK_TABLE).parquet(path).where(F.col("job_name") == job_name)
    at = F.col("last_processed_at")
    inside = rows.where((at > F.lit(watermark - lateness)) & (at <= F.lit(watermark))).select(F.unix_micros(at).alias("m"))
    before = rows.where(at <= F.lit(watermark - lateness)).agg(F.unix_micros(F.max(at)).alias("m"))
    micros = {r.m for r in inside.unionByName(before).distinct().collect() if r.m is not None}
    return sorted(EPOCH + timedelta(microseconds=m) for m in micros)


def run_kpi_job(
    spark: SparkSession,
    telemetry: DataFrame,
    kpi_path: str,
    control_path: str,
    as_of: datetime,
    job_name: str = "kpi_5min",
    lateness: timedelta | None = None,
    scalar_keys: tuple[str, ...] = ("value",),
    metrics_path: str | None = None,
) -> JobRun:
    """Compute the KPIs of everything since the last run and move the watermark.

    With ``lateness`` the finished windows that reach into that time before the watermark are computed again from all
    their rows and replace their batches: a late row counts in the window of its time, and every row counts once.
    Only the window bounds reach the driver. An empty range leaves everything as it was. With ``metrics_path`` the
    number of KPIs and the run itself are stored as metrics.
    """
    started = monotonic()
    watermark = get_watermark(spark, control_path, job_name)
    micros = scan_range(telemetry, watermark, as_of).agg(F.unix_micros(F.max("time"))).first()[0]
    if micros is None:
        return JobRun(job_name, watermark, None, monotonic() - started)
    end = EPOCH + timedelta(microseconds=micros)
    bounds = past_windows(spark, control_path, job_name, watermark, lateness) if lateness else []
    bounds = [*bounds, end] if watermark in bounds else [*bounds, watermark, end]
    # rows that arrive between the two scans and are later than ``end`` belong to the next run
    readings = with_reading(scan_range(telemetry, bounds[0], end), scalar_keys)
    rows = kpi.kpi_rows_of_windows(readings, bounds, as_of)
    batch = F.concat(F.lit(f"{job_name}-"), F.date_format("window_start", "yyyyMMdd'T'HHmmssSSSSSS"))
    write_batch(with_day(rows, "window_end"), kpi_path, batch, (DAY,))
    advance_watermark(spark, control_path, job_name, max(end, watermark), as_of)
    run = JobRun(job_name, watermark, end, monotonic() - started)
    if metrics_path:
        name = f"{job_name}-{watermark:%Y%m%dT%H%M%S%f}"
        stored = spark.read.parquet(kpi_path).where(F.col(BATCH) == name)
        write_batch(snapshot("kpi", kpis_computed_total=stored).coalesce(1), f"{metrics_path}/counters", name)
        write_batch(job_runs(spark, [run]).coalesce(1), f"{metrics_path}/runs", name)
    return run


WINDOW = ("window_start", "window_end")
STATE = (
    "window_start TIMESTAMP, window_end TIMESTAMP, device_id STRING, device_type STRING, sensor_id STRING, sensor_type STRING, n BIGINT, total DOUBLE, mean DOUBLE, "
    "spread DOUBLE, squares DOUBLE, low DOUBLE, high DOUBLE, first_at DECIMAL(38,0), first_v DOUBLE, last_at DECIMAL(38,0), last_v DOUBLE, dt DATE, batch_id BIGINT"
)


def finished_windows(spark: SparkSession, control_path: str, job_name: str) -> DataFrame:
    """window_start, window_end and each day that a finished window touches; one row per run and day."""
    ends = spark.read.schema(WATERMARK_TABLE).parquet(control_path).where(F.col("job_name") == job_name)
    ends = ends.select(F.col("last_processed_at").alias("window_end")).distinct()
    # a job's runs in time order: a window of few rows, one per run
    start = F.lag("window_end").over(Window.orderBy("window_end"))
    windows = ends.withColumn("window_start", start).where("window_start is not null")
    days = F.sequence(F.to_date("window_start"), F.to_date("window_end"), F.expr("interval 1 day"))
    # the first window reaches back to 1970; its days before the first reading are no rows of their own
    early = windows.where(F.col("window_start") <= F.lit(EPOCH)).withColumn("day", F.lit(None).cast("date"))
    return windows.where(F.col("window_start") > F.lit(EPOCH)).withColumn("day", F.explode(days)).unionByName(early)


def run_merging_job(
    spark: SparkSession,
    telemetry: DataFrame,
    kpi_path: str,
    state_path: str,
    control_path: str,
    as_of: datetime,
    job_name: str = "kpi_5min",
    arrival: str = "arrived_at",
    scalar_keys: tuple[str, ...] = ("value",),
) -> JobRun:
    """As ``run_kpi_job``, from the rows that arrived since the last run alone, however late they are.

    Rows later than the watermark make a window of their own. An earlier row belongs to the finished window of its time: its
    partial figures are added to that window's, which are kept in the table at ``state_path``, and the window's KPIs are made
    anew from them. So no finished window is read again from telemetry, each reading counts once, and late rows count
    even if nothing newer came. A row counts once both its time and its arrival lie in the past.

    The moment of a run is recorded before anything else and a run that died is finished first, over the same rows: its
    partial figures are committed once, by that moment, and its KPIs replace themselves.
    """
    started = monotonic()
    done, planned = (get_watermark(spark, control_path, f"{job_name}:{mark}") for mark in ("available", "planned"))
    if planned > done:
        as_of = planned
    elif as_of > done:
        advance_watermark(spark, control_path, f"{job_name}:planned", as_of, as_of)
    watermark = get_watermark(spark, control_path, job_name)
    available = F.greatest("time", arrival)
    rows = telemetry.where((available > F.lit(done)) & (available <= F.lit(as_of)))
    rows = rows.select("device_id", "device_type", "sensor_id", "sensor_type", "time", "event_id", "value")
    micros = rows.where(F.col("time") > F.lit(watermark)).agg(F.unix_micros(F.max("time"))).first()[0]
    end = None if micros is None else EPOCH + timedelta(microseconds=micros)
    batch = round((as_of - EPOCH) / timedelta(microseconds=1))
    if batch > ledger.last_batch(spark, state_path, job_name):
        readings = with_reading(rows, scalar_keys).select(*KPI_KEYS, "time", "event_id", "v")
        new = readings.where(F.col("time") > F.lit(watermark)).withColumns({"window_start": F.lit(watermark), "window_end": F.lit(end).cast("timestamp")})
        late = readings.where(F.col("time") <= F.lit(watermark)).withColumn("day", F.to_date("time"))
        windows = finished_windows(spark, control_path, job_name)
        inside = (F.col("time") > F.col("window_start")) & (F.col("time") <= F.col("window_end"))
        by_day = late.join(checked_broadcast(windows.where("day is not null")), "day").where(inside).drop("day")
        first = late.drop("day").join(F.broadcast(windows.where("day is null").drop("day")), inside)
        placed = new.unionByName(by_day).unionByName(first)
        ledger.append(with_day(kpi.partials(placed, (*WINDOW, *KPI_KEYS)), "window_end"), state_path, job_name, batch)
    states = ledger.read(spark, state_path, STATE)
    touched = states.where(F.col(BATCH) == batch).select(*WINDOW, DAY).distinct()
    days = [row[DAY] for row in touched.select(DAY).distinct().collect()]  # one entry per day
    # all sensors of the touched windows, since a window's KPIs are replaced as a whole
    whole = states.where(F.col(DAY).isin(days)).join(touched.drop(DAY), list(WINDOW), "left_semi")
    found = kpi.kpi_rows_of_partials(kpi.merged_partials(whole, (*WINDOW, *KPI_KEYS)), as_of)
    name = F.concat(F.lit(f"{job_name}-"), F.date_format("window_start", "yyyyMMdd'T'HHmmssSSSSSS"))
    write_batch(with_day(found, "window_end"), kpi_path, name, (DAY,))
    if end is not None:
        advance_watermark(spark, control_path, job_name, end, as_of)
    advance_watermark(spark, control_path, f"{job_name}:available", as_of, as_of)
    return JobRun(job_name, watermark, end, monotonic() - started)


def read_kpis(spark: SparkSession, kpi_path: str) -> DataFrame:
    return spark.read.parquet(kpi_path).drop(BATCH, DAY)


def job_runs(spark: SparkSession, runs: list[JobRun]) -> DataFrame:
    """Run records as rows for the job-run table (a handful per invocation)."""
    layout = "job_name STRING, window_start TIMESTAMP, window_end TIMESTAMP, duration_seconds DOUBLE"
    return spark.createDataFrame([(r.job_name, r.window_start, r.window_end, r.duration_seconds) for r in runs], layout)
