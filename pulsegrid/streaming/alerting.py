"""Alerting on a stream, in two forms that raise the same alerts.

``stream_alerts`` keeps (last value, length of the run of equal values) per sensor in the state
store. It touches only the sensors that report, which suits short triggers. A micro-batch hands all
its rows of one sensor to one task, which holds a bounded number of them (``streaming.series``).

``start_detecting`` runs the batch rules on each micro-batch together with the last readings of the
sensors in it, kept in buckets of which a batch rewrites those it touches. It needs no Python on the executors and splits a sensor that
dominates a batch, which suits long triggers, backlogs and replays.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.alerts import KINDS, STUCK_READINGS, THRESHOLD, emit, to_rows, with_series_context
from pulsegrid.operators.ordered import HOT_ROWS
from pulsegrid.operators.recent import newest_per
from pulsegrid.operators.thresholds import lookup, resolve
from pulsegrid.operators.upsert import BUCKET, BUCKETS, with_bucket
from pulsegrid.schemas import SERIES_KEYS
from pulsegrid.session import work_dir
from pulsegrid.sources.messages import alert_messages, bad, good, parse_telemetry, with_reading
from pulsegrid.sources.tables import BATCH, DAY, drop_folder, with_day, write_batch
from pulsegrid.sources.topics import stream_to_topic
from pulsegrid.streaming.landing import FLUSH_INTERVAL, start
from pulsegrid.streaming.series import BLOCK_ROWS, HELD_ROWS, ROW, SeriesState, milliseconds, with_processor

WORKER = "stream"


def with_series_state(
    readings: DataFrame,
    stuck_readings: int = STUCK_READINGS,
    forget_after: timedelta | None = None,
    held_rows: int = HELD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Streaming counterpart of ``operators.alerts.with_series_context``.

    With ``forget_after`` the state of a sensor leaves the store that long after its last reading came, by the clock. Such a stream
    runs empty batches to that end; to drain it with ``availableNow``, set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    """
    names = [part.split()[0] for part in ROW.split(", ")]
    rows = (
        readings.withColumn("event_id", F.coalesce("event_id", F.lit(0)))
        .withColumn("at", F.unix_micros("time"))
        .select(*names)
    )
    context = with_processor(rows, SeriesState(stuck_readings, milliseconds(forget_after), held_rows, block_rows))
    return context.withColumn("time", F.timestamp_micros("at")).drop("at")


def stream_alerts(
    readings: DataFrame,
    thresholds: DataFrame,
    created_at: Column | None = None,
    kinds: tuple[str, ...] = KINDS,
    resolve_mode: str = "last",
    forget_after: timedelta | None = None,
    **rules,
) -> DataFrame:
    """Alerts of an unbounded table of readings. Threshold alerts alone need no state."""
    context = readings
    if kinds != (THRESHOLD,):
        context = with_series_state(readings, rules.get("stuck_readings", STUCK_READINGS), forget_after)
    if THRESHOLD in kinds:
        context = lookup(context, resolve(thresholds, resolve_mode), source=thresholds)
    return emit(context, created_at, kinds, **rules)


# The readings of a sensor that later batches still need; ``pos`` counts back from the newest, -1.
TAIL = ROW.replace("at BIGINT", "time TIMESTAMP") + ", pos INT"


class Tails:
    """The last readings of every sensor, in buckets of sensors; a batch writes a new version of the buckets it touches.

    Which version of a bucket counts is known to the running stream, and read from the folders once when it starts. The version
    that a batch started from stays until the next batch has started, so a batch can be repeated after a crash.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions: dict[int, int] | None = None
        self.replaced: list[str] = []
        spark.createDataFrame([], f"{TAIL}, {BUCKET} INT, {BATCH} BIGINT").write.mode("append").partitionBy(BUCKET, BATCH).parquet(path)

    def _folder(self, bucket: int) -> str:
        return f"{self.path}/{BUCKET}={bucket}/{BATCH}={self.versions[bucket]}"

    def before(self, batch_id: int, touched: Sequence[int]) -> DataFrame:
        """What earlier batches left in the touched buckets; other buckets are not opened."""
        if self.versions is None:
            stored = self.spark.read.schema(f"{TAIL}, {BUCKET} INT, {BATCH} BIGINT").parquet(self.path)
            # one row per bucket
            newest = stored.where(F.col(BATCH) < batch_id).groupBy(BUCKET).agg(F.max(BATCH).alias(BATCH))
            self.versions = {row[BUCKET]: row[BATCH] for row in newest.collect()}
        for folder in self.replaced:
            drop_folder(self.spark, folder)
        folders = [self._folder(b) for b in touched if b in self.versions]
        self.replaced = folders
        return self.spark.read.schema(TAIL).parquet(*folders) if folders else self.spark.createDataFrame([], TAIL)

    def write(self, rows: DataFrame, batch_id: int, touched: Sequence[int]) -> None:
        write_batch(rows.repartition(BUCKET), self.path, batch_id, (BUCKET,))
        self.versions.update(dict.fromkeys(touched, batch_id))


def start_detecting(
    readings: DataFrame,
    thresholds: DataFrame,
    table: str,
    tails: str,
    checkpoint: str,
    trigger: str | None = FLUSH_INTERVAL,
    created_at: Column | None = None,
    hot_rows: int | None = HOT_ROWS,
    stuck_readings: int = STUCK_READINGS,
    resolve_mode: str = "last",
    buckets: int = BUCKETS,
    forget_after: timedelta | None = None,
) -> StreamingQuery:
    """Write the alerts of every micro-batch to ``table`` and the sensors' last readings to ``tails``.

    Batch n reads what earlier batches left and writes its own version of the buckets its sensors fall into, and both outputs
    are partitions that a replay overwrites, so a crash at any point repeats the batch with the same result. Rows of
    a batch follow those of earlier batches whatever their time, as in the stateful form. With ``forget_after`` a sensor that
    has not reported for that time, by the newest reading of its bucket, starts anew; its readings leave with the next version.
    """
    spark = readings.sparkSession
    columns = [part.split()[0] for part in TAIL.split(", ")]
    order = ("pos", "time", "event_id")
    kept_tails, scratch = Tails(spark, tails), work_dir(spark, "detecting")

    def detect(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("event_id", F.coalesce("event_id", F.lit(0))).withColumn("pos", F.lit(0)).select(*columns).persist()
        try:
            touched = sorted(row[BUCKET] for row in with_bucket(new, SERIES_KEYS, buckets).select(BUCKET).distinct().collect())
            rows = kept_tails.before(batch_id, touched).unionByName(new)
            if forget_after is not None:
                rows = _recent_series(rows, forget_after, buckets)
            context = with_series_context(rows, stuck_readings, hot_rows, order=order, scratch=scratch).where(F.col("pos") == 0)
            found = emit(lookup(context, resolve(thresholds, resolve_mode), source=thresholds), created_at, stuck_readings=stuck_readings)
            write_batch(with_day(found, "created_at"), table, batch_id, (DAY,))
            last = newest_per(rows, SERIES_KEYS, stuck_readings - 1, order[0], order[1:])
            kept_tails.write(with_bucket(last.withColumn("pos", -F.col("recency")).select(*columns), SERIES_KEYS, buckets), batch_id, touched)
        finally:
            new.unpersist()

    return start(readings.writeStream.foreachBatch(detect).option("checkpointLocation", checkpoint), trigger)


def _recent_series(rows: DataFrame, keep: timedelta, buckets: int) -> DataFrame:
    """New rows, and kept ones that are at most ``keep`` older than the newest row of their bucket."""
    placed = with_bucket(rows, SERIES_KEYS, buckets)
    newest = placed.groupBy(BUCKET).agg(F.max("time").alias("newest_"))
    fresh = placed.join(newest, BUCKET).where((F.col("pos") == 0) | (F.col("time") >= F.col("newest_") - F.lit(keep)))
    return fresh.drop(BUCKET, "newest_")


def telemetry_readings(records: DataFrame, scalar_keys: tuple[str, ...] = ("value",)) -> DataFrame:
    """Topic records as readings; records that fail on parsing or conversion are left out."""
    return with_reading(good(parse_telemetry(records, check_value=True, as_text=False)), scalar_keys)


def start_publishing(
    alerts: DataFrame, checkpoint: str, fmt: str = "kafka", options: dict | None = None, trigger: str | None = FLUSH_INTERVAL
) -> StreamingQuery:
    """Alerts to their topic, keyed by device."""
    return start(stream_to_topic(alert_messages(alerts), checkpoint, fmt, options), trigger)


def start_storing(
    alerts: DataFrame, table: str, checkpoint: str, trigger: str | None = FLUSH_INTERVAL
) -> StreamingQuery:
    """Alert rows to the alert table, one version per micro-batch; repeats inside a batch collapse.

    Read the table through ``upsert_latest`` on (alert_id, created_at) with ``batch_id`` as version.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(with_day(to_rows(batch).dropDuplicates(["alert_id", "created_at"]), "created_at"), table, batch_id, (DAY,))

    return start(alerts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), trigger)


def start_quarantine(records: DataFrame, path: str, checkpoint: str, trigger: str | None = FLUSH_INTERVAL) -> StreamingQuery:
    """The records the alerting path refuses, with the reason; counted by ``processing_errors_total``."""
    refused = bad(parse_telemetry(records, check_value=True), WORKER)
    return start(
        refused.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), trigger
    )
