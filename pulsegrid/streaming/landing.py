"""Landing: topic records into the day-partitioned telemetry table, poison records into quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.metrics import snapshot
from pulsegrid.sources import ledger
from pulsegrid.sources.messages import bad, good, normalize, parse_alerts, parse_telemetry
from pulsegrid.sources.tables import DAY, with_day, write_batch
from pulsegrid.sources.topics import stream_to_topic

# Fixed rule value of the flush policy: this much time per flush, which also flushes the tail. The rows of a flush
# are bounded by the rate limit of the source (``stream_topic``), sized by the cluster.
FLUSH_INTERVAL = "150 milliseconds"
WORKER = "telemetry"
ALERT_WORKER = "alert"


def start(writer, trigger: str | None):
    """Start with a processing-time interval, or with ``None`` drain what is there and stop."""
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The running stream's id, the same after a restart from its checkpoint and another for a new checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint


def start_landing(
    records: DataFrame,
    table: str,
    quarantine: str,
    checkpoint: str,
    trigger: str | None = FLUSH_INTERVAL,
    metrics: str | None = None,
) -> StreamingQuery:
    """Append every good record, duplicates included, and set every bad one aside with its reason.

    The table's ledger commits a micro-batch at once, by the query's id and the batch's number. A batch that is replayed after
    a crash and is committed already, whether compacted since or not, lands no second time, so a row is stored exactly once
    per delivery. The rows lie in one folder per day, whatever the number of batches. A poison record cannot block the batch.
    """
    done: dict[str, int] = {}

    def land(batch: DataFrame, batch_id: int) -> None:
        writer = query_id(batch.sparkSession, checkpoint)
        if writer not in done:
            done[writer] = ledger.last_batch(batch.sparkSession, table, writer)
        parsed = parse_telemetry(batch).persist()
        try:
            stored = good(parsed, keep_arrival=True)
            if batch_id > done[writer]:
                ledger.append(with_day(stored), table, writer, batch_id)
                done[writer] = batch_id
            write_batch(bad(parsed, WORKER), quarantine, batch_id)
            if metrics:
                counts = snapshot(
                    WORKER,
                    telemetry_received_total=stored,
                    telemetry_stored_total=stored,
                    processing_errors_total=bad(parsed, WORKER),
                )
                write_batch(counts.coalesce(1), metrics, batch_id)
        finally:
            parsed.unpersist()

    return start(records.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint), trigger)


def start_storing_alerts(
    records: DataFrame,
    table: str,
    quarantine: str,
    checkpoint: str,
    trigger: str | None = FLUSH_INTERVAL,
    metrics: str | None = None,
) -> StreamingQuery:
    """The alert topic into the alert table by day, not acknowledged yet; poison records are set aside with their reason."""

    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_alerts(batch).persist()
        try:
            rows = good(parsed).withColumn("acknowledged", F.lit(False))
            write_batch(with_day(rows, "created_at"), table, batch_id, (DAY,))
            write_batch(bad(parsed, ALERT_WORKER), quarantine, batch_id)
            if metrics:
                counts = snapshot(ALERT_WORKER, alerts_generated_total=rows, processing_errors_total=bad(parsed, ALERT_WORKER))
                write_batch(counts.coalesce(1), metrics, batch_id)
        finally:
            parsed.unpersist()

    return start(records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint), trigger)


def start_normalizing(
    records: DataFrame, checkpoint: str, fmt: str = "kafka", options: dict | None = None, trigger: str | None = FLUSH_INTERVAL
) -> StreamingQuery:
    """Front door: valid messages, re-serialised and keyed by device, go to the telemetry topic."""
    return start(stream_to_topic(normalize(records).drop("event_id"), checkpoint, fmt, options), trigger)


def without_repeats(telemetry: DataFrame, lateness: str) -> DataFrame:
    """Drops repeated deliveries that arrive within ``lateness`` of each other."""
    return telemetry.withWatermark("time", lateness).dropDuplicatesWithinWatermark(
        ["device_id", "sensor_id", "time", "value"]
    )
