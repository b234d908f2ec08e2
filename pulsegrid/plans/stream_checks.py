"""The streaming jobs run over the given tables, drained with ``availableNow``.

The events file is the stream source; what the streams write is read back as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import datasets as data
from pulsegrid.schemas import ALERT_TABLE
from pulsegrid.session import pin_utc
from pulsegrid.sources import ledger
from pulsegrid.sources.messages import with_reading
from pulsegrid.sources.tables import file_system
from pulsegrid.sources.topics import DEFAULT_BATCH_BYTES, stream_topic
from pulsegrid.streaming import alerting, landing

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    pin_utc(spark)
    reader = spark.readStream.schema(EVENTS).option("maxBytesPerTrigger", DEFAULT_BATCH_BYTES)
    # a pattern, since a stream takes a plain path for a folder; it finds one file or a folder of files
    return data.as_events(reader.parquet(f"{sf_dir}/events.parque[t]"))


def _drain(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


EXTRA = "sensor_id STRING, sensor_type STRING, time TIMESTAMP, event_id BIGINT, breached_limit DOUBLE"
ALERTS = ALERT_TABLE.replace(", acknowledged BOOLEAN", "") + ", " + EXTRA


def alerts_from_batches(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    readings = with_reading(data.as_telemetry(event_stream(spark, sf_dir)))
    _drain(
        alerting.start_detecting(
            readings, data.thresholds(spark), f"{root}/alerts", f"{root}/tails", f"{root}/checkpoint", None, F.col("time")
        )
    )
    return spark.read.schema(ALERTS).parquet(f"{root}/alerts")


def alerts_from_stream(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    readings = with_reading(data.as_telemetry(event_stream(spark, sf_dir)))
    found = alerting.stream_alerts(readings, data.thresholds(spark), F.col("time"))
    writer = found.writeStream.format("parquet").option("path", f"{root}/alerts")
    _drain(landing.start(writer.option("checkpointLocation", f"{root}/checkpoint"), None))
    return spark.read.schema(ALERTS).parquet(f"{root}/alerts")


def landed_by_stream(spark: SparkSession, sf_dir: str, root: str) -> str:
    records = data.as_messages(event_stream(spark, sf_dir), corrupt=True)
    _drain(landing.start_landing(records, f"{root}/telemetry", f"{root}/quarantine", f"{root}/checkpoint", None))
    return f"{root}/telemetry"


def landed_and_replayed(spark: SparkSession, sf_dir: str, root: str, between: Callable[[str], object]) -> str:
    """Landed, then ``between``, then run again with the last batch not marked as done, as after a crash behind the sink."""
    table = landed_by_stream(spark, sf_dir, root)
    between(table)
    fs, at = file_system(spark, f"{root}/checkpoint/commits")
    last = max((f.getPath() for f in fs.listStatus(at(f"{root}/checkpoint/commits")) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    fs.delete(last, False)
    return landed_by_stream(spark, sf_dir, root)


def _topic(spark: SparkSession, sf_dir: str, root: str, files: int, part: int | None = None) -> str:
    """All messages as lines of a topic's files, or those of one half."""
    rows = data.messages(spark, sf_dir)
    if part is not None:
        rows = rows.where(F.col("sequence") % 2 == part)
    rows.select("value").repartition(files).write.mode("append").text(f"{root}/topic")
    return f"{root}/topic"


def landed_in_flushes(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Seven files, two to a micro-batch; the last batch holds what is left."""
    records = stream_topic(spark, "text", _topic(spark, sf_dir, root, 7), max_files=2)
    query = landing.start_landing(records, f"{root}/telemetry", f"{root}/quarantine", f"{root}/checkpoint", None)
    _drain(query)
    return f"{root}/telemetry"


def landed_and_resumed(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Stopped after half of the topic and started again from its checkpoint: goes on where it was."""
    for part in (0, 1):
        records = stream_topic(spark, "text", _topic(spark, sf_dir, root, 2, part), max_files=1)
        _drain(landing.start_landing(records, f"{root}/telemetry", f"{root}/quarantine", f"{root}/checkpoint", None))
    return f"{root}/telemetry"


def fanned_out(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """What two consumers of one topic, each with a checkpoint of its own, made of all its records."""
    records = data.as_messages(event_stream(spark, sf_dir), corrupt=True)
    land = landing.start_landing(records, f"{root}/telemetry", f"{root}/quarantine", f"{root}/cp-landing", None)
    watch = alerting.start_quarantine(records, f"{root}/refused", f"{root}/cp-watch", None)
    _drain(land)
    _drain(watch)
    stored, refused = ledger.read(spark, f"{root}/telemetry"), spark.read.parquet(f"{root}/refused")
    return stored.select(F.lit("landing").alias("consumer"), F.col("device_type").alias("kind")).unionByName(
        refused.select(F.lit("watching").alias("consumer"), F.col("error_type").alias("kind"))
    ).groupBy("consumer", "kind").agg(F.count(F.lit(1)).alias("records"))
