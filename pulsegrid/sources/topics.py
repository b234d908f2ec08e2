"""Keyed JSON topics: builders for Kafka, with a file format standing in where there is no broker.

Every function takes ``fmt``. With ``kafka`` the record key, value, position and time of arrival come from
the broker; with ``text`` each line of the files under ``path`` is one record value without key and position, and it
arrived when its file was written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Upper bound of one micro-batch. It also bounds what a single sensor can bring into one state update.
DEFAULT_BATCH_RECORDS = 1_000_000
DEFAULT_BATCH_BYTES = 256 * 1024 * 1024


# Fixed rule values of the flush policy: this many records, or what came in this time.
FLUSH_RECORDS = 1000
FLUSH_DELAY = "150ms"


def flush_options(records: int = FLUSH_RECORDS, delay: str = FLUSH_DELAY) -> dict[str, str]:
    """A micro-batch starts once that many records wait, or once the first of them has waited that long."""
    return {"minOffsetsPerTrigger": str(records), "maxTriggerDelay": delay}


def kafka_options(servers: str, topic: str, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **(extra or {})}


def _records(df: DataFrame, fmt: str) -> DataFrame:
    if fmt == "kafka":
        return df.select(
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
            # unique over all partitions, ascending within one
            (F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")).alias("sequence"),
            F.col("timestamp").alias("arrived_at"),
        )
    return df.select(
        F.lit(None).cast("string").alias("key"), "value", F.lit(None).cast("bigint").alias("sequence"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def stream_topic(
    spark: SparkSession,
    fmt: str = "kafka",
    path: str | None = None,
    options: Mapping[str, str] | None = None,
    max_records: int = DEFAULT_BATCH_RECORDS,
    max_bytes: int = DEFAULT_BATCH_BYTES,
    max_files: int | None = None,
    flush: tuple[int, str] | None = None,
) -> DataFrame:
    """Unbounded (key, value, sequence, arrived_at) from the earliest record on, rate limited per micro-batch.

    Files are limited by size, or by number if ``max_files`` is given. ``flush`` (records, delay) makes a Kafka micro-batch
    wait for that many records or for that time, whichever is first, so that small batches do not make small files; the limit
    above still holds. Use it with a trigger shorter than the delay. Files are complete when they appear and need no waiting.
    """
    if fmt == "kafka":
        limits = {"maxOffsetsPerTrigger": str(max_records), **(flush_options(*flush) if flush else {})}
    else:
        limits = {"maxFilesPerTrigger": str(max_files)} if max_files else {"maxBytesPerTrigger": str(max_bytes)}
    reader = spark.readStream.format(fmt).options(**{**limits, **(options or {})})
    return _records(reader.load(path) if path else reader.load(), fmt)


def replay_topic(
    spark: SparkSession, fmt: str = "kafka", path: str | None = None, options: Mapping[str, str] | None = None
) -> DataFrame:
    """The whole topic, earliest to latest, as a batch of (key, value, sequence, arrived_at)."""
    bounds = {"endingOffsets": "latest"} if fmt == "kafka" else {}
    reader = spark.read.format(fmt).options(**{**bounds, **(options or {})})
    return _records(reader.load(path) if path else reader.load(), fmt)


def publish(df: DataFrame, key: str, fields: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, value) records: ``key`` column as the record key, the fields as one JSON object."""
    entries = fields if fields is not None else {name: F.col(name) for name in df.columns}
    body = F.struct(*[column.alias(name) for name, column in entries.items()])
    # Absent optionals are written as null, as the consumers of the topic expect every entry.
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )


def stream_to_topic(
    records: DataFrame, checkpoint: str, fmt: str = "kafka", options: Mapping[str, str] | None = None
) -> DataStreamWriter:
    """Writer for (key, value) records; call ``start()`` on it."""
    out = records if fmt == "kafka" else records.select("value")
    return out.writeStream.format(fmt).options(**(options or {})).option("checkpointLocation", checkpoint)
