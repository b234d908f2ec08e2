"""Decoding of JSON messages into table rows, with poison records named instead of raised.

A record is bad when it cannot become a row. The name of the error says why:

- ``JSONDecodeError``  the text is no JSON object
- ``KeyError``         a required entry is missing or null
- ``ValueError``       the timestamp, or the text of a scalar, cannot be converted
- ``TypeError``        the value is no object, or an entry has a type that is no number
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.functions.payload import conversion_error, is_object, reading_value
from pulsegrid.functions.text import ISO_MICROS, iso_timestamp
from pulsegrid.operators.joins import checked_broadcast

ARRIVAL = "arrived_at"
_DECODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    A filter on an ordinary computed column is pushed below its projection together with a copy of
    the expression, so JSON would be parsed again for the filter. Rows generated from a one-element
    array are a boundary the optimizer leaves in place, and stay inside whole-stage code generation.
    """
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def decode(records: DataFrame, layout: str, value: str = "value") -> DataFrame:
    """The records with the decoded message as struct column ``msg``."""
    return once(records, msg=F.from_json(F.col(value), layout, _DECODE))


def _undecodable(msg: Column) -> Column:
    return msg.isNull() | msg["_corrupt"].isNotNull()


def _missing(msg: Column, fields: list[str]) -> Column:
    missing = F.lit(False)
    for field in fields:
        missing = missing | msg[field].isNull()
    return missing


def telemetry_error(msg: Column, time: Column, check_value: bool = False) -> Column:
    """Error name of a telemetry message, null for a good one.

    The landing path stores any payload object; ``check_value`` adds the errors of reading the
    payload as a number, which the alerting path meets.
    """
    required = [*schemas.TELEMETRY_FIELDS, "timestamp", "value"]
    error = (
        F.when(_undecodable(msg), "JSONDecodeError")
        .when(_missing(msg, required), "KeyError")
        .when(time.isNull(), "ValueError")
        .when(~is_object(msg["value"]), "TypeError")
    )
    if check_value:
        error = F.coalesce(error, conversion_error(msg["value"], msg["sensorType"]))
    return error


def parse_telemetry(records: DataFrame, check_value: bool = False, as_text: bool = True) -> DataFrame:
    """Topic records as telemetry rows plus ``error_type`` and the original text in ``raw``.

    ``value`` is the payload as JSON text (the stored form), or VARIANT with ``as_text=False``. The producer's own
    id comes before the position in the topic, so a reading that is sent twice keeps its identity. The time of
    arrival stays where the records have one.
    """
    msg = F.col("msg")
    decoded = decode(records, schemas.TELEMETRY_MESSAGE).withColumn("time", iso_timestamp(msg["timestamp"]))
    sequence = F.col("sequence") if "sequence" in records.columns else F.lit(None).cast("bigint")
    checked = once(decoded, error_type=telemetry_error(msg, F.col("time"), check_value))
    return checked.select(
        F.coalesce(F.expr("try_cast(msg.eventId AS BIGINT)"), sequence).alias("event_id"),
        "time",
        *[msg[wire].alias(column) for wire, column in schemas.TELEMETRY_FIELDS.items()],
        (F.to_json(msg["value"]) if as_text else msg["value"]).alias("value"),
        "error_type",
        F.col("value").alias("raw"),
        *_arrival(records),
    )


def _arrival(df: DataFrame) -> list[str]:
    return [ARRIVAL] if ARRIVAL in df.columns else []


def good(parsed: DataFrame, keep_arrival: bool = False) -> DataFrame:
    rows = parsed.where(F.col("error_type").isNull()).drop("error_type", "raw")
    return rows if keep_arrival else rows.drop(ARRIVAL)


def bad(parsed: DataFrame, worker: str) -> DataFrame:
    """Quarantine rows: who met the record, why it was refused, its whole text and when it arrived.

    Identity and time of the message are null where they could not be read.
    """
    kinds = {"event_id": "bigint", "time": "timestamp"}
    known = [F.col(c) if c in parsed.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    return parsed.where(F.col("error_type").isNotNull()).select(
        F.lit(worker).alias("worker"), "error_type", *known, "raw", *_arrival(parsed)
    )


def normalize(records: DataFrame) -> DataFrame:
    """Good messages re-serialised and keyed by device, ready to publish; the front door's work."""
    parsed = good(parse_telemetry(records, as_text=False))
    body = F.struct(
        *[F.col(column).alias(wire) for wire, column in schemas.TELEMETRY_FIELDS.items()],
        F.date_format("time", ISO_MICROS + "'Z'").alias("timestamp"),
        "value",
    )
    return parsed.select(
        "event_id", F.col("device_id").alias("key"), F.to_json(body).alias("value")
    )


def explode_batches(records: DataFrame, value: str = "value") -> DataFrame:
    """One record per entry of a ``{"readings": [...]}`` envelope, the order of entries in ``sequence``.

    The unit is optional inside an envelope.
    """
    entries = F.try_variant_get(F.try_parse_json(F.col(value)), "$.readings", "array<variant>")
    rest = [name for name in records.columns if name not in (value, "sequence")]
    return records.select(*rest, F.posexplode(entries).alias("sequence", "entry")).select(
        *rest, F.col("sequence").cast("bigint").alias("sequence"), F.to_json("entry").alias("value")
    )


def parse_alerts(records: DataFrame) -> DataFrame:
    """Alert messages as rows plus ``error_type`` and ``raw``; threshold and value may be absent."""
    msg = F.col("msg")
    decoded = once(decode(records, schemas.ALERT_MESSAGE), created_at=iso_timestamp(msg["createdAt"]))
    error = (
        F.when(_undecodable(msg), "JSONDecodeError")
        .when(_missing(msg, [*schemas.ALERT_FIELDS, "createdAt"]), "KeyError")
        .when(F.col("created_at").isNull(), "ValueError")
    )
    return decoded.select(
        "created_at",
        *[msg[wire].alias(column) for wire, column in schemas.ALERT_FIELDS.items()],
        F.expr("try_cast(msg.threshold AS DOUBLE)").alias("threshold"),
        F.expr("try_cast(msg.value AS DOUBLE)").alias("value"),
        error.alias("error_type"),
        F.col("value").alias("raw"),
        *_arrival(records),
    )


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alert rows as keyed topic records."""
    from pulsegrid.sources.topics import publish

    fields = {wire: F.col(column) for wire, column in schemas.ALERT_FIELDS.items()}
    fields["threshold"] = F.col("threshold")
    fields["value"] = F.col("value")
    fields["createdAt"] = F.date_format("created_at", ISO_MICROS)
    return publish(alerts, "device_id", fields)


def validate(
    readings: DataFrame, device_types: DataFrame, payload_types: DataFrame, payload_type: str = "payload_type"
) -> DataFrame:
    """Adds ``reject_reason``: null, ``unknown_device_type`` or ``payload_type_mismatch``.

    ``device_types(device_type)`` lists what is allowed; ``payload_types(sensor_type, payload_type)``
    the payload kinds of a sensor type. A sensor type that is not listed may carry any kind. Both are
    configuration tables and are broadcast after a check of their size.
    """
    known = device_types.select("device_type").distinct().withColumn("_known", F.lit(True))
    allowed = payload_types.select("sensor_type", F.col("payload_type").alias(payload_type)).distinct()
    listed = allowed.select("sensor_type").distinct().withColumn("_listed", F.lit(True))
    return (
        readings.join(checked_broadcast(known), "device_type", "left")
        .join(checked_broadcast(listed), "sensor_type", "left")
        .join(checked_broadcast(allowed.withColumn("_allowed", F.lit(True))), ["sensor_type", payload_type], "left")
        .withColumn(
            "reject_reason",
            F.when(F.col("_known").isNull(), "unknown_device_type").when(
                F.col("_listed").isNotNull() & F.col("_allowed").isNull(), "payload_type_mismatch"
            ),
        )
        .drop("_known", "_listed", "_allowed")
    )


def with_reading(
    telemetry: DataFrame, scalar_keys: tuple[str, ...] = ("value",), value: str = "value", keep_null: bool = False
) -> DataFrame:
    """Telemetry rows with the reading as double column ``v``; rows without a reading are dropped.

    ``value`` may be JSON text or VARIANT. The JSON is parsed once per row.
    """
    is_text = dict(telemetry.dtypes)[value] == "string"
    payload = F.try_parse_json(F.col(value)) if is_text else F.col(value)
    out = once(
        telemetry.withColumn("_payload", payload), v=reading_value(F.col("_payload"), F.col("sensor_type"), scalar_keys)
    ).drop("_payload", value)
    return out if keep_null else out.where(F.col("v").isNotNull())
