"""Record layouts. Wire messages are camelCase JSON, stored tables are snake_case columns."""

from __future__ import annotations

# Wire name -> column name, in the order the stored tables use.
TELEMETRY_FIELDS = {
    "deviceId": "device_id",
    "deviceType": "device_type",
    "sensorId": "sensor_id",
    "sensorType": "sensor_type",
    "unit": "unit",
}
ALERT_FIELDS = {
    "alertId": "alert_id",
    "deviceId": "device_id",
    "deviceType": "device_type",
    "alertType": "alert_type",
    "severity": "severity",
    "message": "message",
}

# Optional entries are read as text and converted afterwards, so that none of them can make a record
# undecodable. ``eventId`` is an optional sequence number of the producer; it breaks ties between readings of
# one sensor that carry the same timestamp. Without a usable one the position in the topic takes its place.
TELEMETRY_MESSAGE = (
    "deviceId STRING, deviceType STRING, sensorId STRING, sensorType STRING, "
    "timestamp STRING, unit STRING, value VARIANT, eventId STRING, _corrupt STRING"
)
ALERT_MESSAGE = (
    "alertId STRING, deviceId STRING, deviceType STRING, alertType STRING, severity STRING, "
    "message STRING, threshold STRING, value STRING, createdAt STRING, _corrupt STRING"
)
LOG_RECORD = (
    "timestamp STRING, level STRING, service STRING, logger STRING, message STRING, "
    "extra STRING, exception STRING, _corrupt STRING"
)

TELEMETRY_TABLE = (
    "event_id BIGINT, time TIMESTAMP, device_id STRING, device_type STRING, sensor_id STRING, "
    "sensor_type STRING, unit STRING, value STRING"
)
ALERT_TABLE = (
    "created_at TIMESTAMP, alert_id STRING, device_id STRING, device_type STRING, alert_type STRING, "
    "severity STRING, message STRING, threshold DOUBLE, value DOUBLE, acknowledged BOOLEAN"
)
THRESHOLD_TABLE = (
    "id INT, sensor_type STRING, device_type STRING, warning_low DOUBLE, warning_high DOUBLE, "
    "critical_low DOUBLE, critical_high DOUBLE"
)
WATERMARK_TABLE = (
    "job_name STRING, last_processed_at TIMESTAMP, window_size INTERVAL DAY TO SECOND, updated_at TIMESTAMP"
)
DEVICE_TABLE = (
    "id STRING, name STRING, type STRING, status STRING, location STRING, created_at TIMESTAMP"
)

SERIES_KEYS = ("device_id", "sensor_id")
KPI_KEYS = ("device_id", "device_type", "sensor_id", "sensor_type")
EVENT_ORDER = ("time", "event_id")
