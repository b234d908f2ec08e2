"""Text rules: keys, identities, alert messages, log labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as an instant; text that does not start with a full date gives null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def alert_id(device_id: Column, sensor_id: Column, time: Column, alert_type: Column, event_id: Column) -> Column:
    """The same reading always yields the same identity, so a re-run cannot duplicate an alert."""
    parts = [device_id, sensor_id, F.unix_micros(time).cast("string"), alert_type, event_id.cast("string")]
    return F.sha2(F.concat_ws(":", *parts), 256)


def limit_text(limit: Column) -> Column:
    return limit.cast("string")


def two_decimals(value: Column) -> Column:
    """Two decimals of the exact binary value, ties to even: 2.675 is 2.67 and 0.125 is 0.12.

    ``format_string`` with ``%.2f`` rounds the shortest decimal text half up and differs there.
    """
    return F.call_function("format_number", value, F.lit("0.00"))


def breach_message(sensor_type: Column, value: Column, limit: Column) -> Column:
    return F.concat(sensor_type, F.lit(" value "), two_decimals(value), F.lit(" exceeds limit "), limit_text(limit))


def rapid_message(sensor_type: Column, delta: Column) -> Column:
    return F.concat(sensor_type, F.lit(" changed by "), two_decimals(delta), F.lit(" in one reading"))


def stuck_message(sensor_id: Column, value: Column, readings: int) -> Column:
    return F.concat(sensor_id, F.lit(" stuck at "), two_decimals(value), F.lit(f" for {readings} readings"))


def _first(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


# Fixed patterns of the log formats in use; JSON first, then logfmt, then a bare upper-case level.
JSON_LEVEL = r'"level":\s*"([^"]+)"'
JSON_LEVEL_STRICT = r'"level":"([^"]+)"'
LOGFMT_LEVEL = r"level=([a-zA-Z]+)"
BARE_LEVEL = r"(^|\s)(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)(\s|$)"
JSON_SERVICE = r'"service":\s*"([^"]+)"'
JSON_SERVICE_STRICT = r'"service":"([^"]+)"'
LOGFMT_SERVICE = r"service=(\S+)"


def log_level(line: Column, strict_compat: bool = False) -> Column:
    """JSON levels keep their case, the others are lower-cased; ``info`` when there is none.

    With ``strict_compat`` a blank after the JSON colon is not tolerated.
    """
    return F.coalesce(
        _first(line, JSON_LEVEL_STRICT if strict_compat else JSON_LEVEL, 1),
        F.lower(_first(line, LOGFMT_LEVEL, 1)),
        F.lower(_first(line, BARE_LEVEL, 2)),
        F.lit("info"),
    )


def log_service(line: Column, app: Column, strict_compat: bool = False) -> Column:
    """``service=`` wins over the JSON entry; the app name is the default."""
    return F.coalesce(
        _first(line, LOGFMT_SERVICE, 1),
        _first(line, JSON_SERVICE_STRICT if strict_compat else JSON_SERVICE, 1),
        app,
    )
