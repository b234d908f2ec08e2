"""Numbers out of the free-form ``value`` payload, as VARIANT expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def payload(value: Column | str) -> Column:
    """JSON text as VARIANT; text that is no JSON gives null."""
    return F.try_parse_json(F.col(value) if isinstance(value, str) else value)


def number(payload_col: Column, key: str) -> Column:
    """The entry ``key`` as double: numbers, numeric text and booleans convert, the rest is null."""
    return F.try_variant_get(payload_col, f"$.{key}", "double")


def scalar_value(payload_col: Column, scalar_keys: Sequence[str] = ("value",)) -> Column:
    """The scalar reading, from the first of ``scalar_keys`` that is present."""
    return F.coalesce(*[number(payload_col, key) for key in scalar_keys])


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def is_object(payload_col: Column) -> Column:
    return F.schema_of_variant(payload_col).startswith("OBJECT")


def _axis(payload_col: Column, key: str) -> Column:
    """An axis of a vector: 0 if it is missing, null if it is there but no number."""
    entry = F.try_variant_get(payload_col, f"$.{key}", "variant")
    readable = F.when(F.schema_of_variant(entry) != "STRING", number(payload_col, key))
    return F.when(entry.isNull(), 0.0).otherwise(readable)


def vibration_rms(payload_col: Column, sensor_type: Column) -> Column:
    """Length of the three-axis vector, a missing axis counting 0; null for other sensors.

    Also null where the payload is no object, or an axis is null, text or anything else that is no number.
    """
    axes = [_axis(payload_col, axis) for axis in AXES]
    return F.when((sensor_type == "vibration") & is_object(payload_col), magnitude(*axes))


def reading_value(payload_col: Column, sensor_type: Column, scalar_keys: Sequence[str] = ("value",)) -> Column:
    """The one number a payload stands for: vector length for vibration, scalar otherwise."""
    return F.when(sensor_type == "vibration", vibration_rms(payload_col, sensor_type)).otherwise(
        scalar_value(payload_col, scalar_keys)
    )


def conversion_error(payload_col: Column, sensor_type: Column) -> Column:
    """Name of the error a payload raises when it is read as a number, null when it reads cleanly.

    A missing key is not an error (there just is no reading); a null or unconvertible entry is.
    """

    def entry_error(key: str, numeric_text: bool) -> Column:
        entry = F.try_variant_get(payload_col, f"$.{key}", "variant")
        text = F.schema_of_variant(entry) == "STRING"
        bad = number(payload_col, key).isNull() if numeric_text else text
        return (
            F.when(F.is_variant_null(entry), F.lit("TypeError"))
            .when(entry.isNotNull() & bad, F.when(text & F.lit(numeric_text), "ValueError").otherwise("TypeError"))
        )

    return F.when(
        sensor_type == "vibration", F.coalesce(*[entry_error(axis, False) for axis in AXES])
    ).otherwise(entry_error("value", True))


def typed_payload(payload_col: Column) -> list[Column]:
    """Columns of the declared payload kinds, each filled only for its own ``@type``."""
    kind = F.try_variant_get(payload_col, "$['@type']", "string")

    def of(wanted: str, key: str, cast: str = "double") -> Column:
        return F.when(kind == wanted, F.try_variant_get(payload_col, f"$.{key}", cast))

    return [
        kind.alias("payload_type"),
        of("scalar", "value").alias("scalar"),
        *[of("vibration", axis).alias(axis) for axis in AXES],
        of("power", "voltage").alias("voltage"),
        of("power", "current").alias("current"),
        of("power", "power").alias("power"),
        of("power", "powerFactor").alias("power_factor"),
        of("boolean", "state", "boolean").alias("state"),
    ]
