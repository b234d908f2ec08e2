"""Sensor-shaped views of the given tables, so that every query has whole tables to work on.

Each view is a projection (or one aggregation) that Spark derives from the Parquet tables; nothing is
generated on the driver. ``FIXTURES.md`` describes the telemetry view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.functions.text import ISO_MICROS
from pulsegrid.session import pin_utc

# Sensor and unit for each event type; every other type is pressure in bar.
SENSOR_OF_EVENT = {"click": "temperature", "view": "humidity", "purchase": "power", "error": "vibration"}
UNIT_OF_SENSOR = {"temperature": "celsius", "humidity": "percent", "power": "watt", "vibration": "mm/s"}
DEVICE_TYPES = ("motor", "hvac", "pump", "compressor")

# The seeded limits (1 to 5) and one device-specific row.
THRESHOLDS = (
    (1, "temperature", None, None, 70.0, None, 85.0),
    (2, "vibration", None, None, 1.5, None, 2.5),
    (3, "humidity", None, None, 80.0, None, 95.0),
    (4, "pressure", None, None, 8.0, None, 10.0),
    (5, "temperature", None, 5.0, None, 0.0, None),
    (6, "pressure", "hvac", None, 3.0, None, 9.5),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a UTC instant and the number ``k`` of their properties."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("time"),
        "user_id",
        "event_type",
        F.col("value").alias("raw"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _case(on: str, cases: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{value}' THEN '{result}'" for value, result in cases.items())
    return f"CASE {on} {whens} ELSE '{default}' END"


def telemetry_columns(rows: DataFrame) -> DataFrame:
    """Events as telemetry with the payload still as a struct, ``payload``."""
    types = ", ".join(f"'{name}'" for name in DEVICE_TYPES)
    has_value, vibrates = "k % 20 <> 19", "sensor_type = 'vibration'"
    pressure = "CASE WHEN raw < 60 THEN 4.0D ELSE 9.0D + k % 3 END"
    return rows.selectExpr("*", f"{_case('event_type', SENSOR_OF_EVENT, 'pressure')} AS sensor_type").selectExpr(
        "event_id",
        "time",
        "concat('device-', user_id) AS device_id",
        f"element_at(array({types}), cast(user_id % 4 + 1 AS int)) AS device_type",
        "concat_ws('-', sensor_type, if(sensor_type = 'temperature', k % 2, 0)) AS sensor_id",
        "sensor_type",
        f"{_case('sensor_type', UNIT_OF_SENSOR, 'bar')} AS unit",
        f"""named_struct(
            'value', CASE WHEN {has_value} AND NOT {vibrates} THEN if(sensor_type = 'pressure', {pressure}, raw) END,
            'x', CASE WHEN {has_value} AND {vibrates} THEN raw / 40.0D END,
            'y', CASE WHEN {has_value} AND {vibrates} THEN k / 100.0D END,
            'z', CASE WHEN {has_value} AND {vibrates} THEN 0.5D END,
            'reading', CASE WHEN NOT {has_value} THEN raw END) AS payload""",
        "k",
        "raw",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry table: payload as JSON text, as it is stored."""
    return as_telemetry(events(spark, sf_dir))


def as_telemetry(rows: DataFrame) -> DataFrame:
    return telemetry_columns(rows).withColumn("value", F.to_json("payload")).drop("payload", "k", "raw")


def odd_vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vibration readings whose payload lacks an axis, has one that is no number, or is no object at all."""
    number = "format_number(raw, '0.000000')"
    rows = events(spark, sf_dir).withColumn("n", F.expr(number))
    texts = (
        "concat('{\"x\":', n, ',\"y\":3}')", "concat('{\"x\":\"n/a\",\"y\":', n, '}')", "concat('{\"x\":null,\"y\":', n, '}')",
        "concat('[', n, ']')", "concat('{\"x\":\"', n, '\"}')", "concat('{\"other\":', n, '}')", "n",
    )
    cases = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(texts))
    return rows.select("event_id", F.lit("vibration").alias("sensor_type"), F.expr(f"CASE k % {len(texts)} {cases} END").alias("value"))


def thresholds(spark: SparkSession) -> DataFrame:
    """The threshold configuration as a relation of known size."""

    def literal(value: object) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    rows = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in THRESHOLDS)
    names = [part.split() for part in schemas.THRESHOLD_TABLE.split(", ")]
    columns = ", ".join(f"cast(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(names))
    return spark.sql(f"SELECT {columns} FROM VALUES {rows} AS t({', '.join(f'c{i}' for i in range(len(names)))})")


def allowed_types(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Configuration of the front door: known device types, and payload kinds of the sensor types that have fixed ones."""
    device_types = ", ".join(f"('{name}')" for name in DEVICE_TYPES)
    return (
        spark.sql(f"SELECT * FROM VALUES {device_types} AS t(device_type)"),
        spark.sql("SELECT * FROM VALUES ('vibration', 'vibration'), ('power', 'power') AS t(sensor_type, payload_type)"),
    )


def threshold_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a revision of some threshold row, with gaps in limits and device types."""
    k, raw = F.col("k"), F.col("raw")
    device_type = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.col("device_type"))
    return telemetry_columns(events(spark, sf_dir)).select(
        F.col("event_id").alias("id"),
        "sensor_type",
        device_type.alias("device_type"),
        F.when(k % 2 == 0, raw / 4).alias("warning_low"),
        F.when(k % 5 != 0, raw).alias("warning_high"),
        F.when(k % 7 == 0, F.lit(0.0)).alias("critical_low"),
        F.when(k % 2 == 1, raw * 2).alias("critical_high"),
    )


def messages(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Topic records (key, value, sequence); with ``corrupt`` some are broken in each known way."""
    return as_messages(events(spark, sf_dir), corrupt)


def as_messages(rows: DataFrame, corrupt: bool = False) -> DataFrame:
    columns = telemetry_columns(rows)
    stamp = F.date_format("time", ISO_MICROS + "'Z'")
    fields = {wire: F.col(column) for wire, column in schemas.TELEMETRY_FIELDS.items()}

    def record(payload: Column, **replaced: Column) -> Column:
        merged = {**fields, "timestamp": stamp, "value": payload, "eventId": F.col("event_id"), **replaced}
        return F.to_json(F.struct(*[column.alias(name) for name, column in merged.items()]))

    value, k = record(F.col("payload")), F.col("k")
    if corrupt:
        value = (
            F.when(k % 25 == 3, F.expr("'{\"deviceId\":\"device-'"))
            .when(k % 25 == 7, record(F.col("payload"), sensorId=F.lit(None).cast("string")))
            .when(k % 25 == 11, record(F.col("payload"), timestamp=F.lit("2024-13-45T99:00:00Z")))
            .when(k % 25 == 13, record(F.lit(5)))
            .when(k % 25 == 17, record(F.struct(F.lit("n/a").alias("value"), F.lit("n/a").alias("x"))))
            # ids of the producer that are no numbers refuse nothing
            .when(k % 25 == 19, record(F.col("payload"), eventId=F.concat(F.lit("id-"), F.col("event_id"))))
            .when(k % 25 == 21, record(F.col("payload"), eventId=F.col("event_id") + F.lit(0.5)))
            .otherwise(value)
        )
    return columns.select(
        F.col("device_id").alias("key"), value.alias("value"), F.col("event_id").alias("sequence"),
        (F.col("time") + F.expr("INTERVAL 2 SECOND")).alias("arrived_at"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch envelopes: an event and up to two follow-up readings, a second apart, in one record."""
    columns = telemetry_columns(events(spark, sf_dir))
    fields = [F.col(column).alias(wire) for wire, column in schemas.TELEMETRY_FIELDS.items() if wire != "unit"]

    def entry(step: int) -> Column:
        stamp = F.date_format(F.col("time") + F.expr(f"INTERVAL {step} SECOND"), ISO_MICROS + "'Z'")
        value = F.struct(F.lit("scalar").alias("@type"), (F.col("raw") + step).alias("value"))
        return F.struct(*fields, stamp.alias("timestamp"), value.alias("value"))

    readings = F.slice(F.array(entry(0), entry(1), entry(2)), F.lit(1), (F.col("k") % 3 + 1).cast("int"))
    return columns.select(
        "event_id", F.col("device_id").alias("key"), F.to_json(F.struct(readings.alias("readings"))).alias("value")
    )


def typed_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry whose payloads name their ``@type``, some of a kind that does not fit the sensor."""
    columns = telemetry_columns(events(spark, sf_dir))
    raw, k, sensor = F.col("raw"), F.col("k"), F.col("sensor_type")
    kind = (
        F.when(k % 17 == 0, "boolean")
        .when(sensor == "vibration", "vibration")
        .when(sensor == "power", "power")
        .otherwise("scalar")
    )

    def of(wanted: str, value: Column) -> Column:
        return F.when(kind == wanted, value)

    payload = F.struct(
        kind.alias("@type"),
        of("scalar", raw).alias("value"),
        of("vibration", raw / 40).alias("x"),
        of("vibration", k / 100).alias("y"),
        of("vibration", F.lit(0.5)).alias("z"),
        of("power", F.lit(380.0)).alias("voltage"),
        of("power", raw / 10).alias("current"),
        of("power", raw).alias("power"),
        of("power", k / 100).alias("powerFactor"),
        of("boolean", k % 2 == 0).alias("state"),
    )
    device_type = F.when(k % 23 == 0, "prototype").otherwise(F.col("device_type"))
    return columns.select(
        "event_id", "time", "device_id", device_type.alias("device_type"), "sensor_id", "sensor_type",
        F.to_json(payload).alias("value"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as service log lines in the formats the services write, some of them empty."""
    rows = events(spark, sf_dir)
    k = F.col("k")
    name = F.concat(F.lit("svc-"), F.col("user_id") % 7)
    level = F.element_at(F.array(*map(F.lit, ("INFO", "WARN", "ERROR", "DEBUG", "TRACE"))), (k % 5 + 1).cast("int"))
    stamp = F.date_format("time", ISO_MICROS + "'Z'")
    text = F.concat(F.lit("handled "), F.col("event_type"), F.lit(" "), F.col("event_id"))
    line = (
        F.when(k % 20 == 19, F.lit(""))
        .when(k % 5 == 0, F.format_string(
            '{"timestamp": "%s", "level": "%s", "service": "%s", "logger": "main", "message": "%s", "extra": {"user": "%s"}}',
            stamp, level, name, text, F.col("user_id")))
        .when(k % 5 == 1, F.format_string(
            '{"timestamp":"%s","level":"%s","service":"%s","message":"%s"}', stamp, F.lower(level), name, text))
        .when(k % 5 == 2, F.format_string("ts=%s level=%s service=%s msg=ok", stamp, level, name))
        .when(k % 5 == 3, F.format_string("%s %s worker - %s", stamp, level, text))
        .otherwise(F.concat(text, F.lit("\r")))
    )
    return rows.select(
        "event_id",
        F.col("time").alias("ts"),
        F.concat(F.lit("app-"), F.col("user_id") % 3).alias("app"),
        F.concat(F.lit("pod-"), F.col("user_id")).alias("pod"),
        F.when(k % 2 == 0, "plant-a").otherwise("plant-b").alias("namespace"),
        line.alias("line"),
    )


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End and committed offsets per consumer group and partition; groups fall behind differently."""
    rows = events(spark, sf_dir).withColumn("group_id", F.concat(F.lit("group-"), F.col("event_type")))
    return rows.groupBy("group_id", F.lit("telemetry").alias("topic"), (F.col("user_id") % 8).alias("partition")).agg(
        F.count(F.lit(1)).alias("end_offset"),
        F.count_if((F.col("event_type") == "click") | (F.col("k") % 10 != 0)).alias("committed_offset"),
    )


def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as load-test runs with their measured figures."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        (price % 2000).alias("lag"),
        (price % 5000).alias("sent"),
        (F.col("o_custkey") % 400).alias("errors"),
        F.when(key % 11 != 0, key * 7 % 900).alias("ingestion_cpu"),
        (key * 13 % 850).alias("worker_cpu"),
        (key * 17 % 820).alias("database_cpu"),
        (price % 900).alias("throughput"),
        F.lit(500).cast("bigint").alias("target"),
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as job runs with a duration in seconds."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("kpi_"), F.lower("l_returnflag")).alias("job_name"),
        F.col("l_shipdate").cast("timestamp").alias("finished_at"),
        (F.col("l_quantity") * F.col("l_discount") * 4).alias("duration_seconds"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered devices."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("type"),
        F.when(key % 3 == 0, "active").otherwise("inactive").alias("status"),
        F.when(key % 5 != 0, F.concat(F.lit("site-"), F.col("c_nationkey"))).alias("location"),
        F.timestamp_seconds(F.lit(1_600_000_000) + key).alias("created_at"),
    )


def device_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a device change log: creations, updates and deletions, also of unknown ids."""
    key = F.col("o_orderkey")
    op = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.when(key % 4 == 0, "delete").otherwise("update"))
        .when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_custkey") % 10 == 0), "create")
        .otherwise("update")
    )
    shifted = F.when(F.col("o_custkey") % 10 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        key.alias("change_id"),
        shifted.cast("string").alias("id"),
        op.alias("op"),
        F.concat(F.lit("renamed-"), key).alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("status-"), F.col("o_orderstatus"))).alias("status"),
        F.when(key % 2 == 0, F.lit("moved")).alias("location"),
        F.col("o_orderdate").cast("timestamp").alias("changed_at"),
    )
