"""Registered queries: every operator over the whole of the given tables.

Each query takes (spark, sf_dir) and returns a DataFrame. Timestamps leave as ``timestamp_ntz`` (UTC).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import datasets as data
from pulsegrid.functions import payload as pay
from pulsegrid.functions import text
from pulsegrid.functions.limits import breached_limit, reported_limit
from pulsegrid.operators import alerts, devices, health, kpi, lifecycle, metrics, recent, thresholds
from pulsegrid.operators.upsert import deduplicate, merge_into, merge_upsert, read_keyed, upsert_latest
from pulsegrid.plans import jobs, stream_checks
from pulsegrid.session import pin_utc, work_dir
from pulsegrid.sources import ledger, logs, messages, tables, topics

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered runs: the incremental range and the moment taken as "now".
WATERMARK = datetime(2024, 1, 10, tzinfo=timezone.utc)
UNTIL = datetime(2024, 1, 20, tzinfo=timezone.utc)
AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and doubles at six digits, the form results are compared in."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "timestamp":
            out[name] = F.col(name).cast("timestamp_ntz")
        elif kind == "double":
            out[name] = F.round(name, 6)
    return df.withColumns(out) if out else df


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_utc(spark)
        return plain(function(spark, sf_dir))

    run.__doc__, run.__name__ = function.__doc__, function.__name__
    REGISTRY[function.__name__] = run
    return function


# --- inputs shared by the queries ------------------------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.with_reading(data.telemetry(spark, sf_dir))


def all_alerts(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = alerts.KINDS) -> DataFrame:
    """Alerts of the whole table, stamped with the time of their reading so that runs are repeatable."""
    telemetry = data.telemetry(spark, sf_dir)
    return alerts.detect(
        messages.with_reading(telemetry), data.thresholds(spark), F.col("time"), kinds, sizes=telemetry
    )


def alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts, a part of them acknowledged."""
    return alerts.to_rows(all_alerts(spark, sf_dir)).withColumn("acknowledged", F.col("value") < 30)


def ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.in_range(data.telemetry(spark, sf_dir), WATERMARK, UNTIL)


def kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of the first run of the job, over all telemetry."""
    whole = data.telemetry(spark, sf_dir)
    return kpi.kpi_rows(messages.with_reading(whole), jobs.EPOCH, kpi.window_end(whole), AS_OF)


def kpi_range_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of a run between two watermarks."""
    scanned = ranged(spark, sf_dir)
    return kpi.kpi_rows(messages.with_reading(scanned), WATERMARK, kpi.window_end(scanned), UNTIL)


def poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.bad(
        messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True), check_value=True), "stream"
    )


def stored_numbers(rows: DataFrame) -> DataFrame:
    """Telemetry rows with the entries of their JSON text as columns instead of the text."""
    entries = F.from_json("value", "value DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, reading DOUBLE")
    kept = [name for name in rows.columns if name not in ("value", messages.ARRIVAL)]
    return rows.select(*kept, entries.alias("e")).select(*kept, F.col("e.value").alias("scalar"), "e.x", "e.y", "e.z", "e.reading")


ALERT_OUT = (
    "event_id", "time", "device_id", "device_type", "sensor_id", "alert_type", "severity", "message", "threshold",
    "value", "breached_limit",
)

# --- scans, sources, sinks ---------------------------------------------------------------------------


@query
def telemetry_scan(spark, sf_dir):
    """Topic records decoded into the telemetry table, the stored payload read back as numbers."""
    return stored_numbers(messages.good(messages.parse_telemetry(data.messages(spark, sf_dir))))


@query
def topic_replay(spark, sf_dir):
    """A topic of all messages, replayed from the beginning and counted by device."""
    path = work_dir(spark, "topic")
    data.messages(spark, sf_dir).select("value").write.text(path)
    rows = messages.good(messages.parse_telemetry(topics.replay_topic(spark, "text", path), as_text=False))
    return rows.groupBy(F.col("device_id").alias("key")).agg(
        F.count(F.lit(1)).alias("records"), F.min("event_id").alias("first_seq"), F.max("event_id").alias("last_seq")
    )


@query
def alert_source(spark, sf_dir):
    """Alert messages decoded back into rows."""
    records = messages.alert_messages(all_alerts(spark, sf_dir))
    return messages.parse_alerts(records).where(F.col("error_type").isNull()).drop("error_type", "raw")


@query
def alert_publish(spark, sf_dir):
    """Alert records per key, with the entries of their JSON body."""
    records = messages.alert_messages(all_alerts(spark, sf_dir))
    body = F.from_json("value", "alertType STRING, severity STRING, createdAt STRING, value DOUBLE")
    return records.select("key", body.alias("body")).select("key", "body.*")


@query
def ingest_normalize(spark, sf_dir):
    """Good messages re-serialised and keyed by device; malformed ones are rejected."""
    out = messages.normalize(data.messages(spark, sf_dir, corrupt=True))
    body = F.from_json("value", "sensorId STRING, sensorType STRING, unit STRING, timestamp STRING")
    return out.select("event_id", "key", body.alias("body")).select("event_id", "key", "body.*")


@query
def telemetry_append(spark, sf_dir):
    """Landed rows by day partition, written to and read back from a table."""
    path = work_dir(spark, "telemetry")
    rows = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True)))
    tables.append_rows(rows, path)
    return stored_numbers(tables.read_table(spark, path))


@query
def bulk_append(spark, sf_dir):
    """Two appends of the same rows: a plain append keeps duplicates."""
    path = work_dir(spark, "bulk")
    rows = data.telemetry(spark, sf_dir)
    for _ in range(2):
        tables.append_rows(rows, path)
    return stored_numbers(tables.read_table(spark, path)).drop("dt")


@query
def upsert_latest_rows(spark, sf_dir):
    """Latest reading of every sensor, last write wins."""
    return upsert_latest(readings(spark, sf_dir), ("device_id", "sensor_id"), ("time", "event_id"))


REGISTRY["upsert_latest"] = REGISTRY.pop("upsert_latest_rows")


@query
def upsert_by_bucket(spark, sf_dir):
    """Latest reading of every sensor, merged into a bucketed table in four batches, the last of which is delivered twice."""
    path, rows = f"{work_dir(spark, 'keyed')}/table", readings(spark, sf_dir)
    week = F.least(F.expr("(day(time) - 1) div 8"), F.lit(3))
    for batch in (0, 1, 2, 3, 3):
        merge_into(spark, path, rows.where(week == batch), ("device_id", "sensor_id"), ("time", "event_id"), "telemetry", batch, buckets=16)
    return read_keyed(spark, path)


@query
def alerts_upsert_by_bucket(spark, sf_dir):
    """The alert table and a second delivery of all its alerts merged by bucket: rows are replaced, acknowledgement stays."""
    path, keys = f"{work_dir(spark, 'keyed')}/table", ("alert_id", "created_at")
    again = all_alerts(spark, sf_dir).withColumn("message", F.concat(F.lit("again: "), F.col("message")))
    merge_into(spark, path, alert_table(spark, sf_dir).withColumn("version", F.lit(0)), keys, ("version",), "alerts", 0, buckets=16)
    merge_into(spark, path, alerts.to_rows(again).withColumn("version", F.lit(1)), keys, ("version",), "alerts", 1, keep=("acknowledged",), buckets=16)
    return read_keyed(spark, path).select("alert_id", "created_at", "device_id", "alert_type", "severity", "message", "threshold", "value", "acknowledged")


@query
def alerts_upsert(spark, sf_dir):
    """Alert table after a second delivery of all its alerts: rows are replaced, acknowledgement stays."""
    current = alert_table(spark, sf_dir)
    again = all_alerts(spark, sf_dir).withColumn("message", F.concat(F.lit("again: "), F.col("message")))
    incoming = alerts.to_rows(again).withColumn("version", F.lit(1))
    merged = merge_upsert(current, incoming, ("alert_id", "created_at"), ("version",), keep=("acknowledged",))
    return merged.select("alert_id", "created_at", "device_id", "alert_type", "severity", "message", "threshold", "value", "acknowledged")


@query
def kpis_upserted(spark, sf_dir):
    """KPI rows under the upsert key without sensor: of two sensors of a type the last one stays."""
    return kpi.collapse_sensors(kpi_table(spark, sf_dir)).drop("unit")


@query
def param_query(spark, sf_dir):
    """SQL with named parameters over telemetry."""
    sql = """
        SELECT device_id, sensor_type, count(*) AS readings, min(time) AS first_time, max(time) AS last_time
        FROM {telemetry} WHERE time > :after AND time <= :until GROUP BY device_id, sensor_type
    """
    bounds = {"after": WATERMARK, "until": UNTIL}
    return tables.param_query(spark, sql, bounds, telemetry=data.telemetry(spark, sf_dir))


@query
def telemetry_range(spark, sf_dir):
    """Half-open time range of telemetry, the columns the KPI job reads."""
    return ranged(spark, sf_dir).select("event_id", "time", "device_id", "device_type", "sensor_id", "sensor_type")


@query
def watermark_update(spark, sf_dir):
    """Control rows after every day of telemetry advanced the watermark of its job in turn."""
    return jobs.latest_watermarks(_control(spark, sf_dir)).drop("updated_at")


@query
def watermark_get(spark, sf_dir):
    """Watermark each job would start from, 1970 for a job without a row."""
    sensors = data.telemetry(spark, sf_dir).select(F.concat(F.lit("kpi_"), "sensor_type").alias("job_name")).distinct()
    control = jobs.latest_watermarks(_control(spark, sf_dir)).where(F.col("job_name") != "kpi_pressure")
    return sensors.join(control.select("job_name", "last_processed_at"), "job_name", "left").select(
        "job_name", F.coalesce("last_processed_at", F.lit(jobs.EPOCH)).alias("last_processed_at")
    )


def _control(spark, sf_dir):
    rows = data.telemetry(spark, sf_dir)
    return rows.groupBy(
        F.concat(F.lit("kpi_"), F.col("sensor_type")).alias("job_name"), F.to_date("time").alias("day")
    ).agg(F.max("time").alias("last_processed_at")).select(
        "job_name", "last_processed_at", F.col("day").cast("timestamp").alias("updated_at")
    )


@query
def thresholds_resolved(spark, sf_dir):
    """Threshold revisions resolved to one row per key, the last revision winning."""
    return thresholds.resolve(data.threshold_revisions(spark, sf_dir))


@query
def thresholds_merged(spark, sf_dir):
    """Threshold revisions merged limit by limit."""
    return thresholds.resolve(data.threshold_revisions(spark, sf_dir), "merge")


@query
def logs_scan(spark, sf_dir):
    """Non-empty log lines by app and pod."""
    return logs.scan(data.log_lines(spark, sf_dir)).select("event_id", "ts", "app", "pod", "line")


@query
def logs_enriched(spark, sf_dir):
    """Stored log rows with their five labels."""
    return logs.to_stream_rows(logs.enrich(data.log_lines(spark, sf_dir), F.col("namespace")))


@query
def metrics_snapshot(spark, sf_dir):
    """Counters of the KPI job and of landing as one table."""
    return metrics.snapshot(
        "kpi",
        kpis_computed_total=kpi_table(spark, sf_dir).select("kpi_name"),
        telemetry_received_total=data.telemetry(spark, sf_dir),
    ).select(
        "job", "metric", F.array_join(F.array_sort(F.map_values("labels")), ",").alias("label_values"), "value"
    )


# --- parsing and scalar functions --------------------------------------------------------------------


@query
def telemetry_parse(spark, sf_dir):
    """Messages as rows with every payload entry as a number."""
    rows = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir), as_text=False))
    entries = [pay.number(F.col("value"), key).alias(name) for key, name in
               (("value", "scalar"), ("x", "x"), ("y", "y"), ("z", "z"), ("reading", "reading"))]
    return rows.select(*[name for name in rows.columns if name != "value"], *entries)


@query
def scalar_value(spark, sf_dir):
    """Scalar entry of every payload, null where there is none."""
    rows = data.telemetry(spark, sf_dir).withColumn("p", pay.payload("value"))
    return rows.select("event_id", pay.scalar_value(F.col("p")).alias("scalar"))


@query
def vibration_rms(spark, sf_dir):
    """Vector length of vibration payloads, null for other sensors."""
    rows = data.telemetry(spark, sf_dir).withColumn("p", pay.payload("value"))
    return rows.select("event_id", pay.vibration_rms(F.col("p"), F.col("sensor_type")).alias("rms"))


@query
def reading_value(spark, sf_dir):
    """The reading of every telemetry row that has one."""
    return readings(spark, sf_dir).select("event_id", "sensor_type", "v")


@query
def kpi_value_extract(spark, sf_dir):
    """Readings with the extended scalar keys, rows without one included."""
    rows = messages.with_reading(data.telemetry(spark, sf_dir), ("value", "reading"), keep_null=True)
    return rows.select("event_id", "v")


@query
def reading_of_odd_payloads(spark, sf_dir):
    """Readings of vibration payloads with an axis missing, null or text, and of payloads that are no objects."""
    rows = data.odd_vibration(spark, sf_dir)
    return messages.with_reading(rows, keep_null=True).select("event_id", "v")


@query
def telemetry_rows(spark, sf_dir):
    """Stored rows of a topic with ids that are no numbers: the payload is JSON text again, here read back as numbers."""
    return stored_numbers(messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True))))


@query
def alert_to_message(spark, sf_dir):
    """Entries of the alert messages, time as ISO text."""
    layout = "alertId STRING, deviceId STRING, deviceType STRING, message STRING, threshold DOUBLE, createdAt STRING"
    body = F.from_json("value", layout)
    return messages.alert_messages(all_alerts(spark, sf_dir)).select(body.alias("m")).select("m.*")


@query
def alert_rows(spark, sf_dir):
    """Alert table rows, none acknowledged yet."""
    return alerts.to_rows(all_alerts(spark, sf_dir))


def alert_records(spark, sf_dir):
    """Alert messages, some without the optional entries, some without a required one."""
    return messages.alert_messages(all_alerts(spark, sf_dir)).select(
        F.when(F.col("value").contains('"stuck_sensor"'), F.replace(F.col("value"), F.lit('"severity"'), F.lit('"level"')))
        .otherwise(F.regexp_replace("value", r'"threshold":[^,]*,', ""))
        .alias("value")
    )


@query
def alert_parse(spark, sf_dir):
    """Alert messages as rows with their error, if any."""
    return messages.parse_alerts(alert_records(spark, sf_dir)).drop("raw")


@query
def alert_messages(spark, sf_dir):
    """Text of every alert."""
    return all_alerts(spark, sf_dir).select("event_id", "alert_type", "message")


@query
def alert_identity(spark, sf_dir):
    """Repeatable identity of every alert."""
    return all_alerts(spark, sf_dir).select("event_id", "alert_type", "alert_id", "created_at")


@query
def log_level(spark, sf_dir):
    """Level of every line, tolerant and strict reading of the JSON form."""
    lines = logs.scan(data.log_lines(spark, sf_dir))
    return lines.select(
        "event_id", text.log_level(F.col("line")).alias("level"), text.log_level(F.col("line"), True).alias("strict_level")
    )


@query
def log_service(spark, sf_dir):
    """Service of every line."""
    lines = logs.scan(data.log_lines(spark, sf_dir))
    return lines.select("event_id", text.log_service(F.col("line"), F.col("app")).alias("service"))


@query
def log_records(spark, sf_dir):
    """Structured log records as columns."""
    rows = logs.parse_records(data.log_lines(spark, sf_dir))
    return rows.select(
        "event_id", "logged_at", "level", "service", "logger", "message", F.col("extra")["user"].alias("extra_user"), "exception"
    )


@query
def log_lines_refused(spark, sf_dir):
    """Lines that are no structured record, with the reason: nothing is lost."""
    return logs.refused_lines(data.log_lines(spark, sf_dir)).select("event_id", "app", "error_type", "raw")


@query
def ingest_batch_explode(spark, sf_dir):
    """Readings out of batch envelopes."""
    records = messages.explode_batches(data.envelopes(spark, sf_dir))
    body = F.from_json(
        "value", "deviceId STRING, sensorId STRING, timestamp TIMESTAMP, value STRUCT<`@type`: STRING, value: DOUBLE>"
    )
    return records.select("event_id", "sequence", body.alias("b")).select(
        "event_id", "sequence", F.col("b.deviceId").alias("device_id"), F.col("b.sensorId").alias("sensor_id"),
        F.col("b.timestamp").alias("time"), F.col("b.value.value").alias("value"),
    )


@query
def typed_payload(spark, sf_dir):
    """Payload columns by declared type."""
    rows = data.typed_telemetry(spark, sf_dir).withColumn("p", pay.payload("value"))
    return rows.select("event_id", *pay.typed_payload(F.col("p")))


# --- filters -------------------------------------------------------------------------------------------


@query
def threshold_check(spark, sf_dir):
    """Severity, reported and crossed limit of every reading, null where nothing is crossed."""
    checked = thresholds.check(readings(spark, sf_dir), thresholds.resolve(data.thresholds(spark)))
    return checked.select(
        "event_id",
        "severity",
        reported_limit(F.col("limits")).alias("reported_limit"),
        breached_limit(F.col("v"), F.col("limits")).alias("breached_limit"),
    )


@query
def bad_records(spark, sf_dir):
    """Refused records with the name of their error."""
    return poison(spark, sf_dir).drop("raw")


@query
def ingest_validate(spark, sf_dir):
    """Readings with the reason for refusing them, if any."""
    rows = data.typed_telemetry(spark, sf_dir)
    kind = F.try_variant_get(pay.payload("value"), "$['@type']", "string")
    device_types, payload_types = data.allowed_types(spark)
    checked = messages.validate(rows.withColumn("payload_type", kind), device_types, payload_types)
    return checked.select("event_id", "device_type", "sensor_type", "payload_type", "reject_reason")


@query
def recent_by_device(spark, sf_dir):
    """Newest five rows of every device."""
    rows = recent.newest_per(data.telemetry(spark, sf_dir), ("device_id",), 5, tie=("event_id",))
    return rows.select("device_id", "recency", "event_id", "time", "sensor_id")


@query
def recent_by_sensor_type(spark, sf_dir):
    """Newest hundred rows of every sensor type."""
    rows = recent.newest_per(data.telemetry(spark, sf_dir), ("sensor_type",), 100, tie=("event_id",), spread=16)
    return rows.select("sensor_type", "recency", "event_id", "time", "device_id")


@query
def recent_kpis(spark, sf_dir):
    """Newest three KPI windows per device and name, over hourly KPIs."""
    rows = kpi.kpis_tumbling(readings(spark, sf_dir), "1 hour")
    return recent.newest_per(rows, ("device_id", "kpi_name"), 3, "window_start", ("sensor_id",)).select(
        "device_id", "kpi_name", "recency", "window_start", "sensor_id", "kpi_value"
    )


@query
def recent_kpis_by_name(spark, sf_dir):
    """Newest twenty hourly KPI rows of every name."""
    rows = kpi.kpis_tumbling(readings(spark, sf_dir), "1 hour")
    return recent.newest_per(rows, ("kpi_name",), 20, "window_start", ("device_id", "sensor_id"), spread=16).select(
        "kpi_name", "recency", "window_start", "device_id", "sensor_id", "kpi_value"
    )


@query
def recent_alerts_by_severity(spark, sf_dir):
    """Newest hundred alerts of every severity."""
    rows = recent.newest_per(all_alerts(spark, sf_dir), ("severity",), 100, "created_at", ("alert_id",), spread=16)
    return rows.select("severity", "recency", "created_at", "alert_id", "device_id")


@query
def recent_alerts(spark, sf_dir):
    """Newest ten alerts per device and severity."""
    rows = recent.newest_per(all_alerts(spark, sf_dir), ("device_id", "severity"), 10, "created_at", ("alert_id",))
    return rows.select("device_id", "severity", "recency", "created_at", "alert_id", "alert_type")


@query
def unacked_alerts(spark, sf_dir):
    """Alerts nobody has acknowledged, newest first."""
    return recent.unacknowledged(alert_table(spark, sf_dir)).select(
        "created_at", "alert_id", "device_id", "alert_type", "severity", "value"
    )


@query
def logs_select(spark, sf_dir):
    """Lines of one namespace in the hour up to the latest line."""
    lines = logs.enrich(data.log_lines(spark, sf_dir), F.col("namespace"))
    latest = data.events(spark, sf_dir).select(F.max("time")).scalar()
    return logs.select_logs(lines, latest, namespace="plant-a").select("event_id", "ts", "app", "level", "service")


@query
def logs_by_label(spark, sf_dir):
    """Lines of one service in one namespace, from segments sorted by label."""
    path = work_dir(spark, "segments")
    logs.write_segments(logs.enrich(data.log_lines(spark, sf_dir), F.col("namespace")), path)
    rows = tables.read_table(spark, path).where("namespace = 'plant-a' AND service = 'svc-3'")
    return rows.select("event_id", "ts", "app", "level", "service")


@query
def logs_late_reject(spark, sf_dir):
    """Lines that are not older than a week at the given moment."""
    return logs.reject_late(logs.scan(data.log_lines(spark, sf_dir)), AS_OF).select("event_id", "ts", "pod")


# --- joins ---------------------------------------------------------------------------------------------


@query
def threshold_lookup(spark, sf_dir):
    """Limits that apply to every reading, device-specific before general."""
    rows = thresholds.lookup(readings(spark, sf_dir), thresholds.resolve(data.thresholds(spark)))
    return rows.select("event_id", "device_type", "sensor_type", "limits.*")


# --- KPIs ----------------------------------------------------------------------------------------------


def _kpi_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kpi.kpi(readings(spark, sf_dir), name)

    run.__name__, run.__doc__ = f"kpi_{name}", f"{name} of every sensor."
    query(run)


for _name in kpi.KPIS:
    _kpi_query(_name)


@query
def kpis_long(spark, sf_dir):
    """All KPIs of every sensor in long format."""
    return kpi.kpis_long(readings(spark, sf_dir))


@query
def kpi_window_bounds(spark, sf_dir):
    """Window of the incremental run: from the watermark to the latest scanned row."""
    scanned = ranged(spark, sf_dir)
    return scanned.agg(F.lit(WATERMARK).alias("window_start"), F.max("time").alias("window_end"))


@query
def kpis_incremental(spark, sf_dir):
    """KPI table rows of the incremental run."""
    return kpi_range_table(spark, sf_dir).drop("unit")


@query
def kpis_with_late_rows(spark, sf_dir):
    """Two runs of the job, part of the rows arriving after the first: its window is computed again, no row counts twice."""
    root = work_dir(spark, "late-kpis")
    whole = data.telemetry(spark, sf_dir)
    jobs.seed_control(spark, f"{root}/control")
    punctual = whole.where("event_id % 10 <> 0")
    for telemetry, as_of in ((punctual, WATERMARK), (whole, UNTIL)):
        jobs.run_kpi_job(spark, telemetry, f"{root}/kpis", f"{root}/control", as_of, lateness=timedelta(days=2))
    return jobs.read_kpis(spark, f"{root}/kpis").drop("unit")


@query
def kpis_merged_from_partials(spark, sf_dir):
    """The same two runs from stored partial figures: the second reads only what arrived after the first."""
    root = work_dir(spark, "merged-kpis")
    arrived = F.when(F.col("event_id") % 10 == 0, F.greatest("time", F.lit(WATERMARK + timedelta(seconds=1)))).otherwise(F.col("time"))
    telemetry = data.telemetry(spark, sf_dir).withColumn("arrived_at", arrived)
    jobs.seed_control(spark, f"{root}/control")
    for as_of in (WATERMARK, UNTIL):
        jobs.run_merging_job(spark, telemetry, f"{root}/kpis", f"{root}/state", f"{root}/control", as_of)
    return jobs.read_kpis(spark, f"{root}/kpis").drop("unit")


@query
def kpis_tumbling_5min(spark, sf_dir):
    """KPIs in five-minute windows."""
    return kpi.kpis_tumbling(readings(spark, sf_dir), "5 minutes")


@query
def kpis_tumbling_1hr(spark, sf_dir):
    """KPIs in one-hour windows."""
    return kpi.kpis_tumbling(readings(spark, sf_dir), "1 hour")


# --- metrics -------------------------------------------------------------------------------------------


@query
def metric_telemetry_received(spark, sf_dir):
    return metrics.metric(data.telemetry(spark, sf_dir), "telemetry_received_total")


@query
def metric_telemetry_stored(spark, sf_dir):
    """Stored rows by device type: what is left of the topic without the poison records."""
    stored = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True)))
    return metrics.metric(stored, "telemetry_stored_total")


@query
def metric_alerts_generated(spark, sf_dir):
    return metrics.metric(all_alerts(spark, sf_dir), "alerts_generated_total")


@query
def metric_threshold_checks(spark, sf_dir):
    return metrics.metric(readings(spark, sf_dir), "threshold_checks_total")


@query
def metric_alerts_stored(spark, sf_dir):
    """Alerts stored: two deliveries of each message, one row per alert."""
    twice = alerts.to_rows(all_alerts(spark, sf_dir)).withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    stored = twice.dropDuplicates(["alert_id", "created_at"])
    return metrics.metric(stored, "alerts_stored_total")


@query
def metric_alerts_active(spark, sf_dir):
    return metrics.active_alerts(all_alerts(spark, sf_dir))


@query
def metric_kpis_computed(spark, sf_dir):
    return metrics.metric(kpi_table(spark, sf_dir), "kpis_computed_total")


@query
def metric_job_duration(spark, sf_dir):
    return metrics.histogram(data.job_runs(spark, sf_dir), "duration_seconds", ("job_name",))


@query
def metric_processing_errors(spark, sf_dir):
    """Errors of the workers: poison records of the telemetry topic and of the alert topic."""
    of_alerts = messages.bad(messages.parse_alerts(alert_records(spark, sf_dir)), "alert")
    return metrics.metric(poison(spark, sf_dir).unionByName(of_alerts, allowMissingColumns=True), "processing_errors_total")


@query
def rate_telemetry_1m(spark, sf_dir):
    """Telemetry per second over the last minute, by series, every 15 s."""
    return metrics.rate(data.telemetry(spark, sf_dir), "time", 60, ("device_type", "sensor_type"))


@query
def rate_alerts_5m(spark, sf_dir):
    """Alerts per second over the last five minutes, by series, every 15 s."""
    return metrics.rate(all_alerts(spark, sf_dir), "created_at", 300, ("alert_type", "severity"))


@query
def rate_errors_5m(spark, sf_dir):
    """Errors per second over the last five minutes by time of arrival, all together, every 15 s."""
    return metrics.rate(poison(spark, sf_dir), messages.ARRIVAL, 300)


@query
def active_alert_count(spark, sf_dir):
    return metrics.active_alert_count(all_alerts(spark, sf_dir))


@query
def total_stored(spark, sf_dir):
    return metrics.total(metrics.metric(data.telemetry(spark, sf_dir), "telemetry_stored_total"), "total_stored")


@query
def total_kpis(spark, sf_dir):
    return metrics.total(metrics.metric(kpi_table(spark, sf_dir), "kpis_computed_total"), "total_kpis")


# --- windows, top-k, alerts ----------------------------------------------------------------------------


@query
def alerts_threshold(spark, sf_dir):
    return all_alerts(spark, sf_dir, (alerts.THRESHOLD,)).select(*ALERT_OUT)


@query
def alerts_rapid_change(spark, sf_dir):
    return all_alerts(spark, sf_dir, (alerts.RAPID,)).select(*ALERT_OUT)


@query
def alerts_stuck_sensor(spark, sf_dir):
    return all_alerts(spark, sf_dir, (alerts.STUCK,)).select(*ALERT_OUT)


@query
def alerts_all(spark, sf_dir):
    return all_alerts(spark, sf_dir).select(*ALERT_OUT)


@query
def alerts_all_merged_limits(spark, sf_dir):
    """All alerts with the two temperature rows completing each other."""
    telemetry = data.telemetry(spark, sf_dir)
    rows = messages.with_reading(telemetry)
    found = alerts.detect(rows, data.thresholds(spark), F.col("time"), resolve_mode="merge", sizes=telemetry)
    return found.select(*ALERT_OUT)


@query
def throughput_delta(spark, sf_dir):
    """Growth of the row count between successive samples, every event being a sample."""
    samples = data.events(spark, sf_dir).select(F.col("time").alias("sample_ts"), F.col("event_id").alias("count"))
    return health.throughput_delta(samples)


@query
def top5_telemetry(spark, sf_dir):
    rows = recent.newest(data.telemetry(spark, sf_dir), "time", ("event_id",), 5)
    return rows.select("event_id", "time", "device_id", "sensor_id")


@query
def top5_telemetry_stored(spark, sf_dir):
    """Newest five rows of the table stored by day, opening the newest days only."""
    path = work_dir(spark, "by-day")
    tables.append_rows(data.telemetry(spark, sf_dir), path)
    return recent.newest_stored(spark, path, 5, tie=("event_id",)).select("event_id", "time", "device_id", "sensor_id")


@query
def top10_unacked_alerts_stored(spark, sf_dir):
    """Newest ten alerts that nobody has acknowledged, from the alert table stored by day."""
    path = work_dir(spark, "alerts-by-day")
    tables.append_rows(alert_table(spark, sf_dir), path, "created_at")
    rows = recent.newest_stored(spark, path, 10, "created_at", ("alert_id",), ~F.col("acknowledged"))
    return rows.select("created_at", "alert_id", "device_id", "alert_type", "severity", "value")


@query
def top5_alerts(spark, sf_dir):
    rows = recent.newest(all_alerts(spark, sf_dir), "created_at", ("alert_id",), 5)
    return rows.select("created_at", "alert_id", "device_id", "alert_type", "severity", "value")


@query
def top10_kpis(spark, sf_dir):
    rows = kpi.kpis_tumbling(readings(spark, sf_dir), "1 hour")
    out = recent.newest(rows, "window_start", ("device_id", "sensor_id", "kpi_name"), 10)
    return out.select("window_start", "device_id", "sensor_id", "kpi_name", "kpi_value")


@query
def telemetry_count(spark, sf_dir):
    return data.telemetry(spark, sf_dir).agg(F.count(F.lit(1)).alias("telemetry_rows"))


# --- streaming-only, lifecycle -------------------------------------------------------------------------


@query
def late_rows_report(spark, sf_dir):
    """Rows that arrived after the watermark had passed them."""
    k = F.col("k")
    rows = data.telemetry_columns(data.events(spark, sf_dir)).withColumn(
        "arrived_at", F.when(k % 10 == 0, F.timestamp_seconds(F.unix_seconds("time") + k * 3600)).otherwise(F.col("time"))
    )
    return recent.late_rows(rows, WATERMARK).select("event_id", "time", "arrived_at", "late_by_s")


@query
def telemetry_dedup(spark, sf_dir):
    """Telemetry after its producers sent part of it twice: the repeats stand elsewhere in the topic."""
    records = data.messages(spark, sf_dir)
    times = F.when(F.col("sequence") % 3 == 0, F.lit(2)).otherwise(F.lit(1))
    delivered = records.withColumn("delivery", F.explode(F.sequence(F.lit(1), times)))
    moved = delivered.withColumn("sequence", F.col("sequence") + F.col("delivery") * F.lit(10**12)).drop("delivery")
    return deduplicate(messages.good(messages.parse_telemetry(moved))).drop("value")


@query
def stream_alerts_all(spark, sf_dir):
    """All alerts by the stateful stream; must equal ``alerts_all``."""
    return stream_checks.alerts_from_stream(spark, sf_dir, work_dir(spark, "stream-alerts")).select(*ALERT_OUT)


@query
def stream_alerts_by_batch(spark, sf_dir):
    """All alerts by micro-batches with a table of last readings; must equal ``alerts_all``."""
    return stream_checks.alerts_from_batches(spark, sf_dir, work_dir(spark, "batch-alerts")).select(*ALERT_OUT)


@query
def stream_landing(spark, sf_dir):
    """Telemetry landed by the stream, the stored payload read back as numbers."""
    path = stream_checks.landed_by_stream(spark, sf_dir, work_dir(spark, "stream-landing"))
    return stored_numbers(ledger.read(spark, path)).drop(tables.BATCH)


@query
def landing_in_flushes(spark, sf_dir):
    """Telemetry landed from a rate-limited topic in several flushes, the tail included."""
    return stored_numbers(ledger.read(spark, stream_checks.landed_in_flushes(spark, sf_dir, work_dir(spark, "flushes")))).drop(tables.BATCH)


@query
def landing_resumed(spark, sf_dir):
    """Telemetry landed by a stream that stops in the middle of the topic and goes on from its checkpoint."""
    return stored_numbers(ledger.read(spark, stream_checks.landed_and_resumed(spark, sf_dir, work_dir(spark, "resumed")))).drop(tables.BATCH)


@query
def stream_fan_out(spark, sf_dir):
    """Records by kind of two independent consumers of one topic: what one stored and what the other refused."""
    return stream_checks.fanned_out(spark, sf_dir, work_dir(spark, "fan-out"))


@query
def telemetry_partitions(spark, sf_dir):
    return lifecycle.partitions(data.telemetry(spark, sf_dir))


@query
def retention_30d(spark, sf_dir):
    """Rows kept at a moment when the first days are past their retention."""
    kept = lifecycle.retain(data.telemetry(spark, sf_dir), AS_OF + timedelta(days=7))
    return kept.select("event_id", "time", "device_id")


@query
def retention_168h(spark, sf_dir):
    kept = lifecycle.retain(data.telemetry(spark, sf_dir), AS_OF, lifecycle.TOPIC_RETENTION)
    return kept.select("event_id", "time", "device_id")


@query
def landing_compacted(spark, sf_dir):
    """Telemetry landed by the stream, all its days compacted in place and read back."""
    path = stream_checks.landed_by_stream(spark, sf_dir, work_dir(spark, "stream-landing"))
    lifecycle.compact_days(spark, path, stored_days(ledger.read(spark, path)))
    return stored_numbers(ledger.read(spark, path))


def stored_days(rows: DataFrame) -> list[str]:
    return [str(r.dt) for r in rows.select("dt").distinct().collect()]  # one entry per day


@query
def landing_replayed_after_compaction(spark, sf_dir):
    """Telemetry landed, compacted, and delivered once more from the same checkpoint whose last commit is lost; counts once."""
    path = stream_checks.landed_and_replayed(
        spark, sf_dir, work_dir(spark, "stream-landing"), lambda table: lifecycle.compact_days(spark, table, stored_days(ledger.read(spark, table)))
    )
    return stored_numbers(ledger.read(spark, path))


@query
def compaction_candidates(spark, sf_dir):
    return lifecycle.compaction_candidates(data.telemetry(spark, sf_dir), AS_OF)


# --- health --------------------------------------------------------------------------------------------


@query
def consumer_lag(spark, sf_dir):
    return health.consumer_lag(data.offsets(spark, sf_dir))


@query
def health_class(spark, sf_dir):
    """Lag and health of every consumer group, and of every load-test run."""
    groups = health.consumer_lag(data.offsets(spark, sf_dir)).select(F.col("group_id").alias("subject"), "lag")
    runs = data.run_samples(spark, sf_dir).select(F.concat(F.lit("run-"), "run_id").alias("subject"), "lag")
    return health.with_health(groups.unionByName(runs))


@query
def reconcile_counts(spark, sf_dir):
    """Sent and stored records per device; the poison records are what is lost."""
    sent = data.messages(spark, sf_dir, corrupt=True).select(F.col("key").alias("device_id"))
    stored = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True)))
    return health.reconcile_counts(sent, stored, "device_id", 60.0)


@query
def reconcile_lost(spark, sf_dir):
    """The sent records that were not stored."""
    sent = data.messages(spark, sf_dir, corrupt=True).select(F.col("sequence").alias("event_id"), "key")
    stored = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True)))
    return health.lost_records(sent, stored, ("event_id",))


@query
def reconcile_lost_by_bucket(spark, sf_dir):
    """The sent records that were not stored, found in the buckets whose checksums differ."""
    sent = data.telemetry(spark, sf_dir).select("event_id", F.col("device_id").alias("key"), F.to_date("time").alias("dt"))
    stored = messages.good(messages.parse_telemetry(data.messages(spark, sf_dir, corrupt=True))).withColumn("dt", F.to_date("time"))
    return health.lost_records_by_bucket(sent, stored, ("event_id",)).select("event_id", "key")


@query
def bottleneck_class(spark, sf_dir):
    return health.bottleneck(data.run_samples(spark, sf_dir)).select("run_id", "bottleneck")


@query
def tuning_decision(spark, sf_dir):
    return health.tuning_decision(data.run_samples(spark, sf_dir)).select("run_id", "throughput", "lag", "decision")


# --- devices -------------------------------------------------------------------------------------------


@query
def devices_list(spark, sf_dir):
    return devices.list_devices(data.devices(spark, sf_dir))


@query
def device_get(spark, sf_dir):
    """Answers to all requested ids, known or not."""
    ids = data.device_changes(spark, sf_dir).select("id")
    return devices.get_many(data.devices(spark, sf_dir), ids)


@query
def device_create(spark, sf_dir):
    """Suppliers registered as new devices."""
    key = F.col("s_suppkey")
    requests = data.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.lit("supplier").alias("type"),
        F.when(key % 2 == 0, "active").alias("status"), F.concat(F.lit("site-"), "s_nationkey").alias("location"), key,
    )
    return devices.create(requests, AS_OF, F.sha2(F.col("s_suppkey").cast("string"), 256))


@query
def device_update(spark, sf_dir):
    """The latest update per device applied to the registry."""
    changes = data.device_changes(spark, sf_dir).where(F.col("op") == "update")
    return devices.update(data.devices(spark, sf_dir), upsert_latest(changes, ("id",), ("changed_at", "change_id")))


@query
def device_delete(spark, sf_dir):
    changes = data.device_changes(spark, sf_dir).where(F.col("op") == "delete")
    return devices.delete(data.devices(spark, sf_dir), changes)


@query
def devices_apply_changes(spark, sf_dir):
    """The registry after the whole change log."""
    return devices.apply_changes(data.devices(spark, sf_dir), data.device_changes(spark, sf_dir))
