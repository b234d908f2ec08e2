"""The registered queries as SQL over the given tables, written independently of the Spark code."""

from __future__ import annotations

TELEMETRY = """
b AS (
  SELECT event_id, ts AS time, user_id, event_type, value AS raw,
         cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
m AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'temperature' WHEN 'view' THEN 'humidity' WHEN 'purchase' THEN 'power'
            WHEN 'error' THEN 'vibration' ELSE 'pressure' END AS sensor_type FROM b),
telemetry AS (
  SELECT event_id, time, 'device-' || user_id AS device_id,
    CASE user_id % 4 WHEN 0 THEN 'motor' WHEN 1 THEN 'hvac' WHEN 2 THEN 'pump' ELSE 'compressor' END AS device_type,
    sensor_type || '-' || (CASE WHEN sensor_type = 'temperature' THEN k % 2 ELSE 0 END) AS sensor_id,
    sensor_type,
    CASE sensor_type WHEN 'temperature' THEN 'celsius' WHEN 'humidity' THEN 'percent' WHEN 'power' THEN 'watt'
         WHEN 'vibration' THEN 'mm/s' ELSE 'bar' END AS unit,
    CASE WHEN k % 20 <> 19 AND sensor_type <> 'vibration' THEN
         CASE WHEN sensor_type = 'pressure' THEN (CASE WHEN raw < 60 THEN 4.0::double ELSE 9.0 + (k % 3)::double END)
         ELSE raw END END AS scalar,
    CASE WHEN k % 20 <> 19 AND sensor_type = 'vibration' THEN raw / 40.0 END AS x,
    CASE WHEN k % 20 <> 19 AND sensor_type = 'vibration' THEN k::double / 100.0 END AS y,
    CASE WHEN k % 20 <> 19 AND sensor_type = 'vibration' THEN 0.5::double END AS z,
    CASE WHEN k % 20 = 19 THEN raw END AS reading,
    k, raw, user_id
  FROM m),
good AS (SELECT * FROM telemetry WHERE k % 25 NOT IN (3, 7, 11, 13)),
valued AS (
  SELECT *, CASE WHEN sensor_type = 'vibration'
    THEN sqrt(coalesce(x, 0) * coalesce(x, 0) + coalesce(y, 0) * coalesce(y, 0) + coalesce(z, 0) * coalesce(z, 0))
    ELSE scalar END AS v FROM telemetry),
readings AS (SELECT * FROM valued WHERE v IS NOT NULL)"""


def _alerts(mode: str = "last") -> str:
    """Common table expressions up to ``alerts``."""
    if mode == "last":
        limits = "resolved AS (SELECT * FROM th QUALIFY row_number() OVER (PARTITION BY sensor_type, device_type ORDER BY id DESC) = 1)"
    else:
        columns = ", ".join(f"arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("wl", "wh", "cl", "ch"))
        limits = f"resolved AS (SELECT sensor_type, device_type, {columns} FROM th GROUP BY ALL)"
    return f"""{TELEMETRY},
th(id, sensor_type, device_type, wl, wh, cl, ch) AS (VALUES
  (1, 'temperature', NULL, NULL::double, 70.0::double, NULL::double, 85.0::double),
  (2, 'vibration', NULL, NULL, 1.5, NULL, 2.5),
  (3, 'humidity', NULL, NULL, 80, NULL, 95),
  (4, 'pressure', NULL, NULL, 8, NULL, 10),
  (5, 'temperature', NULL, 5, NULL, 0, NULL),
  (6, 'pressure', 'hvac', NULL, 3, NULL, 9.5)),
{limits},
looked AS (
  SELECT r.*, CASE WHEN s.sensor_type IS NOT NULL THEN s.wl ELSE g.wl END AS wl,
    CASE WHEN s.sensor_type IS NOT NULL THEN s.wh ELSE g.wh END AS wh,
    CASE WHEN s.sensor_type IS NOT NULL THEN s.cl ELSE g.cl END AS cl,
    CASE WHEN s.sensor_type IS NOT NULL THEN s.ch ELSE g.ch END AS ch
  FROM readings r
  LEFT JOIN resolved s ON s.sensor_type = r.sensor_type AND s.device_type = r.device_type
  LEFT JOIN resolved g ON g.sensor_type = r.sensor_type AND g.device_type IS NULL),
checked AS (
  SELECT *, CASE WHEN nullif(ch, 0) IS NOT NULL AND v > ch THEN 'critical'
                 WHEN nullif(cl, 0) IS NOT NULL AND v < cl THEN 'critical'
                 WHEN nullif(wh, 0) IS NOT NULL AND v > wh THEN 'warning'
                 WHEN nullif(wl, 0) IS NOT NULL AND v < wl THEN 'warning' END AS severity,
    CASE WHEN nullif(ch, 0) IS NOT NULL AND v > ch THEN ch
         WHEN nullif(cl, 0) IS NOT NULL AND v < cl THEN cl
         WHEN nullif(wh, 0) IS NOT NULL AND v > wh THEN wh
         WHEN nullif(wl, 0) IS NOT NULL AND v < wl THEN wl END AS breached_limit,
    coalesce(nullif(ch, 0), nullif(wh, 0), nullif(cl, 0), nullif(wl, 0)) AS reported_limit FROM looked),
series AS (
  SELECT *, lag(v) OVER w AS prev,
    count(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5,
    min(v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS min5,
    max(v) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS max5
  FROM readings WINDOW w AS (PARTITION BY device_id, sensor_id ORDER BY time, event_id)),
raised AS (
  SELECT event_id, time, device_id, device_type, sensor_id, 'threshold_breach' AS alert_type, severity,
    printf('%s value %.2f exceeds limit %s', sensor_type, v, cast(reported_limit AS varchar)) AS message,
    reported_limit AS threshold, v AS value, breached_limit FROM checked WHERE severity IS NOT NULL
  UNION ALL
  SELECT event_id, time, device_id, device_type, sensor_id, 'rapid_change', 'warning',
    printf('%s changed by %.2f in one reading', sensor_type, abs(v - prev)), 10.0::double, v, 10.0::double
  FROM series WHERE abs(v - prev) > 10
  UNION ALL
  SELECT event_id, time, device_id, device_type, sensor_id, 'stuck_sensor', 'warning',
    printf('%s stuck at %.2f for 5 readings', sensor_id, v), NULL, v, NULL
  FROM series WHERE n5 = 5 AND min5 = max5),
alerts AS (
  SELECT *, time AS created_at,
    sha256(device_id || ':' || sensor_id || ':' || epoch_us(time) || ':' || alert_type || ':' || event_id) AS alert_id
  FROM raised)"""


ALERT_OUT = """event_id, time, device_id, device_type, sensor_id, alert_type, severity, message,
  round(threshold, 6) AS threshold, round(value, 6) AS value, round(breached_limit, 6) AS breached_limit"""

RANGE = "time > TIMESTAMP '2024-01-10' AND time <= TIMESTAMP '2024-01-20'"


def _wide(source: str, keys: str = "", where: str = "true") -> str:
    """KPIs per sensor as columns; ``keys`` are extra grouping columns, each followed by a comma."""
    return f"""
  SELECT {keys} device_id, device_type, sensor_id, sensor_type, count(v) AS sample_count,
    avg(v) AS "avg", min(v) AS "min", max(v) AS "max", cast(count(v) AS double) AS "count",
    CASE WHEN count(v) >= 2 THEN stddev_samp(v) END AS std_dev,
    CASE WHEN count(v) >= 2 THEN max(v) - min(v) END AS "range",
    CASE WHEN sensor_type = 'vibration' THEN sqrt(sum(v * v) / count(v)) END AS rms,
    CASE WHEN sensor_type = 'vibration' AND sum(v * v) > 0 THEN max(abs(v)) / sqrt(sum(v * v) / count(v)) END AS crest_factor,
    CASE WHEN sensor_type = 'temperature' AND count(v) >= 2
      THEN arg_max(v, (time, event_id)) - arg_min(v, (time, event_id)) END AS rate_of_change,
    CASE WHEN sensor_type = 'power' THEN sum(v) END AS energy
  FROM {source} WHERE {where} GROUP BY {keys} device_id, device_type, sensor_id, sensor_type"""


def _long(source: str) -> str:
    return f"""
  SELECT * REPLACE (sensor_type || '_' || kpi_name AS kpi_name) FROM (UNPIVOT {source}
    ON "avg", "min", "max", "count", std_dev, "range", rms, crest_factor, rate_of_change, energy
    INTO NAME kpi_name VALUE kpi_value)"""


def _kpi_table(where: str, start: str, created: str) -> str:
    return f"""{TELEMETRY},
wide AS ({_wide("readings", where=where)}),
kpis AS (
  SELECT TIMESTAMP '{created}' AS created_at, device_id, device_type, sensor_id, kpi_name,
    round(kpi_value, 6) AS kpi_value, TIMESTAMP '{start}' AS window_start,
    (SELECT max(time) FROM telemetry WHERE {where}) AS window_end, sample_count
  FROM ({_long("wide")}))"""


KPI_TABLE = _kpi_table("true", "1970-01-01", "2024-01-31")
KPI_RANGE_TABLE = _kpi_table(RANGE, "2024-01-10", "2024-01-20")

LATE_KPIS = f"""{TELEMETRY},
bounds AS (SELECT max(time) FILTER (WHERE event_id % 10 <> 0 AND time <= TIMESTAMP '2024-01-10') AS first_end,
                  max(time) FILTER (WHERE time <= TIMESTAMP '2024-01-20') AS second_end FROM telemetry),
labelled AS (
  SELECT readings.*, CASE WHEN time <= first_end THEN TIMESTAMP '1970-01-01' ELSE first_end END AS window_start,
    CASE WHEN time <= first_end THEN first_end ELSE second_end END AS window_end
  FROM readings, bounds WHERE time <= TIMESTAMP '2024-01-20'),
wide AS ({_wide("labelled", "window_start, window_end,")}),
kpis AS (
  SELECT TIMESTAMP '2024-01-20' AS created_at, device_id, device_type, sensor_id, kpi_name, round(kpi_value, 6) AS kpi_value,
    window_start, window_end, sample_count FROM ({_long("wide")}))"""

COLLAPSED = """collapsed AS (
  SELECT * FROM kpis QUALIFY row_number() OVER (
    PARTITION BY device_id, kpi_name, window_start, created_at ORDER BY sensor_id DESC, device_type DESC) = 1)"""


def _tumbling(size: str) -> str:
    return f"""{TELEMETRY},
bucketed AS (SELECT *, time_bucket(INTERVAL '{size}', time) AS window_start FROM readings),
wide AS ({_wide("bucketed", "window_start,")}),
tumbling AS (
  SELECT window_start, window_start + INTERVAL '{size}' AS window_end, device_id, device_type, sensor_id, kpi_name,
    round(kpi_value, 6) AS kpi_value, sample_count FROM ({_long("wide")}))"""


def _rate(source: str, seconds: int, labels: str) -> str:
    """Samples every 15 s; one at t covers [t - seconds, t)."""
    return f"""
SELECT make_timestamp(sample * 15000000) AS sample_ts, {labels} cast(count(*) AS bigint) AS events,
  round(count(*) / {seconds}.0::double, 6) AS per_second
FROM (SELECT *, unnest(generate_series(epoch_us(moment) // 15000000 + 1, epoch_us(moment) // 15000000 + {seconds // 15})) AS sample
      FROM ({source}))
GROUP BY ALL"""


POISON = f"""{TELEMETRY},
poison AS (
  SELECT event_id, 'stream' AS worker, time + INTERVAL 2 SECOND AS arrived_at, CASE WHEN k % 25 = 11 THEN NULL WHEN k % 25 = 3 THEN NULL ELSE time END AS time,
    CASE WHEN k % 25 = 3 THEN 'JSONDecodeError' WHEN k % 25 = 7 THEN 'KeyError' WHEN k % 25 = 11 THEN 'ValueError'
         WHEN k % 25 = 13 THEN 'TypeError'
         WHEN sensor_type = 'vibration' THEN 'TypeError' ELSE 'ValueError' END AS error_type
  FROM telemetry WHERE k % 25 IN (3, 7, 11, 13, 17))"""

LINES = """
b AS (
  SELECT event_id, ts, user_id, event_type, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
p AS (
  SELECT *, 'svc-' || (user_id % 7) AS name, (['INFO', 'WARN', 'ERROR', 'DEBUG', 'TRACE'])[k % 5 + 1] AS lvl,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS stamp, 'handled ' || event_type || ' ' || event_id AS txt FROM b),
lines AS (
  SELECT event_id, ts, 'app-' || (user_id % 3) AS app, 'pod-' || user_id AS pod,
    CASE WHEN k % 2 = 0 THEN 'plant-a' ELSE 'plant-b' END AS namespace, k, name, lvl, txt, user_id, stamp,
    CASE WHEN k % 20 = 19 THEN ''
      WHEN k % 5 = 0 THEN '{"timestamp": "' || stamp || '", "level": "' || lvl || '", "service": "' || name
        || '", "logger": "main", "message": "' || txt || '", "extra": {"user": "' || user_id || '"}}'
      WHEN k % 5 = 1 THEN '{"timestamp":"' || stamp || '","level":"' || lower(lvl) || '","service":"' || name
        || '","message":"' || txt || '"}'
      WHEN k % 5 = 2 THEN 'ts=' || stamp || ' level=' || lvl || ' service=' || name || ' msg=ok'
      WHEN k % 5 = 3 THEN stamp || ' ' || lvl || ' worker - ' || txt
      ELSE txt || chr(13) END AS line FROM p),
scanned AS (SELECT * FROM lines WHERE length(line) > 0),
labelled AS (
  SELECT *,
    coalesce(nullif(regexp_extract(line, '"level":\\s*"([^"]+)"', 1), ''),
      lower(nullif(regexp_extract(line, 'level=([a-zA-Z]+)', 1), '')),
      lower(nullif(regexp_extract(line, '(^|\\s)(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)(\\s|$)', 2), '')), 'info') AS level,
    coalesce(nullif(regexp_extract(line, '"level":"([^"]+)"', 1), ''),
      lower(nullif(regexp_extract(line, 'level=([a-zA-Z]+)', 1), '')),
      lower(nullif(regexp_extract(line, '(^|\\s)(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)(\\s|$)', 2), '')), 'info') AS strict_level,
    coalesce(nullif(regexp_extract(line, 'service=(\\S+)', 1), ''),
      nullif(regexp_extract(line, '"service":\\s*"([^"]+)"', 1), ''), app) AS service
  FROM scanned)"""

DEVICES = """
devices AS (
  SELECT cast(c_custkey AS varchar) AS id, c_name AS name, c_mktsegment AS type,
    CASE WHEN c_custkey % 3 = 0 THEN 'active' ELSE 'inactive' END AS status,
    CASE WHEN c_custkey % 5 <> 0 THEN 'site-' || c_nationkey END AS location,
    make_timestamp((1600000000 + c_custkey) * 1000000) AS created_at FROM customer),
changes AS (
  SELECT o_orderkey AS change_id,
    cast(CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS varchar) AS id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'delete' ELSE 'update' END
         WHEN o_orderpriority = '2-HIGH' AND o_custkey % 10 = 0 THEN 'create' ELSE 'update' END AS op,
    'renamed-' || o_orderkey AS name, o_orderpriority AS type,
    CASE WHEN o_orderstatus <> 'P' THEN 'status-' || o_orderstatus END AS status,
    CASE WHEN o_orderkey % 2 = 0 THEN 'moved' END AS location, o_orderdate AS changed_at FROM orders)"""

RUNS = """
runs AS (
  SELECT o_orderkey AS run_id, cast(floor(o_totalprice) AS bigint) % 2000 AS lag,
    cast(floor(o_totalprice) AS bigint) % 5000 AS sent, o_custkey % 400 AS errors,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 7 % 900 END AS ingestion_cpu, o_orderkey * 13 % 850 AS worker_cpu,
    o_orderkey * 17 % 820 AS database_cpu, cast(floor(o_totalprice) AS bigint) % 900 AS throughput,
    500::bigint AS target FROM orders)"""

OFFSETS = """
offsets AS (
  SELECT 'group-' || event_type AS group_id, 'telemetry' AS topic, user_id % 8 AS "partition", count(*) AS end_offset,
    count(*) FILTER (WHERE event_type = 'click' OR cast(json_extract_string(props, '$.k') AS bigint) % 10 <> 0) AS committed_offset
  FROM events GROUP BY ALL),
lags AS (SELECT group_id, topic, cast(sum(end_offset - committed_offset) AS bigint) AS lag FROM offsets GROUP BY ALL)"""

HEALTH = "CASE WHEN lag > 1000 THEN 'high' WHEN lag > 100 THEN 'processing' ELSE 'healthy' END"

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

REVISIONS = f"""{TELEMETRY},
revisions AS (
  SELECT event_id AS id, sensor_type, CASE WHEN k % 3 = 2 THEN device_type END AS device_type,
    CASE WHEN k % 2 = 0 THEN raw / 4 END AS warning_low, CASE WHEN k % 5 <> 0 THEN raw END AS warning_high,
    CASE WHEN k % 7 = 0 THEN 0.0::double END AS critical_low, CASE WHEN k % 2 = 1 THEN raw * 2 END AS critical_high
  FROM telemetry)"""

TYPED = f"""{TELEMETRY},
typed AS (
  SELECT event_id, sensor_type, CASE WHEN k % 23 = 0 THEN 'prototype' ELSE device_type END AS device_type, raw, k,
    CASE WHEN k % 17 = 0 THEN 'boolean' WHEN sensor_type = 'vibration' THEN 'vibration'
         WHEN sensor_type = 'power' THEN 'power' ELSE 'scalar' END AS payload_type FROM telemetry)"""

CONTROL = f"""{TELEMETRY},
control AS (SELECT 'kpi_' || sensor_type AS job_name, max(time) AS last_processed_at FROM telemetry GROUP BY ALL)"""


def _limits(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in ("warning_low", "warning_high", "critical_low", "critical_high"))


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def oracle_sql() -> dict[str, str]:
    alerts, merged = _alerts(), _alerts("merge")
    columns = "event_id, time, device_id, device_type, sensor_id, sensor_type, unit"
    acknowledged = "value < 30"
    number_names = ("scalar", "x", "y", "z", "reading")
    numbers = ", ".join(f"round({c}, 6) AS {c}" for c in number_names)
    # where the payload was replaced by text entries, none of them reads as a number
    numbers_17 = ", ".join(f"round(CASE WHEN k % 25 <> 17 THEN {c} END, 6) AS {c}" for c in number_names)
    sql = {
        # scans, sources, sinks
        "telemetry_scan": _with(TELEMETRY, f"SELECT {columns}, {numbers} FROM telemetry"),
        "topic_replay": _with(TELEMETRY, """SELECT device_id AS key, count(*) AS records, min(event_id) AS first_seq,
            max(event_id) AS last_seq FROM telemetry GROUP BY ALL"""),
        "alert_source": _with(alerts, """SELECT created_at, alert_id, device_id, device_type, alert_type, severity, message,
            round(threshold, 6) AS threshold, round(value, 6) AS value FROM alerts"""),
        "alert_publish": _with(alerts, """SELECT device_id AS key, alert_type AS "alertType", severity,
            strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS "createdAt", round(value, 6) AS value FROM alerts"""),
        "ingest_normalize": _with(TELEMETRY, """SELECT event_id, device_id AS key, sensor_id AS "sensorId",
            sensor_type AS "sensorType", unit, strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "timestamp" FROM good"""),
        "telemetry_append": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, {numbers_17} FROM good"),
        "bulk_append": _with(TELEMETRY, f"SELECT {columns}, {numbers} FROM telemetry, range(2)"),
        "upsert_latest": _with(TELEMETRY, f"""SELECT {columns}, round(v, 6) AS v FROM readings
            QUALIFY row_number() OVER (PARTITION BY device_id, sensor_id ORDER BY time DESC, event_id DESC) = 1"""),
        "alerts_upsert": _with(alerts, f"""SELECT alert_id, created_at, device_id, alert_type, severity, 'again: ' || message AS message,
            round(threshold, 6) AS threshold, round(value, 6) AS value, {acknowledged} AS acknowledged FROM alerts"""),
        "upsert_by_bucket": _with(TELEMETRY, f"""SELECT {columns}, round(v, 6) AS v FROM readings
            QUALIFY row_number() OVER (PARTITION BY device_id, sensor_id ORDER BY time DESC, event_id DESC) = 1"""),
        "alerts_upsert_by_bucket": _with(alerts, f"""SELECT alert_id, created_at, device_id, alert_type, severity, 'again: ' || message AS message,
            round(threshold, 6) AS threshold, round(value, 6) AS value, {acknowledged} AS acknowledged FROM alerts"""),
        "kpis_upserted": _with(f"{KPI_TABLE}, {COLLAPSED}", "SELECT * EXCLUDE (sensor_id) FROM collapsed"),
        "param_query": _with(TELEMETRY, f"""SELECT device_id, sensor_type, count(*) AS readings, min(time) AS first_time,
            max(time) AS last_time FROM telemetry WHERE {RANGE} GROUP BY ALL"""),
        "telemetry_range": _with(TELEMETRY, f"SELECT event_id, time, device_id, device_type, sensor_id, sensor_type FROM telemetry WHERE {RANGE}"),
        "watermark_update": _with(CONTROL, "SELECT * FROM control"),
        "watermark_get": _with(CONTROL, """SELECT job_name, CASE WHEN job_name = 'kpi_pressure' THEN TIMESTAMP '1970-01-01'
            ELSE last_processed_at END AS last_processed_at FROM control"""),
        "thresholds_resolved": _with(REVISIONS, f"""SELECT sensor_type, device_type, {_limits()} FROM revisions
            QUALIFY row_number() OVER (PARTITION BY sensor_type, device_type ORDER BY id DESC) = 1"""),
        "thresholds_merged": _with(REVISIONS, "SELECT sensor_type, device_type, " + ", ".join(
            f"round(arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL), 6) AS {c}"
            for c in ("warning_low", "warning_high", "critical_low", "critical_high")) + " FROM revisions GROUP BY ALL"),
        "logs_scan": _with(LINES, "SELECT event_id, ts, app, pod, line FROM scanned"),
        "logs_enriched": _with(LINES, """SELECT app, pod, namespace, level, service, epoch_us(ts) * 1000 AS ts_ns,
            replace(line, chr(13), '') AS line FROM labelled"""),
        "metrics_snapshot": _with(KPI_TABLE, """
            SELECT 'kpi' AS job, 'kpis_computed_total' AS metric, kpi_name AS label_values, count(*) AS value FROM kpis GROUP BY ALL
            UNION ALL
            SELECT 'kpi', 'telemetry_received_total', array_to_string(list_sort([device_type, sensor_type]), ','), count(*)
            FROM telemetry GROUP BY ALL"""),
        # parsing and scalar functions
        "telemetry_parse": _with(TELEMETRY, f"""SELECT {columns}, round(scalar, 6) AS scalar, round(x, 6) AS x, round(y, 6) AS y,
            round(z, 6) AS z, round(reading, 6) AS reading FROM telemetry"""),
        "scalar_value": _with(TELEMETRY, "SELECT event_id, round(scalar, 6) AS scalar FROM telemetry"),
        "vibration_rms": _with(TELEMETRY, "SELECT event_id, round(CASE WHEN sensor_type = 'vibration' THEN v END, 6) AS rms FROM valued"),
        "reading_value": _with(TELEMETRY, "SELECT event_id, sensor_type, round(v, 6) AS v FROM readings"),
        "kpi_value_extract": _with(TELEMETRY, """SELECT event_id,
            round(CASE WHEN sensor_type = 'vibration' THEN v ELSE coalesce(scalar, reading) END, 6) AS v FROM valued"""),
        "telemetry_rows": _with(TELEMETRY, f"SELECT {columns}, {numbers_17} FROM good"),
        "reading_of_odd_payloads": _with(TELEMETRY, """SELECT event_id, round(CASE k % 7 WHEN 0 THEN sqrt(n * n + 9) WHEN 5 THEN 0 END, 6) AS v
            FROM (SELECT *, round(raw, 6) AS n FROM telemetry)"""),
        "alert_to_message": _with(alerts, """SELECT alert_id AS "alertId", device_id AS "deviceId", device_type AS "deviceType",
            message, round(threshold, 6) AS threshold, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS "createdAt" FROM alerts"""),
        "alert_rows": _with(alerts, """SELECT created_at, alert_id, device_id, device_type, alert_type, severity, message,
            round(threshold, 6) AS threshold, round(value, 6) AS value, false AS acknowledged FROM alerts"""),
        "alert_parse": _with(alerts, """SELECT created_at, alert_id, device_id, device_type, alert_type,
            CASE WHEN alert_type <> 'stuck_sensor' THEN severity END AS severity, message,
            round(CASE WHEN alert_type = 'stuck_sensor' THEN threshold END, 6) AS threshold, round(value, 6) AS value,
            CASE WHEN alert_type = 'stuck_sensor' THEN 'KeyError' END AS error_type FROM alerts"""),
        "alert_messages": _with(alerts, "SELECT event_id, alert_type, message FROM alerts"),
        "alert_identity": _with(alerts, "SELECT event_id, alert_type, alert_id, created_at FROM alerts"),
        "log_level": _with(LINES, "SELECT event_id, level, strict_level FROM labelled"),
        "log_service": _with(LINES, "SELECT event_id, service FROM labelled"),
        "log_records": _with(LINES, """SELECT event_id, ts AS logged_at, CASE WHEN k % 5 = 0 THEN lvl ELSE lower(lvl) END AS level,
            name AS service, CASE WHEN k % 5 = 0 THEN 'main' END AS logger, txt AS message,
            CASE WHEN k % 5 = 0 THEN cast(user_id AS varchar) END AS extra_user, NULL::varchar AS exception
            FROM scanned WHERE k % 5 IN (0, 1)"""),
        "log_lines_refused": _with(LINES, """SELECT event_id, app, 'PlainText' AS error_type, line AS raw FROM lines
            WHERE k % 20 = 19 OR k % 5 NOT IN (0, 1)"""),
        "ingest_batch_explode": _with(TELEMETRY, """SELECT event_id, i::bigint AS sequence, device_id, sensor_id,
            time + to_seconds(i) AS time, round(raw + i, 6) AS value
            FROM (SELECT *, unnest(range(k % 3 + 1)) AS i FROM telemetry)"""),
        "typed_payload": _with(TYPED, """SELECT event_id, payload_type,
            round(CASE WHEN payload_type = 'scalar' THEN raw END, 6) AS scalar,
            round(CASE WHEN payload_type = 'vibration' THEN raw / 40 END, 6) AS x,
            round(CASE WHEN payload_type = 'vibration' THEN k::double / 100 END, 6) AS y,
            CASE WHEN payload_type = 'vibration' THEN 0.5::double END AS z,
            CASE WHEN payload_type = 'power' THEN 380.0::double END AS voltage,
            round(CASE WHEN payload_type = 'power' THEN raw / 10 END, 6) AS current,
            round(CASE WHEN payload_type = 'power' THEN raw END, 6) AS power,
            round(CASE WHEN payload_type = 'power' THEN k::double / 100 END, 6) AS power_factor,
            CASE WHEN payload_type = 'boolean' THEN k % 2 = 0 END AS state FROM typed"""),
        # filters
        "threshold_check": _with(alerts, """SELECT event_id, severity, round(reported_limit, 6) AS reported_limit,
            round(breached_limit, 6) AS breached_limit FROM checked"""),
        "bad_records": _with(POISON, "SELECT worker, error_type, event_id, time, arrived_at FROM poison"),
        "ingest_validate": _with(TYPED, """SELECT event_id, device_type, sensor_type, payload_type,
            CASE WHEN device_type = 'prototype' THEN 'unknown_device_type'
                 WHEN sensor_type IN ('vibration', 'power') AND payload_type <> sensor_type THEN 'payload_type_mismatch'
            END AS reject_reason FROM typed"""),
        "recent_by_device": _with(TELEMETRY, """SELECT device_id, recency::int AS recency, event_id, time, sensor_id FROM (
            SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY time DESC, event_id DESC) AS recency FROM telemetry)
            WHERE recency <= 5"""),
        "recent_by_sensor_type": _with(TELEMETRY, """SELECT sensor_type, recency::int AS recency, event_id, time, device_id FROM (
            SELECT *, row_number() OVER (PARTITION BY sensor_type ORDER BY time DESC, event_id DESC) AS recency FROM telemetry)
            WHERE recency <= 100"""),
        "recent_kpis": _with(_tumbling("1 hour"), """SELECT device_id, kpi_name, recency::int AS recency, window_start, sensor_id,
            kpi_value FROM (SELECT *, row_number() OVER (PARTITION BY device_id, kpi_name
            ORDER BY window_start DESC, sensor_id DESC) AS recency FROM tumbling) WHERE recency <= 3"""),
        "recent_kpis_by_name": _with(_tumbling("1 hour"), """SELECT kpi_name, recency::int AS recency, window_start, device_id,
            sensor_id, kpi_value FROM (SELECT *, row_number() OVER (PARTITION BY kpi_name
            ORDER BY window_start DESC, device_id DESC, sensor_id DESC) AS recency FROM tumbling) WHERE recency <= 20"""),
        "recent_alerts_by_severity": _with(alerts, """SELECT severity, recency::int AS recency, created_at, alert_id, device_id FROM (
            SELECT *, row_number() OVER (PARTITION BY severity ORDER BY created_at DESC, alert_id DESC) AS recency
            FROM alerts) WHERE recency <= 100"""),
        "recent_alerts": _with(alerts, """SELECT device_id, severity, recency::int AS recency, created_at, alert_id, alert_type FROM (
            SELECT *, row_number() OVER (PARTITION BY device_id, severity ORDER BY created_at DESC, alert_id DESC) AS recency
            FROM alerts) WHERE recency <= 10"""),
        "unacked_alerts": _with(alerts, f"""SELECT created_at, alert_id, device_id, alert_type, severity, round(value, 6) AS value
            FROM alerts WHERE NOT ({acknowledged})"""),
        "logs_select": _with(LINES, """SELECT event_id, ts, app, level, service FROM labelled WHERE namespace = 'plant-a'
            AND ts >= (SELECT max(ts) FROM b) - INTERVAL 1 HOUR"""),
        "logs_by_label": _with(LINES, "SELECT event_id, ts, app, level, service FROM labelled WHERE namespace = 'plant-a' AND service = 'svc-3'"),
        "logs_late_reject": _with(LINES, "SELECT event_id, ts, pod FROM scanned WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR"),
        # joins
        "threshold_lookup": _with(alerts, """SELECT event_id, device_type, sensor_type, wl AS warning_low, wh AS warning_high,
            cl AS critical_low, ch AS critical_high FROM looked"""),
        # KPIs
        "kpis_long": _with(f"{TELEMETRY}, wide AS ({_wide('readings')})", f"""SELECT device_id, device_type, sensor_id, sensor_type,
            sample_count, round(kpi_value, 6) AS kpi_value, kpi_name FROM ({_long('wide')})"""),
        "kpi_window_bounds": _with(TELEMETRY, f"""SELECT TIMESTAMP '2024-01-10' AS window_start, max(time) AS window_end
            FROM telemetry WHERE {RANGE}"""),
        "kpis_incremental": _with(KPI_RANGE_TABLE, "SELECT * FROM kpis"),
        "kpis_with_late_rows": _with(LATE_KPIS, "SELECT * FROM kpis"),
        "kpis_merged_from_partials": _with(LATE_KPIS, "SELECT * FROM kpis"),
        "kpis_tumbling_5min": _with(_tumbling("5 minutes"), "SELECT * FROM tumbling"),
        "kpis_tumbling_1hr": _with(_tumbling("1 hour"), "SELECT * FROM tumbling"),
        # metrics
        "metric_telemetry_received": _with(TELEMETRY, "SELECT device_type, sensor_type, count(*) AS value FROM telemetry GROUP BY ALL"),
        "metric_telemetry_stored": _with(TELEMETRY, "SELECT device_type, count(*) AS value FROM good GROUP BY ALL"),
        "metric_alerts_generated": _with(alerts, "SELECT alert_type, severity, count(*) AS value FROM alerts GROUP BY ALL"),
        "metric_threshold_checks": _with(TELEMETRY, "SELECT sensor_type, count(*) AS value FROM readings GROUP BY ALL"),
        "metric_alerts_stored": _with(alerts, "SELECT alert_type, severity, count(*) AS value FROM alerts GROUP BY ALL"),
        "metric_alerts_active": _with(alerts, "SELECT DISTINCT device_id, alert_type, 1 AS value FROM alerts"),
        "metric_kpis_computed": _with(KPI_TABLE, "SELECT kpi_name, count(*) AS value FROM kpis GROUP BY ALL"),
        "metric_job_duration": _with("""runs AS (SELECT 'kpi_' || lower(l_returnflag) AS job_name,
            l_quantity * l_discount * 4 AS s FROM lineitem), le(le) AS (VALUES """ + ", ".join(
                f"({b}::double)" for b in BUCKETS) + ", ('infinity'::double))",
            """SELECT job_name, (SELECT round(sum(s), 6) FROM runs q WHERE q.job_name = r.job_name) AS sum_seconds,
            (SELECT count(*) FROM runs q WHERE q.job_name = r.job_name) AS observations, le.le,
            count(*) FILTER (WHERE s <= le.le) AS bucket FROM runs r, le GROUP BY ALL"""),
        "metric_processing_errors": _with(f"{alerts}, {POISON.removeprefix(TELEMETRY).lstrip(', ')}", """SELECT worker, error_type, count(*) AS value FROM (
            SELECT worker, error_type FROM poison UNION ALL
            SELECT 'alert', 'KeyError' FROM alerts WHERE alert_type = 'stuck_sensor') GROUP BY ALL"""),
        "rate_telemetry_1m": _with(TELEMETRY, _rate("SELECT device_type, sensor_type, time AS moment FROM telemetry", 60, "device_type, sensor_type,")),
        "rate_alerts_5m": _with(alerts, _rate("SELECT alert_type, severity, created_at AS moment FROM alerts", 300, "alert_type, severity,")),
        "rate_errors_5m": _with(POISON, _rate("SELECT arrived_at AS moment FROM poison", 300, "")),
        "active_alert_count": _with(alerts, "SELECT count(*) AS active_alerts FROM (SELECT DISTINCT device_id, alert_type FROM alerts)"),
        "total_stored": _with(TELEMETRY, "SELECT count(*) AS total_stored FROM telemetry"),
        "total_kpis": _with(KPI_TABLE, "SELECT count(*) AS total_kpis FROM kpis"),
        # windows, alerts, top-k
        "alerts_threshold": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts WHERE alert_type = 'threshold_breach'"),
        "alerts_rapid_change": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts WHERE alert_type = 'rapid_change'"),
        "alerts_stuck_sensor": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts WHERE alert_type = 'stuck_sensor'"),
        "alerts_all": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts"),
        "alerts_all_merged_limits": _with(merged, f"SELECT {ALERT_OUT} FROM alerts"),
        "throughput_delta": """WITH s AS (SELECT ts AS sample_ts, event_id AS "count", lag(ts) OVER w AS pt, lag(event_id) OVER w AS pc
            FROM events WINDOW w AS (ORDER BY ts, event_id))
            SELECT sample_ts, "count", "count" - coalesce(pc, 0) AS delta, round(CASE WHEN epoch_us(sample_ts) > epoch_us(pt)
            THEN ("count" - coalesce(pc, 0)) / ((epoch_us(sample_ts) - epoch_us(pt)) / 1000000.0::double) END, 6) AS per_second FROM s""",
        "top5_telemetry": _with(TELEMETRY, "SELECT event_id, time, device_id, sensor_id FROM telemetry ORDER BY time DESC, event_id DESC LIMIT 5"),
        "top5_telemetry_stored": _with(TELEMETRY, "SELECT event_id, time, device_id, sensor_id FROM telemetry ORDER BY time DESC, event_id DESC LIMIT 5"),
        "top10_unacked_alerts_stored": _with(alerts, f"""SELECT created_at, alert_id, device_id, alert_type, severity, round(value, 6) AS value
            FROM alerts WHERE NOT ({acknowledged}) ORDER BY created_at DESC, alert_id DESC LIMIT 10"""),
        "top5_alerts": _with(alerts, """SELECT created_at, alert_id, device_id, alert_type, severity, round(value, 6) AS value
            FROM alerts ORDER BY created_at DESC, alert_id DESC LIMIT 5"""),
        "top10_kpis": _with(_tumbling("1 hour"), """SELECT window_start, device_id, sensor_id, kpi_name, kpi_value FROM tumbling
            ORDER BY window_start DESC, device_id DESC, sensor_id DESC, kpi_name DESC LIMIT 10"""),
        "telemetry_count": _with(TELEMETRY, "SELECT count(*) AS telemetry_rows FROM telemetry"),
        # streaming-only, lifecycle
        "late_rows_report": _with(f"""{TELEMETRY}, arrived AS (SELECT *, CASE WHEN k % 10 = 0
            THEN make_timestamp((epoch_us(time) // 1000000 + k * 3600) * 1000000) ELSE time END AS arrived_at FROM telemetry)""",
            """SELECT event_id, time, arrived_at, round((epoch_us(arrived_at) - epoch_us(time)) / 1000000.0::double, 6) AS late_by_s
            FROM arrived WHERE time <= TIMESTAMP '2024-01-10' AND arrived_at > TIMESTAMP '2024-01-10'"""),
        "telemetry_dedup": _with(TELEMETRY, f"SELECT {columns} FROM telemetry"),
        "stream_alerts_all": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts"),
        "stream_alerts_by_batch": _with(alerts, f"SELECT {ALERT_OUT} FROM alerts"),
        "stream_landing": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, {numbers_17} FROM good"),
        "landing_compacted": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, cast(-1 AS integer) AS batch_id, {numbers_17} FROM good"),
        "landing_replayed_after_compaction": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, cast(-1 AS integer) AS batch_id, {numbers_17} FROM good"),
        "landing_in_flushes": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, {numbers} FROM telemetry"),
        "landing_resumed": _with(TELEMETRY, f"SELECT {columns}, cast(time AS date) AS dt, {numbers} FROM telemetry"),
        "stream_fan_out": _with(POISON, """SELECT 'landing' AS consumer, device_type AS kind, count(*) AS records FROM good GROUP BY ALL
            UNION ALL SELECT 'watching', error_type, count(*) FROM poison GROUP BY ALL"""),
        "telemetry_partitions": _with(TELEMETRY, """SELECT cast(time AS date) AS dt, count(*) AS "rows", min(time) AS first_time,
            max(time) AS last_time FROM telemetry GROUP BY ALL"""),
        "retention_30d": _with(TELEMETRY, """SELECT event_id, time, device_id FROM telemetry
            WHERE time >= TIMESTAMP '2024-02-07' - INTERVAL 30 DAY"""),
        "retention_168h": _with(TELEMETRY, """SELECT event_id, time, device_id FROM telemetry
            WHERE time >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR"""),
        "compaction_candidates": _with(TELEMETRY, """SELECT cast(time AS date) AS dt, device_id, sensor_type, count(*) AS "rows",
            min(time) AS first_time, max(time) AS last_time FROM telemetry WHERE time < TIMESTAMP '2024-01-24' GROUP BY ALL"""),
        # health
        "consumer_lag": _with(OFFSETS, "SELECT * FROM lags"),
        "health_class": _with(f"{OFFSETS}, {RUNS}", f"""SELECT *, {HEALTH} AS health FROM (
            SELECT group_id AS subject, lag FROM lags UNION ALL SELECT 'run-' || run_id, lag FROM runs)"""),
        "reconcile_counts": _with(TELEMETRY, """SELECT device_id, count(*) AS sent, count(*) FILTER (WHERE k % 25 NOT IN (3, 7, 11, 13)) AS stored,
            count(*) FILTER (WHERE k % 25 IN (3, 7, 11, 13)) AS lost,
            round(count(*) FILTER (WHERE k % 25 NOT IN (3, 7, 11, 13)) / 60.0::double, 6) AS rate FROM telemetry GROUP BY ALL"""),
        "reconcile_lost": _with(TELEMETRY, "SELECT event_id, device_id AS key FROM telemetry WHERE k % 25 IN (3, 7, 11, 13)"),
        "reconcile_lost_by_bucket": _with(TELEMETRY, "SELECT event_id, device_id AS key FROM telemetry WHERE k % 25 IN (3, 7, 11, 13)"),
        "bottleneck_class": _with(RUNS, """SELECT run_id, CASE WHEN database_cpu > 800 THEN 'database' WHEN worker_cpu > 800 THEN 'worker'
            WHEN ingestion_cpu > 800 THEN 'ingestion' WHEN errors > sent // 10 THEN 'ingestion' WHEN lag > 1000 THEN 'worker'
            ELSE 'none' END AS bottleneck FROM runs"""),
        "tuning_decision": _with(RUNS, """SELECT run_id, throughput, lag, CASE WHEN throughput >= target AND lag < 100 THEN 'done'
            WHEN lag > 500 THEN 'worker' WHEN throughput < target // 2 THEN 'ingestion' ELSE 'worker' END AS decision FROM runs"""),
        # devices
        "devices_list": _with(DEVICES, "SELECT * FROM devices"),
        "device_get": _with(DEVICES, """SELECT w.id, d.name, d.type, d.status, d.location, d.created_at, d.id IS NOT NULL AS found
            FROM (SELECT DISTINCT id FROM changes) w LEFT JOIN devices d USING (id)"""),
        "device_create": """SELECT sha256(cast(s_suppkey AS varchar)) AS id, s_name AS name, 'supplier' AS type,
            CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'inactive' END AS status, 'site-' || s_nationkey AS location,
            TIMESTAMP '2024-01-31' AS created_at FROM supplier""",
        "device_update": _with(f"""{DEVICES}, latest AS (SELECT * FROM changes WHERE op = 'update'
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, change_id DESC) = 1)""",
            """SELECT d.id, CASE WHEN u.id IS NULL THEN d.name ELSE u.name END AS name,
            CASE WHEN u.id IS NULL THEN d.type ELSE u.type END AS type,
            CASE WHEN u.id IS NULL THEN d.status ELSE coalesce(u.status, 'inactive') END AS status,
            CASE WHEN u.id IS NULL THEN d.location ELSE u.location END AS location, d.created_at
            FROM devices d LEFT JOIN latest u ON u.id = d.id"""),
        "device_delete": _with(DEVICES, "SELECT * FROM devices WHERE id NOT IN (SELECT id FROM changes WHERE op = 'delete')"),
        "devices_apply_changes": _with(f"""{DEVICES}, written AS (SELECT * FROM changes WHERE op <> 'delete'
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, change_id DESC) = 1),
            born AS (SELECT id, min(changed_at) AS at FROM changes WHERE op = 'create' GROUP BY id),
            ids AS (SELECT id FROM devices UNION SELECT id FROM born)""",
            """SELECT i.id, CASE WHEN w.id IS NULL THEN d.name ELSE w.name END AS name,
            CASE WHEN w.id IS NULL THEN d.type ELSE w.type END AS type,
            CASE WHEN w.id IS NULL THEN d.status ELSE coalesce(w.status, 'inactive') END AS status,
            CASE WHEN w.id IS NULL THEN d.location ELSE w.location END AS location,
            coalesce(d.created_at, b.at) AS created_at
            FROM ids i LEFT JOIN devices d USING (id) LEFT JOIN written w USING (id) LEFT JOIN born b USING (id)
            WHERE i.id NOT IN (SELECT id FROM changes WHERE op = 'delete')"""),
    }
    for name in ("avg", "min", "max", "count", "std_dev", "range", "rms", "crest_factor", "rate_of_change", "energy"):
        sql[f"kpi_{name}"] = _with(f"{TELEMETRY}, wide AS ({_wide('readings')})", f"""SELECT device_id, device_type, sensor_id,
            sensor_type, round("{name}", 6) AS kpi_value, sample_count FROM wide WHERE "{name}" IS NOT NULL""")
    return sql
