"""Message decoding, quarantine, tables, upserts, logs, validation."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.operators import health, lifecycle, recent
from pulsegrid.operators.upsert import deduplicate, merge_into, merge_upsert, read_keyed, upsert_latest
from pulsegrid.sources import ledger, logs, messages, tables, topics

GOOD = {
    "deviceId": "press-9", "deviceType": "mill", "sensorId": "probe-3", "sensorType": "temperature",
    "timestamp": "2023-06-02T08:15:30Z", "unit": "celsius", "value": {"value": 61.25},
}


def records(spark, *bodies):
    rows = [(None, b if isinstance(b, str) else json.dumps(b), i) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "key string, value string, sequence long")


def test_message_to_row(spark):
    row = messages.good(messages.parse_telemetry(records(spark, GOOD))).withColumn(
        "time", F.col("time").cast("timestamp_ntz")
    ).first()
    assert (row["device_id"], row["device_type"], row["sensor_id"], row["sensor_type"], row["unit"]) == (
        "press-9", "mill", "probe-3", "temperature", "celsius",
    )
    assert row["time"] == datetime(2023, 6, 2, 8, 15, 30)
    assert json.loads(row["value"]) == {"value": 61.25}


@pytest.mark.parametrize(
    "body, checked, landed",
    [
        (GOOD, None, None),
        ("{broken", "JSONDecodeError", "JSONDecodeError"),
        ("", "JSONDecodeError", "JSONDecodeError"),
        ("[1, 2]", "JSONDecodeError", "JSONDecodeError"),
        ({**GOOD, "sensorId": None}, "KeyError", "KeyError"),
        ({k: v for k, v in GOOD.items() if k != "unit"}, "KeyError", "KeyError"),
        ({**GOOD, "timestamp": "soon"}, "ValueError", "ValueError"),
        ({**GOOD, "value": 5}, "TypeError", "TypeError"),
        ({**GOOD, "value": {"value": "n/a"}}, "ValueError", None),
        ({**GOOD, "value": {"value": None}}, "TypeError", None),
        ({**GOOD, "value": {"reading": 3}}, None, None),
        ({**GOOD, "eventId": "a-uuid"}, None, None),
        ({**GOOD, "eventId": 1.5}, None, None),
        ({**GOOD, "eventId": {"a": [1]}}, None, None),
        ({**GOOD, "other": [1, {"a": None}]}, None, None),
    ],
)
def test_poison_records_are_named(spark, body, checked, landed):
    df = records(spark, body)
    assert messages.parse_telemetry(df, check_value=True).first()["error_type"] == checked
    assert messages.parse_telemetry(df).first()["error_type"] == landed


def test_quarantine_keeps_the_whole_text(spark):
    text = "{" + "x" * 100_000
    row = messages.bad(messages.parse_telemetry(records(spark, text)), "stream").first()
    assert (row["worker"], row["error_type"], row["raw"]) == ("stream", "JSONDecodeError", text)


def test_json_is_parsed_once_per_row(spark, plan):
    df = messages.good(messages.parse_telemetry(records(spark, GOOD)))
    assert plan(df).count("from_json") == 1
    stored = spark.createDataFrame([('{"value": 1}', "power")], "value string, sensor_type string")
    assert plan(messages.with_reading(stored)).count("parseJson") == 1


def test_normalised_message_is_keyed_by_device(spark):
    out = messages.normalize(records(spark, {**GOOD, "extra": 1}, "{broken")).collect()
    assert [r["key"] for r in out] == ["press-9"]
    assert json.loads(out[0]["value"]) == {**GOOD, "timestamp": "2023-06-02T08:15:30.000000Z"}


def test_batch_envelope(spark):
    envelope = {"readings": [{**GOOD, "sensorId": f"s{i}"} for i in range(3)]}
    out = messages.explode_batches(records(spark, envelope))
    parsed = messages.good(messages.parse_telemetry(out)).collect()
    assert [(r["sensor_id"], r["event_id"]) for r in parsed] == [("s0", 0), ("s1", 1), ("s2", 2)]


ALERT = {
    "createdAt": "2023-11-08T21:05:09Z", "alertId": "n-77", "deviceId": "press-9", "deviceType": "mill",
    "alertType": "rapid_change", "severity": "warning", "message": "too fast",
}


def test_alert_message_optional_entries(spark):
    rows = messages.parse_alerts(records(spark, {**ALERT, "threshold": 12.5, "value": 19.75}, ALERT)).collect()
    assert [(r["threshold"], r["value"], r["error_type"]) for r in rows] == [(12.5, 19.75, None), (None, None, None)]
    assert messages.parse_alerts(records(spark, {**ALERT, "severity": None})).first()["error_type"] == "KeyError"
    at = messages.parse_alerts(records(spark, ALERT)).select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert at == "2023-11-08 21:05:09"


def test_alert_round_trip(spark):
    rows = messages.parse_alerts(records(spark, ALERT)).drop("error_type", "raw")
    body = json.loads(messages.alert_messages(rows).first()["value"])
    assert body == {**ALERT, "createdAt": "2023-11-08T21:05:09.000000", "threshold": None, "value": None}


def test_validation(spark):
    rows = [("hvac", "temperature", "scalar"), ("invalid", "temperature", "scalar"), ("hvac", "temperature", "vibration"),
            ("hvac", "speed", "anything")]
    df = spark.createDataFrame(rows, "device_type string, sensor_type string, payload_type string")
    device_types = spark.createDataFrame([("hvac",)], "device_type string")
    kinds = spark.createDataFrame([("temperature", "scalar")], "sensor_type string, payload_type string")
    got = {tuple(r[c] for c in df.columns): r["reject_reason"] for r in messages.validate(df, device_types, kinds).collect()}
    assert list(map(got.get, rows)) == [None, "unknown_device_type", "payload_type_mismatch", None]


# --- tables ---


def telemetry(spark, days=3, per_day=4):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [
        (d * 100 + i, start + timedelta(days=d, hours=i), f"d{i % 2}", "hvac", "s", "power", "watt", '{"value": 1}')
        for d in range(days) for i in range(per_day)
    ]
    return spark.createDataFrame(rows, schemas.TELEMETRY_TABLE)


def test_append_keeps_duplicates_and_prunes_days(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    tables.append_rows(telemetry(spark), path, files_per_day=2)
    tables.append_rows(telemetry(spark), path)
    table = tables.read_table(spark, path)
    assert table.count() == 24
    after, until = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (2, 3))
    chosen = tables.in_range(table, after, until).select("time")
    text = plan(chosen)
    assert "dt" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(time" in text and chosen.count() == 8
    assert "ReadSchema: struct<time:timestamp>" in text


def test_rewriting_a_batch_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        tables.write_batch(telemetry(spark), path, 7)
    tables.write_batch(telemetry(spark, days=1), path, 8)
    counts = {r["batch_id"]: r["count"] for r in tables.read_table(spark, path).groupBy("batch_id").count().collect()}
    assert counts == {7: 12, 8: 4}


def test_parameterised_query(spark):
    out = tables.param_query(spark, "SELECT count(*) AS n FROM {t} WHERE event_id >= :low", {"low": 200}, t=telemetry(spark))
    assert out.first()["n"] == 4


def test_upsert_latest_limits_groups_before_the_shuffle(spark, plan):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "k string, v int, p string")
    out = upsert_latest(df, ("k",), ("v",))
    assert {(r["k"], r["p"]) for r in out.collect()} == {("a", "z"), ("b", "q")}
    before_shuffle = plan(out).split("Exchange hashpartitioning(k")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_merge_keeps_columns_the_update_leaves_alone(spark):
    layout = "id string, message string, acknowledged boolean"
    current = spark.createDataFrame([("a", "old", True), ("b", "old", False)], layout)
    incoming = spark.createDataFrame(
        [("a", "new1", False, 1), ("a", "new2", False, 2), ("c", "fresh", False, 1)], layout + ", version int"
    )
    out = merge_upsert(current, incoming, ("id",), ("version",), keep=("acknowledged",)).collect()
    assert {tuple(r) for r in out} == {("a", "new2", True), ("b", "old", False), ("c", "fresh", False)}


def test_deduplicate(spark):
    df = telemetry(spark)
    assert deduplicate(df.unionByName(df)).count() == 12


def test_retention_and_compaction(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "c")
    as_of = datetime(2024, 1, 10, tzinfo=timezone.utc)
    for batch in range(2):
        tables.write_batch(tables.with_day(telemetry(spark)), path, batch, ("dt",))
    table = tables.read_table(spark, path)
    kept = lifecycle.retain(table, as_of, timedelta(days=8))
    assert kept.select("dt").distinct().count() == 2
    candidates = lifecycle.compaction_candidates(table, as_of, timedelta(days=7))
    assert {(str(r["dt"]), r["device_id"], r["rows"]) for r in candidates.collect()} == {
        (day, device, 4) for day in ("2024-01-01", "2024-01-02") for device in ("d0", "d1")
    }
    lifecycle.compact_day(spark, path, "2024-01-01", target)
    assert tables.read_table(spark, target).count() == 8
    assert lifecycle.drop_expired(spark, path, as_of, timedelta(days=7)) == 2
    assert tables.read_table(spark, path).select("dt").distinct().count() == 1


# --- logs and topics ---


def test_log_files_to_records(spark, tmp_path):
    folder = tmp_path / "logs" / "api" / "pod-1"
    folder.mkdir(parents=True)
    record = {"timestamp": "2024-01-15T10:30:00+00:00", "level": "ERROR", "service": "svc", "logger": "m", "message": "boom",
              "extra": {"n": 1, "deep": {"a": 2}}, "exception": "Traceback"}
    (folder / "0.log").write_text(json.dumps(record) + "\n\nplain WARN line\n")
    lines = logs.read_lines(spark, str(tmp_path / "logs"))
    rows = {r["line"]: r for r in logs.enrich(lines, "plant").collect()}
    assert len(rows) == 2
    assert (rows["plain WARN line"]["level"], rows["plain WARN line"]["service"]) == ("warn", "api")
    assert {(r["app"], r["pod"], r["namespace"]) for r in rows.values()} == {("api", "pod-1", "plant")}
    parsed = logs.parse_records(logs.scan(lines)).collect()
    assert len(parsed) == 1 and parsed[0]["extra"] == {"n": "1", "deep": '{"a":2}'} and parsed[0]["exception"] == "Traceback"


def test_log_selection_and_age(spark, tmp_path):
    now = datetime(2024, 1, 10, tzinfo=timezone.utc)
    rows = [(now - timedelta(minutes=30), "a"), (now - timedelta(hours=2), "a"), (now - timedelta(days=8), "a"),
            (now, "b"), (now + timedelta(minutes=1), "a")]
    df = spark.createDataFrame(rows, "ts timestamp, namespace string")
    assert logs.select_logs(df, now, namespace="a").count() == 1
    assert logs.reject_late(df, now).count() == 4


def test_topic_builders(spark, tmp_path):
    options = topics.kafka_options("broker:9092", "telemetry")
    assert options["startingOffsets"] == "earliest" and options["subscribe"] == "telemetry"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text("one\ntwo\n")
    out = topics.replay_topic(spark, "text", str(tmp_path / "in"))
    assert out.columns == ["key", "value", "sequence", "arrived_at"] and {r["value"] for r in out.collect()} == {"one", "two"}
    keyed = topics.publish(spark.createDataFrame([("k", 1)], "id string, n int"), "id").first()
    assert keyed["key"] == "k" and json.loads(keyed["value"]) == {"id": "k", "n": 1}


def test_jdbc_options():
    from pulsegrid.sources import jdbc

    opts = jdbc.options("jdbc:x://h/db", "telemetry", "u", "p", {"fetchsize": "1000"})
    assert opts["dbtable"] == "telemetry" and opts["fetchsize"] == "1000"
    day = datetime(2024, 1, 1)
    assert jdbc.time_slices("time", day, day + timedelta(days=1), 8) == {
        "partitionColumn": "time", "lowerBound": "2024-01-01 00:00:00", "upperBound": "2024-01-02 00:00:00", "numPartitions": "8",
    }


def test_merge_shuffles_incoming_rows_once(spark, plan):
    layout = "id string, message string"
    current = spark.createDataFrame([("a", "old")], layout)
    incoming = spark.createDataFrame([("a", "new", 1)], layout + ", version int")
    text = plan(merge_upsert(current, incoming, ("id",), ("version",)))
    assert text.count("Exchange hashpartitioning(id") == 2  # one for each side


def test_logs_as_a_stream(spark, tmp_path):
    folder = tmp_path / "logs" / "api" / "pod-1"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("level=warn service=s a\n\nplain\n")
    lines = logs.read_lines(spark, str(tmp_path / "logs"), streaming=True)
    rows = logs.to_stream_rows(logs.enrich(lines, "plant").withColumn("ts", F.current_timestamp()))
    out = rows.writeStream.format("parquet").partitionBy("namespace", "app").trigger(availableNow=True)
    query = out.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(60)
    logs.write_logs(spark.read.parquet(f"{tmp_path}/out"), f"{tmp_path}/copy")
    got = spark.read.parquet(f"{tmp_path}/copy").collect()
    assert {(r["app"], r["pod"], r["level"], r["service"], r["line"]) for r in got} == {
        ("api", "pod-1", "warn", "s", "level=warn service=s a"), ("api", "pod-1", "info", "api", "plain"),
    }


def test_compacting_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, batch_id int")
    lifecycle.compact_versions(df, ("k",), ("batch_id",), str(tmp_path / "t"))
    assert {tuple(r) for r in tables.read_table(spark, str(tmp_path / "t")).collect()} == {("a", 2), ("b", 1)}


def test_identity_is_the_producers_before_the_position(spark):
    df = records(spark, {**GOOD, "eventId": 40}, {**GOOD, "eventId": 40}, {**GOOD, "eventId": "x"}, GOOD)
    rows = messages.good(messages.parse_telemetry(df))
    assert [r["event_id"] for r in rows.collect()] == [40, 40, 2, 3]
    # one reading, however often and wherever it stands in the topic
    assert deduplicate(rows).count() == 1


def test_positions_of_two_partitions_differ(spark):
    broker = spark.createDataFrame([(b"k", b"v", p, 7, datetime(2024, 1, 1)) for p in (0, 3)], "key binary, value binary, partition int, offset long, timestamp timestamp")
    out = topics._records(broker, "kafka").collect()
    assert len({r["sequence"] for r in out}) == 2 and all(r["arrived_at"] is not None for r in out)


def test_refused_records_keep_their_arrival(spark):
    at = datetime(2024, 1, 2, 3, 4)
    df = spark.createDataFrame([("{broken", at), (json.dumps(GOOD), at)], "value string, arrived_at timestamp_ntz")
    parsed = messages.parse_telemetry(df)
    assert [r["arrived_at"] for r in messages.bad(parsed, "w").collect()] == [at]
    assert "arrived_at" not in messages.good(parsed).columns and "arrived_at" in messages.good(parsed, keep_arrival=True).columns


def test_mistyped_optional_entries_of_an_alert(spark):
    row = messages.parse_alerts(records(spark, {**ALERT, "threshold": "high", "value": [1]})).first()
    assert (row["threshold"], row["value"], row["error_type"]) == (None, None, None)


def test_no_log_line_is_lost(spark):
    lines = ['  {"level":"INFO","message":"a"}', '{"level":"INFO","mess', '{"level":"WARN","message":"b","extra":5}', "plain", '{"level":"INFO","message":"c"}', ""]
    df = spark.createDataFrame(list(enumerate(lines)), "event_id long, line string")
    assert {(r["event_id"], r["message"]) for r in logs.parse_records(df).collect()} == {(0, "a"), (2, "b"), (4, "c")}
    refused = {(r["event_id"], r["error_type"], r["raw"]) for r in logs.refused_lines(df).collect()}
    assert refused == {(1, "JSONDecodeError", lines[1]), (3, "PlainText", "plain"), (5, "PlainText", "")}


def landed(spark, path, batches):
    for batch in batches:
        ledger.append(tables.with_day(telemetry(spark)), path, "w", batch)


def per_day(spark, path):
    rows = ledger.read(spark, path).groupBy("dt").agg(F.count("*").alias("n"), F.count_distinct("batch_id").alias("b")).collect()
    return {str(r["dt"]): (r["n"], r["b"]) for r in rows}


@pytest.mark.parametrize("dies_at", [None, "rows", "commit"])
def test_days_are_compacted_in_place(spark, tmp_path, dies_at, monkeypatch):
    path = str(tmp_path / "t")
    landed(spark, path, range(5))
    days = ["2024-01-01", "2024-01-02"]
    before = {"2024-01-01": (20, 5), "2024-01-02": (20, 5), "2024-01-03": (20, 5)}
    if dies_at:
        real = ledger._commit

        def dying(rows, where):
            raise RuntimeError("driver lost")

        monkeypatch.setattr(ledger, "_commit", dying)
        with pytest.raises(RuntimeError):
            lifecycle.compact_days(spark, path, days) if dies_at == "commit" else landed(spark, path, [5])
        monkeypatch.setattr(ledger, "_commit", real)
        # rows of the run that died lie there, but nobody sees them
        assert spark.read.parquet(path).count() > ledger.read(spark, path).count()
        assert per_day(spark, path) == before
    assert lifecycle.compact_days(spark, path, days)
    assert per_day(spark, path) == {"2024-01-01": (20, 1), "2024-01-02": (20, 1), "2024-01-03": (20, 5)}
    # what lands afterwards is compacted together with the rows of before
    landed(spark, path, [9])
    lifecycle.compact_days(spark, path, days[:1])
    assert per_day(spark, path)["2024-01-01"] == (24, 1)
    assert not lifecycle.compact_days(spark, path, ["2030-01-01"])  # nothing there
    assert ledger.last_batch(spark, path, "w") == 9 and ledger.last_batch(spark, path, "other") == -1


def test_rows_that_land_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    landed(spark, path, [0, 1])
    real, landed_once = ledger._commit, []

    def slow(rows, where):
        if not landed_once:
            landed_once.append(1)
            landed(spark, path, [2])
        real(rows, where)

    monkeypatch.setattr(ledger, "_commit", slow)
    lifecycle.compact_days(spark, path, ["2024-01-01"])
    assert per_day(spark, path)["2024-01-01"] == (12, 2)


def test_of_two_compactions_one_gives_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    landed(spark, path, [0, 1])
    real, once = ledger.work_dir, []

    def racing(s, name):
        out = real(s, name)
        if not once:
            once.append(1)
            monkeypatch.setattr(ledger, "work_dir", real)
            reader = ledger.facts
            stale = reader(s, path).collect()
            lifecycle.compact_days(spark, path, ["2024-01-01"])
            # the outer run has settled on what it read before
            monkeypatch.setattr(ledger, "facts", lambda a, b: (monkeypatch.setattr(ledger, "facts", reader), s.createDataFrame(stale, ledger.FACTS))[1])
        return out

    monkeypatch.setattr(ledger, "work_dir", racing)
    with pytest.raises(RuntimeError, match="another job"):
        lifecycle.compact_days(spark, path, ["2024-01-01"])
    assert per_day(spark, path)["2024-01-01"] == (8, 1)


def test_tidying_keeps_what_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    landed(spark, path, range(4))
    lifecycle.compact_days(spark, path, ["2024-01-01", "2024-01-02"])
    rows = sorted(map(str, ledger.read(spark, path).collect()))
    data = lambda: sum(1 for _ in (tmp_path / "t").glob("dt=*/*.parquet"))
    facts = lambda: sum(1 for _ in (tmp_path / "t" / "_ledger" / "commits").glob("*.parquet"))
    before = data()
    assert ledger.tidy(spark, path, timedelta(days=1)) == (0, 5) and data() == before and facts() == 1
    later = datetime.now(timezone.utc) + timedelta(days=2)
    dropped, _ = ledger.tidy(spark, path, timedelta(days=1), later)
    assert dropped > 0 and data() == before - dropped
    for _ in range(2):
        ledger.tidy(spark, path, timedelta(days=1), later)
        assert sorted(map(str, ledger.read(spark, path).collect())) == rows
    assert ledger.last_batch(spark, path, "w") == 3
    # whole parts that are gone leave no facts behind: the two days' parts still have the third day
    lifecycle.compact_days(spark, path, ["2024-01-03"])
    for _ in range(3):
        ledger.tidy(spark, path, timedelta(0), later + timedelta(days=1))
    assert ledger.facts(spark, path).where("not live").count() == 0 and ledger.facts(spark, path).count() == 3
    assert per_day(spark, path) == {f"2024-01-0{d}": (16, 1) for d in (1, 2, 3)}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("id AS k", "id % 7 AS v", "0 AS version", "true AS seen")
    assert merge_into(spark, path, rows, ("k",), ("version",), "w", 0, keep=("seen",)) == list(range(64))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    ten = spark.range(10).selectExpr("id * 3 + 1990 AS k", "cast(100 AS bigint) AS v", "1 AS version", "false AS seen")
    touched = merge_into(spark, path, ten, ("k",), ("version",), "w", 1, keep=("seen",))
    after = files()
    assert len(touched) <= 10 and all(after[p] == t for p, t in before.items())
    assert {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)} == {str(b) for b in touched}
    want = {k: (k % 7, 0, True) for k in range(2000)} | {k * 3 + 1990: (100, 1, k * 3 + 1990 < 2000) for k in range(10)}
    table = lambda: {r.k: (r.v, r.version, r.seen) for r in read_keyed(spark, path).collect()}
    assert table() == want
    # run again after a crash behind the commit
    assert merge_into(spark, path, ten.withColumn("v", F.lit(0)), ("k",), ("version",), "w", 1) == []
    assert table() == want
    ledger.tidy(spark, path, timedelta(0), datetime.now(timezone.utc) + timedelta(days=1), "bucket")
    assert table() == want and len(files()) == 64


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    merge_into(spark, path, rows, ("k",), ("n",), "w", 0, buckets=4)
    real = ledger._commit

    def dying(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(ledger, "_commit", dying)
    new = spark.createDataFrame([(1, "c", 2), (3, None, 2), (3, "z", 3)], "k int, v string, n int")
    with pytest.raises(RuntimeError):
        merge_into(spark, path, new, ("k",), ("n",), "w", 1, buckets=4)
    assert sorted(tuple(r) for r in read_keyed(spark, path).collect()) == [(1, "a", 1), (2, "b", 1)]
    monkeypatch.setattr(ledger, "_commit", real)
    merge_into(spark, path, new, ("k",), ("n",), "w", 1, buckets=4)
    assert sorted(tuple(r) for r in read_keyed(spark, path).collect()) == [(1, "c", 2), (2, "b", 1), (3, "z", 3)]
    merge_into(spark, path, new.limit(0), ("k",), ("n",), "w", 2, buckets=4)
    assert read_keyed(spark, path).count() == 3 and ledger.last_batch(spark, path, "w") == 2


def test_folders_do_not_grow_with_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    landed(spark, path, range(3))
    few = sum(1 for p in (tmp_path / "t").rglob("*") if p.is_dir())
    landed(spark, path, range(3, 12))
    assert sum(1 for p in (tmp_path / "t").rglob("*") if p.is_dir()) == few


def test_latest_writes_need_no_sort_aggregate(spark, plan):
    from pulsegrid import datasets
    from pulsegrid.operators import devices, thresholds

    sf = "/root/testdata/sf0.001"
    changed = devices.apply_changes(datasets.devices(spark, sf), datasets.device_changes(spark, sf))
    for df in (changed, thresholds.resolve(datasets.threshold_revisions(spark, sf))):
        assert "SortAggregate" not in plan(df)


def scanned_rows(df):
    """Rows that the scans of a query that has run have read from their files."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_logs_by_label_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.range(20_000).selectExpr(
        "'plant' AS namespace", "'app' AS app", "concat('svc-', id % 40) AS service", "if(id % 100 = 0, 'error', 'info') AS level",
        "timestamp_seconds(id) AS ts", "id AS n",
    )
    logs.write_segments(rows, path, rows_per_group=500)
    for service, want in (("svc-7", 500), ("svc-77", 0)):
        some = spark.read.parquet(path).where((F.col("namespace") == "plant") & (F.col("service") == service))
        assert len(some.collect()) == want
        assert scanned_rows(some) <= 4000


def test_flush_by_count_or_age():
    assert topics.flush_options() == {"minOffsetsPerTrigger": "1000", "maxTriggerDelay": "150ms"}
    assert topics.flush_options(5, "2s") == {"minOffsetsPerTrigger": "5", "maxTriggerDelay": "2s"}


def test_newest_rows_open_the_newest_days(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    rows = spark.range(300).selectExpr("timestamp_seconds(1704067200 + id * 3600) AS time", "id AS n", "id % 50 = 1 AS odd")
    tables.append_rows(rows, path)
    assert [r.n for r in recent.newest_stored(spark, path, 3).collect()] == [299, 298, 297]
    top = recent.newest_stored(spark, path, 3)
    assert top.collect() and scanned_rows(top) == 12  # the last day alone
    # three that match lie days apart
    found = recent.newest_stored(spark, path, 3, where=F.col("odd"))
    assert [r.n for r in found.collect()] == [251, 201, 151]
    assert recent.newest_stored(spark, path, 1000).count() == 300
    # rows without time come last, and only where the days hold too few
    tables.append_rows(spark.createDataFrame([(None, 1000, False)], "time timestamp, n long, odd boolean"), path)
    assert [r.n for r in recent.newest_stored(spark, path, 301).collect()][-1] == 1000
    assert recent.newest_stored(spark, path, 2).count() == 2


def test_only_differing_buckets_are_compared(spark):
    sent = spark.range(2000).selectExpr("id", "date_add(DATE'2024-01-01', cast(id % 5 AS int)) AS dt", "id * 2 AS n")
    stored = sent.where("id not in (3, 1004)").unionByName(sent.where("id = 7"))
    lost = health.lost_records_by_bucket(sent, stored, ("id",), buckets=16)
    assert sorted(r.id for r in lost.collect()) == [3, 1004]
    assert lost.columns == ["id", "dt", "n"]
    # with the stored side's sums kept, as a table would have them
    kept = health.bucket_sums(stored, ("id",), ("dt",), 16)
    assert sorted(r.id for r in health.lost_records_by_bucket(sent, stored, ("id",), buckets=16, sums=kept).collect()) == [3, 1004]
    assert health.lost_records_by_bucket(sent, sent, ("id",)).count() == 0
    assert health.lost_records_by_bucket(sent, sent.limit(0), ("id",), buckets=4).count() == 2000
    undated = sent.withColumn("dt", F.lit(None).cast("date"))
    assert [r.id for r in health.lost_records_by_bucket(undated, undated.where("id > 0"), ("id",), buckets=4).collect()] == [0]
