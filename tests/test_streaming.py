"""Streams: parity with the batch operators, restarts, crash replay, fan-out."""

import json
import math
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import datasets
from pulsegrid.operators import alerts
from pulsegrid.operators.upsert import upsert_latest
from pulsegrid.sources import tables, topics
from pulsegrid.sources.messages import parse_telemetry, with_reading, good
from pulsegrid.streaming import alerting, kpis, landing, series

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def write_messages(spark, folder, parts):
    """The small telemetry as JSON-lines files in event order, with rising modification times."""
    os.makedirs(folder, exist_ok=True)
    rows = [r["value"] for r in datasets.messages(spark, SF, corrupt=True).orderBy("sequence").collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        path = os.path.join(folder, f"part-{i:03}.txt")
        with open(path, "w") as out:
            out.write("\n".join(rows[i * size:(i + 1) * size]) + "\n")
        os.utime(path, (1_700_000_000 + i * 60,) * 2)
    return rows


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def keys(df):
    return sorted((str(r["event_id"] or 0), r["alert_type"], r["severity"]) for r in df.collect())


def batch_alerts(spark, folder):
    parsed = parse_telemetry(topics.replay_topic(spark, "text", folder), check_value=True)
    return keys(alerts.detect(with_reading(good(parsed)), datasets.thresholds(spark), F.col("time"), hot_rows=None))


def alert_stream(spark, folder, kinds=alerts.KINDS):
    records = topics.stream_topic(spark, "text", folder, max_files=1)
    readings = alerting.telemetry_readings(records)
    return alerting.stream_alerts(readings, datasets.thresholds(spark), F.col("time"), kinds)


def write_stream(df, root):
    writer = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
    return landing.start(writer, None)


def test_stateful_alerts_equal_batch_over_a_restart(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path)
    write_messages(spark, folder, 4)
    hidden = [os.path.join(folder, f"part-{i:03}.txt") for i in (2, 3)]
    later = {path: open(path).read() for path in hidden}
    for path in hidden:
        os.remove(path)
    drain(write_stream(alert_stream(spark, folder), root))
    for i, (path, text) in enumerate(later.items()):
        with open(path, "w") as out:
            out.write(text)
        os.utime(path, (1_700_001_000 + i * 60,) * 2)
    drain(write_stream(alert_stream(spark, folder), root))  # resumes state and offsets from the checkpoint
    assert keys(spark.read.parquet(f"{root}/out")) == batch_alerts(spark, folder)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_micro_batch_alerts_equal_batch(spark, tmp_path, many_chunks, hot_rows):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 4)
    readings = alerting.telemetry_readings(topics.stream_topic(spark, "text", folder, max_files=1))
    paths = [str(tmp_path / name) for name in ("alerts", "tails", "cp")]
    query = drain(
        alerting.start_detecting(readings, datasets.thresholds(spark), *paths, None, F.col("time"), hot_rows)
    )
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert keys(spark.read.parquet(paths[0])) == batch_alerts(spark, folder)
    # a bucket has the version of the last batch that touched it, and maybe the one that batch started from
    versions = spark.read.parquet(paths[1]).groupBy("bucket").agg(F.count_distinct("batch_id").alias("n"), F.max("batch_id").alias("newest")).collect()
    assert max(r["n"] for r in versions) <= 2 and max(r["newest"] for r in versions) == 3


def few_readings(spark, rows):
    layout = "device_id string, sensor_id string, device_type string, sensor_type string, time timestamp, event_id long, v double"
    return spark.createDataFrame([(d, "s", "machine", "power", T0 + timedelta(hours=h), i, v) for i, (d, h, v) in enumerate(rows)], layout)


def detect_batches(spark, tmp_path, batches, **rules):
    """Each batch is a file of the stream."""
    paths = [str(tmp_path / name) for name in ("alerts", "tails", "cp")]
    files, seen = str(tmp_path / "in"), []
    for rows in batches:
        df = few_readings(spark, rows)
        df.coalesce(1).write.mode("append").parquet(files)
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(files)
        drain(alerting.start_detecting(source, datasets.thresholds(spark), *paths, None, F.col("time"), None, **rules))
        seen.append({str(p): p.stat().st_mtime_ns for p in (tmp_path / "tails").glob("bucket=*/batch_id=*/*.parquet")})
    found = spark.read.parquet(paths[0]) if list((tmp_path / "alerts").glob("dt=*")) else None
    return seen, sorted((r.device_id, r.value) for r in found.where("alert_type = 'rapid_change'").collect()) if found else []


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    many = [(f"d{i}", 0, 1.0) for i in range(300)]
    seen, found = detect_batches(spark, tmp_path, [many, [("d7", 1, 50.0), ("d8", 1, 2.0)], [("d7", 2, 1.0)]])
    assert found == [("d7", 1.0), ("d7", 50.0)]
    assert len(seen[0]) > 40
    # two sensors, so two buckets at most have a new version
    assert len({p for p in seen[1] if p not in seen[0]}) <= 2 and all(seen[1][p] == t for p, t in seen[0].items())


@pytest.mark.parametrize(("forget_after", "want"), [(None, [("a", 50.0), ("b", 50.0)]), (timedelta(hours=5), [("b", 50.0)])])
def test_sensors_that_are_silent_are_forgotten(spark, tmp_path, forget_after, want):
    batches = [[("a", 0, 1.0), ("b", 8, 1.0)], [("a", 10, 50.0), ("b", 10, 50.0)]]
    assert detect_batches(spark, tmp_path, batches, buckets=1, forget_after=forget_after)[1] == want


def test_micro_batch_alerts_survive_a_crash_between_the_writes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 3)
    paths = [str(tmp_path / name) for name in ("alerts", "tails", "cp")]
    original, calls = alerting.write_batch, []

    def crash_once(df, path, batch_id, partitions=()):
        original(df, path, batch_id, partitions)
        calls.append(path)
        if len(calls) == 3:  # the alerts of the second batch are written, its tails are not
            raise RuntimeError("executor lost")

    monkeypatch.setattr(alerting, "write_batch", crash_once)

    def run():
        readings = alerting.telemetry_readings(topics.stream_topic(spark, "text", folder, max_files=1))
        return alerting.start_detecting(readings, datasets.thresholds(spark), *paths, None, F.col("time"), None)

    with pytest.raises(Exception, match="executor lost"):
        run().awaitTermination(120)
    drain(run())
    assert keys(spark.read.parquet(paths[0])) == batch_alerts(spark, folder)


def test_threshold_stream_needs_no_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 2)
    query = drain(write_stream(alert_stream(spark, folder, (alerts.THRESHOLD,)), str(tmp_path)))
    assert not query.lastProgress["stateOperators"]
    expected = [k for k in batch_alerts(spark, folder) if k[1] == alerts.THRESHOLD]
    assert keys(spark.read.parquet(f"{tmp_path}/out")) == expected


class Blocks(dict):
    """Stands in for the map state."""

    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


def series_rows(pairs):
    return pd.DataFrame({"at": [t for t, _ in pairs], "event_id": 0, "v": [float(v) for _, v in pairs]})


def test_state_goes_on_over_batches():
    state = (float("nan"), 0)

    def feed(*batches):
        nonlocal state
        (rows,) = series.in_order(map(series_rows, batches), Blocks())
        out, *state = series.advance(rows, *state, 3)
        return list(zip(out["prev_1"].astype(object).where(out["prev_1"].notna(), None), out["stuck"].tolist()))

    nan = float("nan")
    assert feed([(2, 5), (1, 4)], [(3, 5)]) == [(None, False), (4.0, False), (5.0, False)]
    assert state == [5.0, 2]
    assert feed([(4, 5), (5, 5), (6, 1)]) == [(5.0, True), (5.0, True), (5.0, False)]
    assert [stuck for _, stuck in feed([(7, nan), (8, nan), (9, nan), (10, nan)])] == [False] * 4
    assert [stuck for _, stuck in feed([(11, 2), (12, 2), (13, 2)])] == [False, False, True]


@pytest.mark.parametrize("span", [1, 7, 5000])
@pytest.mark.parametrize("held_rows", [1, 64, 100, 1_000_000])
def test_long_series_are_merged_from_blocks(span, held_rows):
    random = np.random.default_rng(span)
    rows = pd.DataFrame({"at": random.integers(0, span, 1000), "event_id": random.permutation(1000), "v": random.random(1000)})
    blocks = Blocks()
    frames = [rows.iloc[i:i + 50] for i in range(0, 1000, 50)]
    pieces = list(series.in_order(frames, blocks, held_rows, 16))
    want = rows.sort_values(["at", "event_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(pd.concat(pieces, ignore_index=True), want)
    assert not blocks and bool(blocks.most) == (held_rows <= 1000)
    if held_rows <= 1000:
        assert max(map(len, pieces)) <= 16 * -(-1000 // max(held_rows, 50))  # one block of each run at most


def test_no_rows_no_pieces():
    assert list(series.in_order([], Blocks())) == []
    assert list(series.in_order([series_rows([])], Blocks())) == []


def stored_alerts(spark, tmp_path, batches, **options):
    """Rapid changes and runs by the keyed state, one file a batch; ``batches`` are lists of (device, hour, value)."""
    folder = str(tmp_path / "readings")
    layout = "event_id long, time timestamp, device_id string, device_type string, sensor_id string, sensor_type string, v double"
    progress = []
    for n, batch in enumerate(batches):
        rows = [(i, T0 + timedelta(hours=h), d, "motor", "s", "power", v) for i, (d, h, v) in enumerate(batch)]
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(folder)
        context = alerting.with_series_state(spark.readStream.schema(layout).parquet(folder), **options)
        progress.append(drain(write_stream(context, str(tmp_path))).recentProgress)
    return spark.read.parquet(f"{tmp_path}/out"), progress


def test_a_series_beyond_the_held_rows_equals_the_batch_rules(spark, tmp_path):
    order = np.random.default_rng(3).permutation(400)
    batches = [[("a", int(h), float(h // 6 % 4)) for h in order if h < 250] + [("b", 1, 2.0)], [("a", int(h), float(h // 6 % 4)) for h in order if h >= 250]]
    found, progress = stored_alerts(spark, tmp_path, batches, held_rows=40, block_rows=8)
    layout = "device_id string, sensor_id string, event_id long, time timestamp, v double"
    whole = spark.createDataFrame([(d, "s", 0, T0 + timedelta(hours=h), v) for b in batches for d, h, v in b], layout)
    want = alerts.with_series_context(whole, hot_rows=None)
    columns = ["device_id", "time", "v", "prev_1", "stuck"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    # what is left of both batches is one row of state per sensor
    assert progress[-1][-1].stateOperators[0].numRowsTotal == 2


@pytest.mark.parametrize(("forget_after", "previous"), [(None, 1.0), (timedelta(milliseconds=1), None), (timedelta(hours=1), 1.0)])
def test_state_of_silent_sensors_leaves_the_store(spark, tmp_path, forget_after, previous):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")  # a drained stream whose state can expire would go on with empty batches
    try:
        found, _ = stored_alerts(spark, tmp_path, [[("a", 0, 1.0)], [("a", 1, 50.0)]], forget_after=forget_after)
    finally:
        spark.conf.unset(name)
    row = found.where("v = 50").first()
    assert (None if row.prev_1 is None or math.isnan(row.prev_1) else row.prev_1) == previous


def test_landing_and_quarantine(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = write_messages(spark, folder, 3)
    paths = {name: str(tmp_path / name) for name in ("table", "bad", "cp", "metrics")}
    records = topics.stream_topic(spark, "text", folder, max_files=1)
    drain(landing.start_landing(records, paths["table"], paths["bad"], paths["cp"], None, paths["metrics"]))
    stored, refused = spark.read.parquet(paths["table"]), spark.read.parquet(paths["bad"])
    assert stored.count() + refused.count() == len(rows)
    assert {r["error_type"] for r in refused.select("error_type").distinct().collect()} == {
        "JSONDecodeError", "KeyError", "ValueError", "TypeError",
    }
    counted = spark.read.parquet(paths["metrics"]).where("metric = 'telemetry_stored_total'").agg(F.sum("value"))
    assert counted.first()[0] == stored.count()


def test_crash_after_the_write_does_not_duplicate(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 3)
    table, bad, cp = (str(tmp_path / name) for name in ("table", "bad", "cp"))
    original, calls = landing.write_batch, []

    def crash_once(df, path, batch_id, partitions=()):
        original(df, path, batch_id, partitions)
        calls.append(path)
        if len(calls) == 3:  # the third batch has stored its rows, and is not done
            raise RuntimeError("executor lost")

    monkeypatch.setattr(landing, "write_batch", crash_once)
    appended = landing.ledger._commit

    def die_before_the_third(rows, path):
        if len(calls) == 2 and not died:
            died.append(path)
            raise RuntimeError("executor lost")  # the rows of the third batch are written, their commit is not
        appended(rows, path)

    died = []
    monkeypatch.setattr(landing.ledger, "_commit", die_before_the_third)
    first = landing.start_landing(topics.stream_topic(spark, "text", folder, max_files=1), table, bad, cp, None)
    with pytest.raises(Exception, match="executor lost"):
        first.awaitTermination(120)
    again = landing.start_landing(topics.stream_topic(spark, "text", folder, max_files=1), table, bad, cp, None)
    with pytest.raises(Exception, match="executor lost"):
        again.awaitTermination(120)
    drain(landing.start_landing(topics.stream_topic(spark, "text", folder, max_files=1), table, bad, cp, None))
    expected = parse_telemetry(topics.replay_topic(spark, "text", folder))
    assert landing.ledger.read(spark, table).count() == good(expected).count()
    # the files of the attempt that died are there and don't count
    assert spark.read.parquet(table).count() > good(expected).count()
    assert spark.read.parquet(bad).count() == expected.where("error_type is not null").count()


def test_two_consumers_of_one_topic_are_independent(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 2)
    records = topics.stream_topic(spark, "text", folder)
    land = landing.start_landing(records, f"{tmp_path}/t", f"{tmp_path}/b", f"{tmp_path}/cp1", None)
    watch = alerting.start_quarantine(records, f"{tmp_path}/q", f"{tmp_path}/cp2", None)
    drain(land), drain(watch)
    assert spark.read.parquet(f"{tmp_path}/q").count() > spark.read.parquet(f"{tmp_path}/b").count() > 0


def test_alerts_are_published_and_stored_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    write_messages(spark, folder, 1)
    topic, table = f"{tmp_path}/topic", f"{tmp_path}/alerts"
    drain(alerting.start_publishing(alert_stream(spark, folder), f"{tmp_path}/cp1", "text", {"path": topic}, None))
    published = topics.stream_topic(spark, "text", topic)
    from pulsegrid.sources.messages import parse_alerts

    rows = parse_alerts(published).where(F.col("error_type").isNull())
    drain(alerting.start_storing(rows.unionByName(rows), table, f"{tmp_path}/cp2", None))
    stored = upsert_latest(tables.read_table(spark, table), ("alert_id", "created_at"), ("batch_id",))
    assert stored.count() == len(batch_alerts(spark, folder))
    assert stored.where("acknowledged").count() == 0


def test_normalised_stream(spark, tmp_path):
    folder, topic = str(tmp_path / "in"), f"{tmp_path}/topic"
    rows = write_messages(spark, folder, 1)
    drain(landing.start_normalizing(topics.stream_topic(spark, "text", folder), f"{tmp_path}/cp", "text", {"path": topic}, None))
    out = [json.loads(r["value"]) for r in topics.replay_topic(spark, "text", topic).collect()]
    assert 0 < len(out) < len(rows) and all(len(r) == 7 for r in out)


START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_windows_close_by_watermark_and_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    layout = "event_id long, time timestamp, device_id string, device_type string, sensor_id string, sensor_type string, v double"

    def add(*minutes):
        rows = [(m, START + timedelta(minutes=m), "d", "hvac", "s", "power", 1.0) for m in minutes]
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(layout).parquet(str(folder))
        drain(kpis.start_tumbling(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "5 minutes", "10 minutes", None))
        rows = spark.read.parquet(f"{tmp_path}/out").where("kpi_name = 'power_energy'")
        return {int((r["t"] - START.timestamp()) / 60): r["kpi_value"]
                for r in rows.select(F.unix_seconds("window_start").alias("t"), "kpi_value").collect()}

    add(0, 1, 6)
    add(30)
    assert run() == {0: 2.0, 5: 1.0}
    add(2, 26, 60)  # minute 2 is behind the watermark, minute 26 is not
    assert run() == {0: 2.0, 5: 1.0, 25: 1.0, 30: 1.0}


def test_repeated_deliveries_within_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(1, START, "d", "s", "1"), (2, START, "d", "s", "2")]
    layout = "event_id long, time timestamp, device_id string, sensor_id string, value string"
    for _ in range(2):
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(str(folder))
    stream = landing.without_repeats(spark.readStream.schema(layout).parquet(str(folder)), "10 minutes")
    drain(write_stream(stream, str(tmp_path)))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_alert_topic_is_stored_and_its_poison_set_aside(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path)
    folder.mkdir()
    one = {"createdAt": "2024-01-05T01:02:03Z", "alertId": "n-1", "deviceId": "d", "deviceType": "mill", "alertType": "stuck_sensor", "severity": "warning", "message": "m"}
    lines = [json.dumps(one), json.dumps({**one, "alertId": "n-2", "threshold": 5, "value": 6.5}), "{broken", json.dumps({**one, "severity": None})]
    (folder / "0.txt").write_text("\n".join(lines) + "\n")
    records = topics.stream_topic(spark, "text", str(folder), max_files=1)
    for _ in range(2):  # the second start finds nothing new
        drain(landing.start_storing_alerts(records, f"{root}/alerts", f"{root}/bad", f"{root}/cp", None, f"{root}/metrics"))
    stored = spark.read.parquet(f"{root}/alerts")
    assert {(r["alert_id"], r["threshold"], r["value"], r["acknowledged"], str(r["dt"])) for r in stored.collect()} == {("n-1", None, None, False, "2024-01-05"), ("n-2", 5.0, 6.5, False, "2024-01-05")}
    refused = spark.read.parquet(f"{root}/bad").collect()
    assert {(r["worker"], r["error_type"]) for r in refused} == {("alert", "JSONDecodeError"), ("alert", "KeyError")} and all(r["arrived_at"] for r in refused)
    errors = spark.read.parquet(f"{root}/metrics").where("metric = 'processing_errors_total'")
    assert errors.agg(F.sum("value")).first()[0] == 2
