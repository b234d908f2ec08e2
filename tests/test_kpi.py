"""KPI arithmetic, windows, and the incremental job."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.operators import kpi
from pulsegrid.plans import jobs
from pulsegrid.schemas import TELEMETRY_TABLE
from pulsegrid.sources import ledger

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def readings(spark, values, sensor_type, sensor_id="s1", device_id="d1"):
    rows = [
        (i, START + timedelta(minutes=i), device_id, "hvac", sensor_id, sensor_type, float(v))
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "event_id long, time timestamp, device_id string, device_type string, sensor_id string, sensor_type string, v double"
    )


def figures(spark, values, sensor_type):
    rows = kpi.kpis_long(readings(spark, values, sensor_type)).collect()
    return {r["kpi_name"].removeprefix(sensor_type + "_"): r["kpi_value"] for r in rows}


# The number series of the next tests have results that must agree.
def test_basic_figures(spark):
    out = figures(spark, [10, 20, 30, 40, 50], "temperature")
    assert (out["avg"], out["min"], out["max"], out["count"], out["range"]) == (30, 10, 50, 5, 40)


def test_empty_input_has_no_rows(spark):
    assert figures(spark, [], "temperature") == {}


def test_single_value(spark):
    assert figures(spark, [42], "humidity") == {"avg": 42, "min": 42, "max": 42, "count": 1}


def test_sample_standard_deviation(spark):
    assert figures(spark, [2, 4, 4, 4, 5, 5, 7, 9], "humidity")["std_dev"] == pytest.approx(2.13809, abs=1e-5)


def test_vibration_figures(spark):
    out = figures(spark, [1, 2, 3, 4, 5], "vibration")
    assert out["rms"] == pytest.approx(3.31662, abs=1e-5)
    assert out["crest_factor"] == pytest.approx(5 / 3.31662, abs=1e-5)
    assert "crest_factor" not in figures(spark, [0, 0], "vibration")


def test_rate_of_change_is_last_minus_first(spark):
    assert figures(spark, [20, 22, 25, 28, 35], "temperature")["rate_of_change"] == 15
    assert "rate_of_change" not in figures(spark, [20], "temperature")
    assert "rate_of_change" not in figures(spark, [20, 30], "humidity")


def test_rate_of_change_breaks_time_ties_by_event_id(spark):
    rows = [(i, START, "d", "hvac", "s", "temperature", float(v)) for i, v in ((3, 30), (1, 10), (2, 20))]
    df = spark.createDataFrame(
        rows, "event_id long, time timestamp, device_id string, device_type string, sensor_id string, sensor_type string, v double"
    )
    assert kpi.kpi(df, "rate_of_change").first()["kpi_value"] == 20


def test_energy_is_a_plain_sum(spark):
    assert figures(spark, [100, 150, 200], "power")["energy"] == 450


def test_sensors_of_one_type_collapse_under_the_upsert_key(spark):
    df = readings(spark, [1, 2], "temperature", "t-0").unionByName(readings(spark, [8, 9], "temperature", "t-1"))
    rows = kpi.kpi_rows(df, START, START, START)
    assert {r["sensor_id"] for r in rows.collect()} == {"t-0", "t-1"}
    collapsed = {r["kpi_name"]: r["kpi_value"] for r in kpi.collapse_sensors(rows).collect()}
    assert collapsed["temperature_avg"] == 8.5 and collapsed["temperature_count"] == 2


def test_tumbling_windows(spark):
    out = kpi.kpis_tumbling(readings(spark, range(10), "power"), "5 minutes")
    sums = {r["window_start"].minute: r["kpi_value"] for r in out.where("kpi_name = 'power_energy'").collect()}
    assert sums == {0: 10.0, 5: 35.0}


def test_aggregation_is_one_hash_aggregate_with_one_shuffle(spark, plan):
    text = plan(kpi.kpis_long(readings(spark, [1], "power")))
    assert "SortAggregate" not in text and "Python" not in text
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2


# --- incremental job ---


def telemetry(spark, rows):
    full = [(i, t, "d1", "hvac", "s1", "temperature", "celsius", value) for i, t, value in rows]
    return spark.createDataFrame(full, TELEMETRY_TABLE)


@pytest.fixture()
def control(spark, tmp_path):
    path = str(tmp_path / "control")
    jobs.seed_control(spark, path)
    return path


def at(hours):
    return START + timedelta(hours=hours)


def test_job_runs_incrementally(spark, tmp_path, control):
    out = str(tmp_path / "kpis")
    first = telemetry(spark, [(1, at(1), '{"value": 10}'), (2, at(2), '{"value": 20}')])
    run = jobs.run_kpi_job(spark, first, out, control, as_of=at(3))
    assert run.window_start == jobs.EPOCH and run.window_end == at(2)
    assert jobs.get_watermark(spark, control, "kpi_5min") == at(2)

    both = first.unionByName(telemetry(spark, [(3, at(4), '{"value": 70}'), (4, at(9), '{"value": 1}')]))
    run = jobs.run_kpi_job(spark, both, out, control, as_of=at(5))  # the row of hour 9 is in the future
    assert (run.window_start, run.window_end) == (at(2), at(4))
    rows = {
        (r["window_start"], r["kpi_value"])
        for r in jobs.read_kpis(spark, out).where("kpi_name = 'temperature_avg'")
        .withColumn("window_start", F.unix_seconds("window_start")).collect()
    }
    assert rows == {(0, 15.0), (int(at(2).timestamp()), 70.0)}


def test_empty_range_leaves_the_watermark(spark, tmp_path, control):
    df = telemetry(spark, [(1, at(1), '{"value": 10}')])
    jobs.run_kpi_job(spark, df, str(tmp_path / "k"), control, as_of=at(2))
    run = jobs.run_kpi_job(spark, df, str(tmp_path / "k"), control, as_of=at(3))
    assert not run.advanced
    assert jobs.get_watermark(spark, control, "kpi_5min") == at(1)


def test_null_reading_still_moves_the_watermark(spark, tmp_path, control):
    df = telemetry(spark, [(1, at(1), '{"value": 10}'), (2, at(2), '{"other": 1}')])
    run = jobs.run_kpi_job(spark, df, str(tmp_path / "k"), control, as_of=at(3))
    assert run.window_end == at(2)
    rows = jobs.read_kpis(spark, str(tmp_path / "k")).where("kpi_name = 'temperature_count'").collect()
    assert [r["kpi_value"] for r in rows] == [1.0]


def test_rerun_after_a_crash_before_the_watermark_replaces_the_batch(spark, tmp_path, control, monkeypatch):
    out = str(tmp_path / "k")
    df = telemetry(spark, [(1, at(1), '{"value": 10}'), (2, at(2), '{"value": 20}')])
    with monkeypatch.context() as patch:
        def crash(*_):
            raise RuntimeError("lost")

        patch.setattr(jobs, "advance_watermark", crash)
        with pytest.raises(RuntimeError):
            jobs.run_kpi_job(spark, df, out, control, as_of=at(3))
    jobs.run_kpi_job(spark, df, out, control, as_of=at(4))
    assert jobs.read_kpis(spark, out).where("kpi_name = 'temperature_avg'").count() == 1


def test_unknown_job_starts_at_epoch_and_gets_a_row(spark, control):
    assert jobs.get_watermark(spark, control, "other") == jobs.EPOCH
    jobs.advance_watermark(spark, control, "other", at(1), at(1))
    assert jobs.get_watermark(spark, control, "other") == at(1)


def test_late_rows_count_once_in_the_window_of_their_time(spark, control, tmp_path):
    out, one = str(tmp_path / "kpis"), '{"value": 10}'
    first = [(1, at(1), one), (2, at(2), one), (3, at(3), one)]
    jobs.run_kpi_job(spark, telemetry(spark, first), out, control, as_of=at(3), lateness=timedelta(hours=2))
    late = [*first, (4, at(2) + timedelta(minutes=5), one), (5, at(5), one)]
    run = jobs.run_kpi_job(spark, telemetry(spark, late), out, control, as_of=at(5), lateness=timedelta(hours=2), metrics_path=str(tmp_path / "metrics"))
    assert (run.window_start, run.window_end) == (at(3), at(5))
    rows = jobs.read_kpis(spark, out).where("kpi_name = 'temperature_count'").orderBy("window_start").collect()
    assert [r["kpi_value"] for r in rows] == [4, 1]
    windows = jobs.read_kpis(spark, out).select(F.unix_seconds("window_start").alias("a"), F.unix_seconds("window_end").alias("b")).distinct().collect()
    assert {(r["a"], r["b"]) for r in windows} == {(0, int(at(3).timestamp())), (int(at(3).timestamp()), int(at(5).timestamp()))}
    counters = spark.read.parquet(str(tmp_path / "metrics" / "counters")).where("metric = 'kpis_computed_total'")
    assert counters.agg(F.sum("value")).first()[0] == jobs.read_kpis(spark, out).where(F.col("window_start") == F.lit(at(3))).count()
    assert spark.read.parquet(str(tmp_path / "metrics" / "runs")).first()["job_name"] == "kpi_5min"


def test_a_third_run_leaves_windows_outside_the_lateness_alone(spark, control, tmp_path):
    out, one = str(tmp_path / "kpis"), '{"value": 10}'
    rows = [(i, at(i), one) for i in (1, 2, 3)]
    for k in (1, 2):
        jobs.run_kpi_job(spark, telemetry(spark, rows[:k]), out, control, as_of=at(k))
    jobs.run_kpi_job(spark, telemetry(spark, [*rows, (9, at(1) - timedelta(minutes=5), one)]), out, control, as_of=at(3), lateness=timedelta(minutes=30))
    found = jobs.read_kpis(spark, out).where("kpi_name = 'temperature_count'").orderBy("window_start").collect()
    assert [r["kpi_value"] for r in found] == [1, 1, 1]


def figures_of(rows):
    return {(r.sensor_id, r.kpi_name): (r.kpi_value, r.sample_count) for r in rows.collect()}


def test_merged_partials_equal_one_aggregate(spark):
    """Whatever the parts; large values that lie close together keep their digits."""
    rows = spark.range(4000).selectExpr(
        "'d' AS device_id", "'m' AS device_type", "concat('s', id % 3) AS sensor_id", "element_at(array('temperature', 'vibration', 'power'), cast(id % 3 AS int) + 1) AS sensor_type",
        "timestamp_seconds(1704067200 + (id * 7919) % 4000) AS time", "id AS event_id", "1e9 + (id * 31 % 101) / 10 AS v", "id % 7 AS part",
    )
    want = figures_of(kpi.kpis_long(rows))
    parts = kpi.partials(rows, ("part", *schemas.KPI_KEYS))
    got = figures_of(kpi.to_long(kpi.figures(kpi.merged_partials(parts))))
    assert set(got) == set(want)
    for key, (value, n) in want.items():
        assert got[key][1] == n and got[key][0] == pytest.approx(value, rel=1e-7), key


@pytest.fixture()
def merging(spark, tmp_path):
    """Runs of the job over rows (hour, value, hour of arrival)."""
    paths = [str(tmp_path / name) for name in ("kpis", "state", "control")]
    jobs.seed_control(spark, paths[2])
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def run(rows, hour):
        layout = "device_id string, device_type string, sensor_id string, sensor_type string, time timestamp, event_id long, value string, arrived_at timestamp"
        at = lambda h: start + timedelta(hours=h)
        made = [("d", "m", "s", "power", at(t), i, f'{{"value": {v}}}', at(a)) for i, (t, v, a) in enumerate(rows)]
        return jobs.run_merging_job(spark, spark.createDataFrame(made, layout), *paths, at(hour))

    def energy():
        found = jobs.read_kpis(spark, paths[0]).where("kpi_name = 'power_energy'").collect()
        return {(r.window_end - start).total_seconds() / 3600 if r.window_end.tzinfo else (r.window_end - start.replace(tzinfo=None)).total_seconds() / 3600: (r.kpi_value, r.sample_count) for r in found}

    run.energy, run.paths = energy, paths
    return run


def test_late_rows_join_their_window_without_a_newer_row(merging):
    rows = [(1, 1.0, 1), (2, 2.0, 2)]
    assert merging(rows, 3).advanced
    rows += [(4, 4.0, 4), (5, 5.0, 5)]
    merging(rows, 6)
    assert merging.energy() == {2: (3.0, 2), 5: (9.0, 2)}
    # one late row for each window, nothing new
    rows += [(1.5, 10.0, 7), (3, 100.0, 7)]
    assert not merging(rows, 8).advanced
    assert merging.energy() == {2: (13.0, 3), 5: (109.0, 3)}
    # nothing arrived: nothing changes
    merging(rows, 9)
    assert merging.energy() == {2: (13.0, 3), 5: (109.0, 3)}
    # a row that is ahead of its time waits, whenever it arrived
    rows += [(20, 7.0, 9.5)]
    merging(rows, 10)
    assert merging.energy() == {2: (13.0, 3), 5: (109.0, 3)}
    merging(rows, 21)
    assert merging.energy() == {2: (13.0, 3), 5: (109.0, 3), 20: (7.0, 1)}


@pytest.mark.parametrize("dies_at", ["write_batch", "advance_watermark"])
def test_a_merging_run_that_dies_counts_once(spark, merging, monkeypatch, dies_at):
    merging([(1, 1.0, 1)], 2)
    rows = [(1, 1.0, 1), (0.5, 5.0, 3), (3, 3.0, 3)]
    real, calls = getattr(jobs, dies_at), []

    def dying(*args, **kwargs):
        calls.append(args)
        # the last call of a run marks it as done
        if dies_at == "write_batch" or len(calls) == 3:
            raise RuntimeError("driver lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(jobs, dies_at, dying)
    with pytest.raises(RuntimeError):
        merging(rows, 4)
    monkeypatch.setattr(jobs, dies_at, real)
    # the next run, later, first finishes that one; what came since is the turn of the run after it
    rows += [(4.5, 40.0, 4.5)]
    merging(rows, 5)
    assert merging.energy() == {1: (6.0, 2), 3: (3.0, 1)}
    merging(rows, 5)
    assert merging.energy() == {1: (6.0, 2), 3: (3.0, 1), 4.5: (40.0, 1)}


def test_only_what_arrived_is_read(spark, merging, tmp_path):
    """The rows a run scans, by the filter that reaches the file."""
    merging([(1, 1.0, 1)], 2)
    assert ledger.read(spark, merging.paths[1], jobs.STATE).count() == 1
    merging([(1, 1.0, 1), (3, 1.0, 3)], 4)
    state = ledger.read(spark, merging.paths[1], jobs.STATE)
    assert sorted(r.n for r in state.collect()) == [1, 1]
