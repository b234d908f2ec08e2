"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice and the second run counts: the session is long-lived in use, and the first
run mostly measures code generation. ``rows_per_second`` relates the main paths to their input rows.

``scale`` times the main paths once more over events repeated twenty times in sixteen files, a third of the rows from
one sensor. Its input is written first, so neither reading one small file nor building the JSON is in those figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from pulsegrid import datasets  # noqa: E402
from pulsegrid.operators import alerts, kpi  # noqa: E402
from pulsegrid.plans.queries import REGISTRY  # noqa: E402
from pulsegrid.session import local_session, work_dir  # noqa: E402
from pulsegrid.sources import messages  # noqa: E402

HEADLINES = (
    "telemetry_scan", "ingest_normalize", "reading_value", "alerts_threshold", "alerts_all", "kpis_long", "kpis_incremental",
    "kpis_upserted", "kpis_tumbling_5min", "upsert_latest", "rate_telemetry_1m", "recent_by_device", "throughput_delta",
    "logs_enriched", "devices_apply_changes", "stream_landing", "stream_alerts_all",
    "stream_alerts_by_batch",
)
PER_EVENT = {
    "landing_stream": "stream_landing", "alerting_stream": "stream_alerts_all", "alerting_micro_batch": "stream_alerts_by_batch",
    "alerting_batch": "alerts_all",
    "parsing": "telemetry_scan", "kpis": "kpis_long",
}


COPIES, FILES = 20, 16


def scale(spark, sf_dir: str) -> dict:
    """Seconds and rows per second of decoding, KPIs and alerts over repeated, skewed events in several files."""
    root = work_dir(spark, "bench")
    events = datasets.events(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    hot = F.col("copy") % 3 == 0
    rows = (
        events.withColumn("user_id", F.when(hot, 1).otherwise(F.col("user_id") * COPIES + F.col("copy")))
        .withColumn("event_type", F.when(hot, F.lit("view")).otherwise(F.col("event_type")))
        .withColumn("time", F.col("time") + F.make_dt_interval(secs=F.col("copy")))
        .withColumn("event_id", F.col("event_id") * COPIES + F.col("copy"))
        .drop("copy")
    )
    datasets.as_telemetry(rows).repartition(FILES).write.parquet(f"{root}/telemetry")
    datasets.as_messages(rows).repartition(FILES).write.parquet(f"{root}/messages")
    telemetry, records = (spark.read.parquet(f"{root}/{name}") for name in ("telemetry", "messages"))
    paths = {
        "parsing": lambda: messages.good(messages.parse_telemetry(records)),
        "kpis": lambda: kpi.kpis_long(messages.with_reading(telemetry)),
        "alerting_batch": lambda: alerts.detect(messages.with_reading(telemetry), datasets.thresholds(spark), F.col("time"), sizes=telemetry),
    }
    n, seconds = telemetry.count(), {}
    for name, path in paths.items():
        started = time.perf_counter()
        path().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    return {"rows": n, "seconds": seconds, "rows_per_second": {name: round(n / s) for name, s in seconds.items()}}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "8g")
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            started = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "rows_per_second": {name: round(events / seconds[query]) for name, query in PER_EVENT.items()},
                "scale": scale(spark, sf_dir),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
