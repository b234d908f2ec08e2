"""Session set-up shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Cluster submissions set their own memory, shuffle and parallelism figures; these are the
# semantic settings every job relies on plus the adaptive features worth having on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
    # no call-site capture for every column expression built in Python
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulsegrid")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are instants; every cast in the package assumes a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for job output, under the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset, as in local tests,
    does a temporary folder of this machine stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        base = tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
