"""What the corpus operators share: reading, bounded Arrow batches, stored intermediate tables."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import work_dir

# rows and bytes of one Arrow batch; texts can be long, so Spark's default of 10,000 rows is too many
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def ship_package(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, once per context, where they would not find it themselves.

    They find it on PYTHONPATH, in the folder the driver was started in, or among the installed packages.
    """
    root = str(Path(__file__).resolve().parents[2])
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()]
    context = spark.sparkContext
    if root in {os.path.realpath(p) for p in places if p} or getattr(context, "_pulsegrid_shipped", False):
        return
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="pulsegrid-"), "pulsegrid-package"), "zip", root, "pulsegrid"))
    context._pulsegrid_shipped = True


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it is larger; a batch is held whole by JVM and Python.

    Every operator that runs Python on the executors calls this first.
    """
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  a Spark without this setting bounds the rows alone
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: a cut in the lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
