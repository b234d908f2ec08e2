"""Relational stores over JDBC, where the driver is on the class path of the cluster."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# Rows per insert statement batch, the flush size of the landing path.
BATCH_ROWS = 1000


def options(url: str, table: str, user: str, password: str, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password, **(extra or {})}


def time_slices(column: str, start: datetime, end: datetime, slices: int) -> dict[str, str]:
    """Read a time range by that many parallel connections, each fetching its own slice."""
    return {
        "partitionColumn": column,
        "lowerBound": start.strftime("%Y-%m-%d %H:%M:%S"),
        "upperBound": end.strftime("%Y-%m-%d %H:%M:%S"),
        "numPartitions": str(slices),
    }


def read(spark: SparkSession, opts: Mapping[str, str], fmt: str = "jdbc") -> DataFrame:
    """Filters and column selection are pushed into the database."""
    return spark.read.format(fmt).options(**opts).load()


def append(df: DataFrame, opts: Mapping[str, str], fmt: str = "jdbc", batch_rows: int = BATCH_ROWS) -> None:
    """Plain inserts; use inside ``foreachBatch`` for a stream."""
    df.write.format(fmt).mode("append").options(**opts).option("batchsize", str(batch_rows)).save()
