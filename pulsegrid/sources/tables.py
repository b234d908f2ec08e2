"""Stored tables on Parquet: time-partitioned appends, versioned batches, range scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "dt"
BATCH = "batch_id"


def with_day(df: DataFrame, time: str = "time") -> DataFrame:
    """Adds the partition column, the UTC date of ``time``."""
    return df.withColumn(DAY, F.to_date(F.col(time)))


def append_rows(df: DataFrame, path: str, time: str = "time", files_per_day: int | None = None) -> None:
    """Append into day partitions. Duplicates are kept.

    Rows that arrive roughly in time order are written where they are. For a backfill that mixes many
    days, ``files_per_day`` first clusters the rows, so that a task does not open a file in every
    partition; a day is spread over that many parts by a hash of the time.
    """
    out = with_day(df, time)
    if files_per_day:
        out = out.repartition(DAY, F.pmod(F.xxhash64(time), F.lit(files_per_day)))
    out.write.mode("append").partitionBy(DAY).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int | str | Column, partitions: Sequence[str] = ()) -> None:
    """Write one batch so that writing it again replaces it: re-runs never duplicate rows.

    A column as ``batch_id`` tells each row's batch; all batches that occur are replaced.
    """
    out = df.withColumn(BATCH, batch_id if isinstance(batch_id, Column) else F.lit(batch_id))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, BATCH)
        .parquet(path)
    )


def file_system(spark: SparkSession, path: str):
    """The file system a path lives on, and its constructor of paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a partition folder on whatever file system it lives; nothing happens if it is gone."""
    fs, at = file_system(spark, path)
    fs.delete(at(path), True)


def read_table(spark: SparkSession, path: str, layout: str | None = None) -> DataFrame:
    reader = spark.read if layout is None else spark.read.schema(layout)
    return reader.parquet(path)


def in_range(
    df: DataFrame, after: datetime | Column | None, until: datetime | Column | None, time: str = "time"
) -> DataFrame:
    """Rows with ``after < time <= until``.

    On a table partitioned by day the same bounds are put on the partition column, so that whole
    partitions are skipped before any file is opened.
    """
    out = df
    for bound, lower in ((after, True), (until, False)):
        if bound is None:
            continue
        at = bound if isinstance(bound, Column) else F.lit(bound)
        out = out.where(F.col(time) > at if lower else F.col(time) <= at)
        if DAY in df.columns:
            out = out.where(F.col(DAY) >= F.to_date(at) if lower else F.col(DAY) <= F.to_date(at))
    return out


def since(df: DataFrame, at: datetime | Column, time: str = "time") -> DataFrame:
    """Rows with ``time >= at``, pruning day partitions alike."""
    bound = at if isinstance(at, Column) else F.lit(at)
    out = df.where(F.col(time) >= bound)
    return out.where(F.col(DAY) >= F.to_date(bound)) if DAY in df.columns else out


def param_query(
    spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, **tables: DataFrame
) -> DataFrame:
    """Run SQL with named parameters (``:name``) over the given tables (``{name}``)."""
    return spark.sql(sql, args=dict(params or {}), **tables)
