"""Service logs: tagged text lines in, labelled log records out."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.text import log_level, log_service
from pulsegrid.schemas import LOG_RECORD
from pulsegrid.sources.messages import decode
from pulsegrid.sources.tables import since

LABELS = ("app", "pod", "namespace", "level", "service")
SELECT_WINDOW = timedelta(hours=1)
MAX_AGE = timedelta(hours=168)


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of ``<root>/<app>/<pod>/*`` files with the two tags taken from the path."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").option("recursiveFileLookup", "true").load(path)
    return lines.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("app"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("pod"),
        F.col("value").alias("line"),
    )


def scan(lines: DataFrame) -> DataFrame:
    """Tagged lines without the empty ones."""
    return lines.where(F.length("line") > 0)


def enrich(lines: DataFrame, namespace: str | Column, strict_compat: bool = False) -> DataFrame:
    """Labels every line with app, pod, namespace, level and service."""
    at = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return (
        scan(lines)
        .withColumn("namespace", at)
        .withColumn("level", log_level(F.col("line"), strict_compat))
        .withColumn("service", log_service(F.col("line"), F.col("app"), strict_compat))
    )


def to_stream_rows(enriched: DataFrame, time: str = "ts") -> DataFrame:
    """Rows as stored: the five labels, a nanosecond timestamp and the line without carriage returns."""
    return enriched.select(
        *LABELS,
        (F.unix_micros(F.col(time)) * F.lit(1000)).alias("ts_ns"),
        F.replace(F.col("line"), F.lit("\r"), F.lit("")).alias("line"),
    )


def write_logs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("namespace", "app").parquet(path)


SEGMENT_ORDER = ("namespace", "app", "service", "level")


def write_segments(rows: DataFrame, path: str, time: str = "ts", rows_per_group: int = 1 << 20) -> None:
    """Append lines sorted by label and time, with Bloom filters on service and level.

    A read by label opens the folders of its namespace and app, skips row groups by the bounds of service, level and time
    and, where the bounds do not tell, by the filters. Range partitioning includes the time, so a service that logs most of
    the lines is spread over several files.
    """
    order = (*SEGMENT_ORDER, time)
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#service", "true")
        .option("parquet.bloom.filter.enabled#level", "true")
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .partitionBy("namespace", "app")
        .parquet(path)
    )


def select_logs(
    logs: DataFrame,
    as_of: datetime | Column,
    window: timedelta = SELECT_WINDOW,
    time: str = "ts",
    **labels: str,
) -> DataFrame:
    """Lines whose labels equal the given ones, of the ``window`` that ends at ``as_of``."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    out = since(logs, at - F.lit(window), time).where(F.col(time) <= at)
    for name, wanted in labels.items():
        out = out.where(F.col(name) == wanted)
    return out


def reject_late(logs: DataFrame, as_of: datetime | Column, max_age: timedelta = MAX_AGE, time: str = "ts") -> DataFrame:
    """Drops lines older than ``max_age`` at ``as_of``."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return since(logs, at - F.lit(max_age), time)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Every line with the columns of a structured (JSON) record, and in ``error_type`` why it is none.

    ``PlainText`` is a line that does not begin as a JSON object, ``JSONDecodeError`` one that does and cannot
    be read. The level and the service are also found in records of the shell form, which has no logger. Nested entries
    of ``extra`` are kept as JSON text; an ``extra`` that is no object is null and does not refuse the record.
    """
    msg, line = F.col("msg"), F.trim(F.col("line"))
    rest = [name for name in lines.columns if name not in ("line", "level", "service")]
    error = F.when(~F.coalesce(line.startswith("{"), F.lit(False)), "PlainText").when(msg.isNull() | msg["_corrupt"].isNotNull(), "JSONDecodeError")
    return decode(lines, LOG_RECORD, "line").select(
        *rest,
        F.try_to_timestamp(msg["timestamp"]).alias("logged_at"),
        *[msg[name].alias(name) for name in ("level", "service", "logger", "message")],
        F.from_json(msg["extra"], "map<string,string>").alias("extra"),
        msg["exception"].alias("exception"),
        error.alias("error_type"),
        F.col("line").alias("raw"),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """The structured lines as columns; :func:`refused_lines` has all the others."""
    return parse_lines(lines).where(F.col("error_type").isNull()).drop("error_type", "raw")


def refused_lines(lines: DataFrame) -> DataFrame:
    """The lines that are no structured record: their tags, the reason and the whole line."""
    rest = [name for name in lines.columns if name not in ("line", "level", "service")]
    return parse_lines(lines).where(F.col("error_type").isNotNull()).select(*rest, "error_type", "raw")
