"""Partitioned tables whose content is what their ledger says.

Rows lie in the folders of a slot (a day, or a bucket of keys), in the files of the jobs that wrote them, and each row names
its write (``part``). The ledger lies beside them in a folder that table scans skip. A write counts from the moment the ledger
names it. All that a job commits is one file of ledger rows, which appears whole or not at all, so a reader sees all of an
append, or of a rewrite with what it replaces, or nothing of it. Files of a job that died are never named and wait to be
tidied away. Slots that a rewrite does not touch stay where they are.

The ledger is a set of facts (a part counts; a part no longer counts in a slot), so files of it can be read in any order and
more than once. Facts about a part are few: one when it lands, one per slot when it is replaced there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import work_dir
from pulsegrid.sources.tables import BATCH, DAY, file_system

PART = "part"
FACTS = f"{PART} STRING, writer STRING, batch BIGINT, slot STRING, live BOOLEAN, at TIMESTAMP"
COMPACTION = "compaction"


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_ledger/commits"


def has_ledger(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at(_folder(path)))


def facts(spark: SparkSession, path: str) -> DataFrame:
    if not has_ledger(spark, path):
        return spark.createDataFrame([], FACTS)
    return spark.read.schema(FACTS).parquet(_folder(path))


def _commit(rows: DataFrame, path: str) -> None:
    """One file, which a single rename (or upload) makes visible."""
    rows.coalesce(1).write.mode("append").parquet(_folder(path))


def last_batch(spark: SparkSession, path: str, writer: str) -> int:
    """The highest batch of a writer that is committed; -1 if there is none. A writer's batches are committed in order."""
    found = facts(spark, path).where((F.col("writer") == writer) & F.col("live")).agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def _write(rows: DataFrame, path: str, part: str, slot: str, **options: str) -> None:
    rows.withColumn(PART, F.lit(part)).write.mode("append").options(**options).partitionBy(slot).parquet(path)


def append(df: DataFrame, path: str, writer: str, batch: int, slot: str = DAY) -> None:
    """Append rows (with their slot) and commit them. Not to be called for a batch up to ``last_batch``."""
    part = f"{writer}-{batch}-{uuid.uuid4().hex}"
    _write(df.withColumn(BATCH, F.lit(batch)), path, part, slot)
    _commit(df.sparkSession.createDataFrame([(part, writer, batch, None, True, datetime.now(timezone.utc))], FACTS), path)


def _visible(rows: DataFrame, known: DataFrame, slot: str) -> DataFrame:
    """The rows whose part counts in their slot. Both sides of the ledger are small beside the rows; Spark picks the join."""
    counted = known.where("live").select(PART).distinct()
    gone = known.where("not live").select(F.col(PART).alias("part_"), F.col("slot").alias("slot_")).distinct()
    here = (F.col(PART) == F.col("part_")) & (F.col(slot).cast("string") == F.col("slot_"))
    return rows.join(counted, PART, "left_semi").join(gone, here, "left_anti")


def read(spark: SparkSession, path: str, layout: str | None = None, slot: str = DAY) -> DataFrame:
    """The rows that the ledger counts; a table without ledger is read as it is.

    ``layout`` names the columns without ``part``; it is needed where the table may still be empty.
    """
    if not has_ledger(spark, path):
        return spark.createDataFrame([], layout) if layout else spark.read.parquet(path)
    reader = spark.read if layout is None else spark.read.schema(f"{layout}, {PART} STRING")
    return _visible(reader.parquet(path), facts(spark, path), slot).drop(PART)


def replace(
    rows: DataFrame, path: str, slots: Sequence[str | int | date], writer: str, batch: int | None = None, slot: str = DAY,
    settled: DataFrame | None = None, compression: str = "zstd",
) -> None:
    """Put ``rows`` in the place of what some slots hold, and commit both at once. Rows of other slots are not to be given.

    ``settled`` has the (part, slot) pairs that the rows were made of; without it, it is what counts when this is called. The
    slots are few: they are listed in the filter. Of two runs over one slot the second to commit gives up.
    """
    spark = rows.sparkSession
    if settled is None:
        settled = settle(spark, path, slots, slot)
    part = f"{writer}-{batch}-{uuid.uuid4().hex}"
    _write(rows, path, part, slot, compression=compression)
    known = facts(spark, path).where("not live").select(F.col(PART).alias("part_"), F.col("slot").alias("slot_"))
    old = settled.select(PART, F.col(slot).cast("string").alias("slot"))
    if not old.join(known, (F.col(PART) == F.col("part_")) & (F.col("slot") == F.col("slot_")), "left_semi").isEmpty():
        raise RuntimeError("another job has replaced some of these slots")
    now = datetime.now(timezone.utc)
    new = spark.createDataFrame([(part, writer, batch, None, True, now)], FACTS)
    none = F.lit(None).cast("bigint")
    _commit(new.unionByName(old.select(PART, F.lit(writer).alias("writer"), none.alias("batch"), "slot", F.lit(False).alias("live"), F.lit(now).alias("at"))), path)
    spark.catalog.refreshByPath(path)


def settle(spark: SparkSession, path: str, slots: Sequence[str | int | date], slot: str = DAY) -> DataFrame:
    """The (part, slot) pairs that count in some slots, stored, so that they stay what they are while others write."""
    if not has_ledger(spark, path):
        return spark.createDataFrame([], f"{PART} STRING, {slot} STRING")
    folder = work_dir(spark, "settled")
    pairs = spark.read.parquet(path).where(F.col(slot).isin(list(slots))).select(PART, slot).distinct()
    _visible(pairs, facts(spark, path), slot).write.parquet(folder)
    return spark.read.schema(pairs.schema).parquet(folder)


def settled_rows(spark: SparkSession, path: str, slots: Sequence[str | int | date], settled: DataFrame, slot: str = DAY) -> DataFrame:
    """The rows of those pairs. Only the folders of the slots are listed."""
    rows = spark.read.parquet(path).where(F.col(slot).isin(list(slots)))
    return rows.join(settled, [PART, slot], "left_semi").drop(PART)


def rewrite_days(spark: SparkSession, path: str, days: Sequence[str], order: Sequence[str], batch: int) -> bool:
    """Replace the parts of some days by one part, range-partitioned and sorted by (day, ``order``); rows get the batch.

    What is replaced is settled first, so what lands meanwhile stays as it is. Until the commit nothing is different
    for readers, and a run that dies leaves nothing but files that no reader sees. Returns whether there was anything to do.
    """
    wanted = [date.fromisoformat(day) for day in days]
    settled = settle(spark, path, wanted)
    if settled.isEmpty():
        return False
    whole = settled_rows(spark, path, wanted, settled).withColumn(BATCH, F.lit(batch))
    # range partitioning includes the last of the order, so a device that dominates a day is spread over several files
    ordered = whole.repartitionByRange(DAY, *order).sortWithinPartitions(DAY, *order)
    replace(ordered, path, wanted, COMPACTION, settled=settled)
    return True


def tidy(spark: SparkSession, path: str, keep: timedelta = timedelta(days=1), now: datetime | None = None, slot: str = DAY) -> tuple[int, int]:
    """Delete files that no reader needs and join the ledger's files into one; returns how many (files, ledger files) went.

    A file goes when its part stopped counting in its slot ``keep`` ago, or was never committed in that time. Facts about a part
    without files go in two calls: first that it counts, later that it does not, so no leftover of a call that died can bring it
    back. The list of files is streamed to the driver partition by partition.
    """
    limit = (now or datetime.now(timezone.utc)) - keep
    fs, at = file_system(spark, path)
    known = facts(spark, path)
    old_files = known.inputFiles()
    known = spark.read.schema(FACTS).parquet(*old_files)
    files = spark.read.parquet(path).select(PART, slot, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written")).distinct()
    listed = work_dir(spark, "tidy")
    files.write.parquet(listed)
    files = spark.read.parquet(listed)
    kept = _visible(files, known.where(F.col("live") | (F.col("at") < F.lit(limit))), slot)
    unknown = files.join(known.where("live").select(PART), PART, "left_anti").where(F.col("written") >= F.lit(limit))
    needed = kept.select("file").unionByName(unknown.select("file"))
    dropped = 0
    for row in files.join(needed, "file", "left_anti").select("file").distinct().toLocalIterator():
        dropped += bool(fs.delete(at(row.file), False))
    present = files.join(needed, "file", "left_semi").select(PART).distinct()
    marks = known.where("live and batch is not null").groupBy("writer").agg(F.max("batch").alias("batch"), F.max("at").alias("at"))
    live = known.where("live").join(present, PART, "left_semi").distinct()
    gone = known.where("not live").join(known.where("live").select(PART).distinct(), PART, "left_semi").distinct()
    # a writer's place is kept by a fact about a part without rows
    places = marks.select(F.concat(F.lit("place-"), "writer").alias(PART), "writer", "batch", F.lit(None).cast("string").alias("slot"), F.lit(True).alias("live"), "at")
    _commit(live.unionByName(gone).unionByName(places), path)
    for file in old_files:
        fs.delete(at(file), False)
    spark.catalog.refreshByPath(path)
    return dropped, len(old_files)
