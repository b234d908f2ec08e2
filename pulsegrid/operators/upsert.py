"""Keyed tables without in-place updates: versions are appended, the latest one per key is the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.sources import ledger
from pulsegrid.sources.tables import BATCH

BUCKET = "bucket"
# buckets of a keyed table: a batch rewrites only those its keys fall into. Choose it for the table's size, some 256 MB a bucket
BUCKETS = 64


def upsert_latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The last version of every key.

    Spark evaluates ``row_number() = 1`` with a group limit before the shuffle: a task sends at most
    one row per key on, so a key with very many versions does not pile up in one task.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(name) for name in version])
    return rows.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") == 1).drop("_rank")


def merge_upsert(
    current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """``current`` (one row per key) after the upsert of ``incoming``: last write wins.

    ``keep`` names columns that an update leaves alone: the stored value stays, and only a new key
    takes the one that comes in. The join uses the partitioning by key that picking the latest
    version has left, so the incoming rows are shuffled once.
    """
    names = [name for name in current.columns if name not in keys]
    old = current.select(*keys, F.struct(*names).alias("_old"))
    new = upsert_latest(incoming, keys, version).select(*keys, F.struct(*names).alias("_new"))

    def merged(name: str):
        first, second = ("_old", "_new") if name in keep else ("_new", "_old")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{name}")).otherwise(F.col(f"{second}.{name}")).alias(name)

    joined = old.join(new, list(keys), "full_outer")
    return joined.select(*[F.col(name) if name in keys else merged(name) for name in current.columns])


def deduplicate(telemetry: DataFrame, keys: Sequence[str] = ("device_id", "sensor_id", "time", "value")) -> DataFrame:
    """One row per reading, whatever the number of deliveries.

    A repeat is the same reading again, wherever it stands in the topic: position and id are no part of the key.

    ``dropDuplicates`` also keeps one row per key and task only before it shuffles.
    """
    return telemetry.dropDuplicates(list(keys))


def with_bucket(rows: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds the bucket of the keys' hash."""
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def merge_into(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], version: Sequence[str], writer: str, batch: int,
    keep: Sequence[str] = (), buckets: int = BUCKETS,
) -> list[int]:
    """Upsert a batch into the keyed table at ``path``; returns the buckets it has rewritten, at most ``buckets``.

    Buckets without an incoming key stay as they are, files and all. The rewritten buckets replace their former ones with one
    commit, and a batch that is committed already changes nothing, so it can be run again after a crash. The number of buckets
    belongs to the table and must not change.
    """
    if batch <= ledger.last_batch(spark, path, writer):
        return []
    new = with_bucket(incoming, keys, buckets).persist()
    try:
        touched = sorted(row[BUCKET] for row in new.select(BUCKET).distinct().collect())
        settled = ledger.settle(spark, path, touched, BUCKET)
        if ledger.has_ledger(spark, path):
            current = ledger.settled_rows(spark, path, touched, settled, BUCKET).drop(BATCH)
        else:
            current = new.limit(0)
        # the bucket follows from the keys, so it is merged like any other column
        merged = merge_upsert(current, new, keys, version, keep)
        # one task per bucket writes its file
        ledger.replace(merged.repartition(BUCKET), path, touched, writer, batch, BUCKET, settled)
    finally:
        new.unpersist()
    return touched


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The keyed table, one row per key."""
    return ledger.read(spark, path, slot=BUCKET).drop(BUCKET, BATCH)
