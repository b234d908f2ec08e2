"""Device registry as a snapshot table plus change sets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.upsert import upsert_latest

DEFAULT_STATUS = "inactive"
EDITABLE = ("name", "type", "status", "location")


def _status(column: Column) -> Column:
    return F.coalesce(column, F.lit(DEFAULT_STATUS))


def list_devices(devices: DataFrame) -> DataFrame:
    return devices


def get(devices: DataFrame, device_id: str) -> DataFrame:
    """The device with this id, no row if there is none."""
    return devices.where(F.col("id") == device_id)


def get_many(devices: DataFrame, ids: DataFrame) -> DataFrame:
    """Answer to a table of requested ids: the device, or null columns with ``found`` false."""
    rest = [name for name in devices.columns if name != "id"]
    wanted = ids.select("id").distinct()
    return wanted.join(devices.withColumn("_hit", F.lit(True)), "id", "left").select(
        "id", *rest, F.col("_hit").isNotNull().alias("found")
    )


def create(requests: DataFrame, at: datetime | Column | None = None, new_id: Column | None = None) -> DataFrame:
    """New devices from requests (name, type, status, location): fresh id, default status, creation time."""
    when = F.current_timestamp() if at is None else at if isinstance(at, Column) else F.lit(at)
    return requests.select(
        (F.uuid() if new_id is None else new_id).alias("id"),
        "name",
        "type",
        _status(F.col("status")).alias("status"),
        "location",
        when.alias("created_at"),
    )


def update(devices: DataFrame, updates: DataFrame) -> DataFrame:
    """Full replacement of the editable columns; unknown ids change nothing.

    ``updates`` has one row per id. A status that is left out falls back to the default; id and
    creation time stay.
    """
    incoming = updates.select("id", F.struct(*EDITABLE).alias("_new"))
    hit = F.col("_new").isNotNull()
    joined = devices.join(incoming, "id", "left")

    def value(name: str) -> Column:
        new = _status(F.col("_new.status")) if name == "status" else F.col(f"_new.{name}")
        return F.when(hit, new).otherwise(F.col(name)).alias(name)

    return joined.select("id", *[value(name) for name in EDITABLE], "created_at")


def delete(devices: DataFrame, ids: DataFrame) -> DataFrame:
    return devices.join(ids.select("id").distinct(), "id", "left_anti")


def apply_changes(devices: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after a mixed change set.

    ``changes``: id, op (create, update, delete), name, type, status, location, changed_at, change_id;
    ordered by (changed_at, change_id). Ids are never given out twice, so a deleted device is gone
    whatever follows. An update of an id that neither exists nor is created in the set is ignored.
    The changes are reduced to one row per id, with partial aggregation, before they meet the snapshot.
    """
    flags = changes.groupBy("id").agg(
        F.bool_or(F.col("op") == "delete").alias("_gone"), F.min(F.when(F.col("op") == "create", F.col("changed_at"))).alias("_born")
    )
    # the latest write by rank, not by an aggregate: a struct is no buffer that a hash aggregate can hold
    writes = upsert_latest(changes.where(F.col("op") != "delete"), ("id",), ("changed_at", "change_id"))
    per_id = flags.join(writes.select("id", F.struct(*EDITABLE).alias("_new")), "id", "left")
    joined = devices.withColumn("_known", F.lit(True)).join(per_id, "id", "full_outer")
    known, born = F.col("_known").isNotNull(), F.col("_born").isNotNull()
    kept = joined.where(~F.coalesce("_gone", F.lit(False)) & (known | born))
    written = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        new = _status(F.col("_new.status")) if name == "status" else F.col(f"_new.{name}")
        return F.when(written, new).otherwise(F.col(name)).alias(name)

    return kept.select(
        "id", *[value(name) for name in EDITABLE], F.coalesce("created_at", "_born").alias("created_at")
    )
