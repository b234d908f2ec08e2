"""Consumer progress of running queries as an offsets table."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

OFFSETS = "group_id STRING, topic STRING, partition INT, end_offset BIGINT, committed_offset BIGINT"


def _by_partition(text: object) -> dict[tuple[str, int], int]:
    offsets = json.loads(text) if isinstance(text, str) else text or {}
    return {(topic, int(part)): int(at) for topic, parts in offsets.items() for part, at in parts.items()}


def offsets(spark: SparkSession, progress: Mapping, group_id: str) -> DataFrame:
    """Broker end and committed offset of every partition, from one progress report of a Kafka query.

    One row per topic partition, the size of the report itself.
    """
    rows = []
    for source in progress["sources"]:
        ends, done = _by_partition(source.get("latestOffset")), _by_partition(source.get("endOffset"))
        rows += [(group_id, topic, part, end, done.get((topic, part))) for (topic, part), end in ends.items()]
    return spark.createDataFrame(rows, OFFSETS)
