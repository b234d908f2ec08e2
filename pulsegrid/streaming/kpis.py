"""KPIs in fixed event-time windows, emitted once a window is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.kpi import kpis_tumbling
from pulsegrid.streaming.landing import start


def start_tumbling(
    readings: DataFrame, path: str, checkpoint: str, size: str = "5 minutes", lateness: str = "10 minutes",
    trigger: str | None = "5 minutes",
) -> StreamingQuery:
    """A window is written when the watermark has passed it; rows later than that are dropped."""
    out = kpis_tumbling(readings, size, lateness)
    writer = out.writeStream.format("parquet").outputMode("append")
    return start(writer.option("path", path).option("checkpointLocation", checkpoint), trigger)
