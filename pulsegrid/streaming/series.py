"""Keyed state of a series of readings, in bounded memory whatever one series brings in a micro-batch.

A stream may not be sorted before a stateful operator, so the rows of a series come in any order. Up to ``HELD_ROWS`` of
them are ordered in memory. Beyond that, sorted runs are put into the state store in blocks and merged from there, with one block
of each run in memory; the blocks leave the store as they are read, so nothing of them outlives the micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from datetime import timedelta
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.schemas import SERIES_KEYS

# executors get the code with the processor and need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HELD_ROWS = 20_000
BLOCK_ROWS = 500

STATE = "last DOUBLE, run BIGINT"
# Times cross into Python as whole microseconds, which need no zone conversion per group.
ROW = (
    "device_id STRING, sensor_id STRING, device_type STRING, sensor_type STRING, "
    "at BIGINT, event_id BIGINT, v DOUBLE"
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Blocks(Protocol):
    """Where blocks of sorted runs wait: the part of ``MapState`` that is needed."""

    def updateValue(self, key: tuple, value: tuple) -> None: ...
    def getValue(self, key: tuple) -> tuple | None: ...
    def removeKey(self, key: tuple) -> None: ...


def _sorted(frames: list[pd.DataFrame]) -> pd.DataFrame:
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    order = np.lexsort((rows["event_id"].to_numpy(), rows["at"].to_numpy()))
    return rows.take(order) if (order[1:] < order[:-1]).any() else rows


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _put_run(frames: list[pd.DataFrame], run: int, blocks: Blocks, block_rows: int) -> int:
    rows = _sorted(frames)
    count = -(-len(rows) // block_rows)
    for i in range(count):
        blocks.updateValue((run, i), (_packed(rows.iloc[i * block_rows:(i + 1) * block_rows]),))
    return count


def _merged(counts: list[int], blocks: Blocks) -> Iterator[pd.DataFrame]:
    """The rows of all runs in order, in pieces; takes the blocks out of the store."""
    following = [0] * len(counts)
    loaded: dict[int, pd.DataFrame] = {}
    while True:
        for run, count in enumerate(counts):
            if run not in loaded and following[run] < count:
                key = (run, following[run])
                loaded[run] = _unpacked(bytes(blocks.getValue(key)[0]))
                blocks.removeKey(key)
                following[run] += 1
        if not loaded:
            return
        # nothing that still lies in the store comes before the end of its run's loaded block
        ends = [(int(f["at"].iloc[-1]), int(f["event_id"].iloc[-1])) for run, f in loaded.items() if following[run] < counts[run]]
        if not ends:
            yield _sorted(list(loaded.values()))
            return
        at, event_id = min(ends)
        taken = []
        for run, rows in list(loaded.items()):
            first = (rows["at"] < at) | ((rows["at"] == at) & (rows["event_id"] <= event_id))
            n = int(first.sum())
            taken.append(rows.iloc[:n])
            if n == len(rows):
                del loaded[run]
            else:
                loaded[run] = rows.iloc[n:]
        yield _sorted(taken)


def in_order(frames: Iterable[pd.DataFrame], blocks: Blocks, held_rows: int = HELD_ROWS, block_rows: int = BLOCK_ROWS) -> Iterator[pd.DataFrame]:
    """All rows by (at, event_id), in pieces that follow each other."""
    held: list[pd.DataFrame] = []
    size, counts = 0, []
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= held_rows:
            counts.append(_put_run(held, len(counts), blocks, block_rows))
            held, size = [], 0
    if not counts:
        if size:
            yield _sorted(held)
        return
    if size:
        counts.append(_put_run(held, len(counts), blocks, block_rows))
        held = []
    yield from _merged(counts, blocks)


def advance(rows: pd.DataFrame, last: float, run: int, stuck_readings: int) -> tuple[pd.DataFrame, float, int]:
    """The ordered rows with ``prev_1`` and ``stuck``, and the last value and length of the run of equal values behind them."""
    values = rows["v"].to_numpy(dtype=float)
    previous = np.concatenate(([last], values[:-1]))
    breaks = np.flatnonzero(values != previous)  # NaN breaks a run, as does a missing predecessor
    position = np.arange(len(values))
    # a run starts at the latest break; before the first one it goes on from the state
    since = np.searchsorted(breaks, position, side="right") - 1
    starts = np.where(since >= 0, breaks[since] if len(breaks) else 0, -run)
    length = position - starts + 1
    return rows.assign(prev_1=previous, stuck=length >= stuck_readings), float(values[-1]), int(length[-1])


class SeriesState(StatefulProcessor):
    """Last value and length of the run of equal values of a sensor, forgotten after ``ttl_ms`` without a reading."""

    def __init__(self, stuck_readings: int, ttl_ms: int | None = None, held_rows: int = HELD_ROWS, block_rows: int = BLOCK_ROWS):
        self.stuck_readings, self.ttl_ms = stuck_readings, ttl_ms
        self.held_rows, self.block_rows = held_rows, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getValueState("series", STATE, self.ttl_ms)
        self.blocks = handle.getMapState("blocks", "run INT, block INT", "rows BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, run = self.series.get() or (float("nan"), 0)
        for piece in in_order(rows, self.blocks, self.held_rows, self.block_rows):
            out, last, run = advance(piece, last, run, self.stuck_readings)
            yield out
        self.series.update((last, run))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The one state store that typed state variables work on; it keeps them on disk. A provider of one's own stays."""
    if spark.conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def with_processor(rows: DataFrame, processor: SeriesState) -> DataFrame:
    """``rows`` of the columns ``ROW`` with ``prev_1`` and ``stuck``."""
    use_rocksdb(rows.sparkSession)
    time_mode = "None" if processor.ttl_ms is None else "ProcessingTime"
    return rows.groupBy(*SERIES_KEYS).transformWithStateInPandas(processor, f"{ROW}, prev_1 DOUBLE, stuck BOOLEAN", "append", time_mode)


def milliseconds(time: timedelta | None) -> int | None:
    return None if time is None else max(1, int(time.total_seconds() * 1000))
