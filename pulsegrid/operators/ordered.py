"""Row context in a time series that stays exact when one series outgrows a single task.

A window partitioned by the series key sends a whole series to one task. That is right for the many
ordinary series and fatal for one that holds a third of the table. Series above ``hot_rows`` rows
therefore take a second way: they are range-partitioned on (key, order), which cuts a long series
into chunks of even size, the lags are taken inside the chunks, and only the rows next to a cut
(``depth`` on either side) are looked at again across chunks. Both ways give the same rows.

Where the cuts lie is decided by sampling, and a plan that reads the chunks twice may sample twice. The chunks
are therefore written to the shared folder once, with their numbers, and every reader sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import work_dir

# A series up to this many rows is sorted by one task. At most rows/HOT_ROWS series can be above it,
# which bounds the list of them that is collected and broadcast: 100,000 keys for a table of 10^12 rows.
HOT_ROWS = 10_000_000

PREVIOUS = "prev_"


def previous_columns(depth: int) -> list[str]:
    return [f"{PREVIOUS}{i}" for i in range(1, depth + 1)]


def _window(partition: Sequence[str], order: Sequence[str]) -> str:
    by = f"PARTITION BY {', '.join(partition)} " if partition else ""
    return f"({by}ORDER BY {', '.join(order)})"


def _lags(partition: Sequence[str], order: Sequence[str], value: str, depth: int, prefix: str) -> list[str]:
    window = _window(partition, order)
    return [f"lag({value}, {i}) OVER {window} AS {prefix}{i}" for i in range(1, depth + 1)]


def _whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, depth: int) -> DataFrame:
    return df.selectExpr("*", *_lags(keys, order, value, depth, PREVIOUS))


def _stored(rows: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, depth: int, scratch: str) -> DataFrame:
    in_chunk = [*keys, "_chunk"]
    # adaptive execution may join neighbouring range partitions, never split or mix them, so a
    # partition is always one contiguous piece of the order
    cut = df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    first = _stored(cut, f"{scratch}/chunks").selectExpr(
        "*",
        *_lags(in_chunk, order, value, depth, PREVIOUS),
        f"lag(1, {depth}) OVER {_window(in_chunk, order)} IS NULL AS _head",
        f"lead(1, {depth}) OVER {_window(in_chunk, order)} IS NULL AS _tail",
    )
    # Only the rows beside a cut move once more: they meet per series, 2 * depth rows per chunk. The first rows of a chunk take
    # from there what their chunk does not hold; all others have what they need.
    names = [f"`{name}`" for name in df.columns]
    found = [f"_edge_{i} AS {PREVIOUS}{i}" for i in range(1, depth + 1)]
    edges = first.where("_head OR _tail").selectExpr(*names, "_head", *_lags(keys, order, value, depth, "_edge_"))
    inner = first.where("NOT _head").selectExpr(*names, *previous_columns(depth))
    return inner.unionByName(edges.where("_head").selectExpr(*names, *found))


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Key values with more than ``hot_rows`` rows; never more than rows/hot_rows of them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    depth: int = 1,
    hot_rows: int | None = HOT_ROWS,
    sizes: DataFrame | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Adds ``prev_1`` .. ``prev_depth``: the value 1 .. depth rows earlier in the series, null before its start.

    ``value`` is a SQL expression. ``order`` must be a total order inside a series. ``sizes`` is what the hot series are counted on;
    give the raw table where ``df`` is costly to compute, since a count from above is enough. Without
    ``keys`` the whole table is one series and always goes the chunked way. ``hot_rows=None`` promises
    that no series is large.

    The hot series are counted when this is called. Without any, the plan is one shuffle and one sort. With some, ``df`` is computed
    once and written below ``scratch``, a folder of this call alone (by default a new one in the shared folder).
    """
    if keys and hot_rows is None:
        return _whole(df, keys, order, value, depth)
    spark = df.sparkSession
    if not keys:
        return _chunked(df, keys, order, value, depth, scratch or work_dir(spark, "ordered"))
    counted = hot_keys(df if sizes is None else sizes, keys, hot_rows)
    found = counted.collect()
    if not found:
        return _whole(df, keys, order, value, depth)
    scratch = scratch or work_dir(spark, "ordered")
    hot = F.broadcast(spark.createDataFrame(found, counted.schema).toDF(*[f"_hot_{i}" for i in range(len(keys))]).withColumn("_hot", F.lit(True)))
    same = [F.col(key).eqNullSafe(F.col(f"_hot_{i}")) for i, key in enumerate(keys)]
    tagged = df.join(hot, same, "left").select(*[df[f"`{name}`"] for name in df.columns], F.coalesce("_hot", F.lit(False)).alias("_hot"))
    rows = _stored(tagged, f"{scratch}/rows", ("_hot",))
    ordinary = _whole(rows.where("NOT _hot").drop("_hot"), keys, order, value, depth)
    return ordinary.unionByName(_chunked(rows.where("_hot").drop("_hot"), keys, order, value, depth, scratch))
