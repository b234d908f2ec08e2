"""Pipeline health: lag, throughput, reconciliation and the rules that name a bottleneck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.joins import checked_broadcast
from pulsegrid.operators.ordered import HOT_ROWS, with_previous

# Fixed rule values.
LAG_HIGH, LAG_SOME = 1000, 100
CPU_HIGH_MILLI = 800
TUNE_LAG_HIGH, TUNE_LAG_DONE = 500, 100


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Records not yet consumed, summed over the partitions of every (group, topic)."""
    return offsets.groupBy("group_id", "topic").agg(
        F.sum(F.col("end_offset") - F.coalesce("committed_offset", F.lit(0))).alias("lag")
    )


def health_class(lag: Column) -> Column:
    return F.when(lag > LAG_HIGH, "high").when(lag > LAG_SOME, "processing").otherwise("healthy")


def with_health(lags: DataFrame) -> DataFrame:
    return lags.withColumn("health", health_class(F.col("lag")))


def reconcile_counts(sent: DataFrame, stored: DataFrame, key: str, elapsed_seconds: Column | float) -> DataFrame:
    """Sent, stored and lost records per ``key`` with the end-to-end rate.

    Each side is counted before the join, so the join sees one row per key.
    """
    elapsed = elapsed_seconds if isinstance(elapsed_seconds, Column) else F.lit(float(elapsed_seconds))
    left = sent.groupBy(key).agg(F.count(F.lit(1)).alias("sent"))
    right = stored.groupBy(key).agg(F.count(F.lit(1)).alias("stored"))
    return left.join(right, key, "full_outer").select(
        key,
        F.coalesce("sent", F.lit(0)).alias("sent"),
        F.coalesce("stored", F.lit(0)).alias("stored"),
        (F.coalesce("sent", F.lit(0)) - F.coalesce("stored", F.lit(0))).alias("lost"),
        (F.coalesce("stored", F.lit(0)) / elapsed).alias("rate"),
    )


def lost_records(sent: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sent records that are not stored."""
    return sent.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def bucket_sums(rows: DataFrame, keys: Sequence[str], by: Sequence[str], buckets: int) -> DataFrame:
    """Per group and hash bucket of the keys: count, sum and exclusive or of the keys' hashes, whatever the order of the rows.

    One small row per group and bucket, which can be kept beside a table and updated with every batch.
    """
    hashed = rows.select(*by, F.xxhash64(*keys).alias("_hash")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    return hashed.groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_hash").cast("decimal(20,0)")).alias("_sum"), F.bit_xor("_hash").alias("_xor")
    )


def lost_records_by_bucket(
    sent: DataFrame, stored: DataFrame, keys: Sequence[str], by: Sequence[str] = ("dt",), buckets: int = 256, sums: DataFrame | None = None
) -> DataFrame:
    """``lost_records``, comparing rows only where the two sides' checksums differ.

    Both sides have the columns ``by`` (the day, say), so a differing day prunes the partitions of the second read, and what
    is shuffled is the rows of differing buckets and one row per bucket. ``sums`` are kept ``bucket_sums`` of the stored
    side, if there are any. Buckets agree by 64-bit sums of hashes.
    """
    mine, names = bucket_sums(sent, keys, by, buckets), [*by, "_bucket"]
    theirs = bucket_sums(stored, keys, by, buckets) if sums is None else sums
    theirs = theirs.select(*[F.col(name).alias(f"{name}_") for name in (*names, "_n", "_sum", "_xor")])
    same = [F.col(name).eqNullSafe(F.col(f"{name}_")) for name in (*names, "_n", "_sum", "_xor")]
    differ = checked_broadcast(mine.join(theirs, same, "left_anti").select(*[F.col(name).alias(f"{name}_") for name in names]))

    def suspects(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        return placed.join(differ, [F.col(name).eqNullSafe(F.col(f"{name}_")) for name in names], "left_semi").drop("_bucket")

    return lost_records(suspects(sent), suspects(stored), keys)


def throughput_delta(
    samples: DataFrame, keys: Sequence[str] = (), time: str = "sample_ts", count: str = "count",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Growth of a row count between successive samples, and per second.

    The first sample has nothing to compare with and counts from 0, without a rate.
    """
    # the count breaks ties, so the order is total for a count that grows
    out = with_previous(samples, keys, (time, count), f"named_struct('at', {time}, 'n', {count})", 1, hot_rows)
    seconds = (F.unix_micros(time) - F.unix_micros(F.col("prev_1.at"))) / 1_000_000
    delta = F.col(count) - F.coalesce(F.col("prev_1.n"), F.lit(0))
    return (
        out.withColumn("delta", delta)
        .withColumn("per_second", F.when(seconds > 0, F.col("delta") / seconds))
        .drop("prev_1")
    )


def bottleneck(runs: DataFrame) -> DataFrame:
    """Names the bottleneck of load-test runs; of the rules that apply the last one decides.

    Columns: lag, sent, errors, ingestion_cpu, worker_cpu, database_cpu (millicores). A null figure
    was not measured and trips no rule.
    """
    verdict = (
        F.when(F.col("database_cpu") > CPU_HIGH_MILLI, "database")
        .when(F.col("worker_cpu") > CPU_HIGH_MILLI, "worker")
        .when(F.col("ingestion_cpu") > CPU_HIGH_MILLI, "ingestion")
        # whole-number division, as the rule is stated for counts
        .when(F.col("errors") > F.floor(F.col("sent") / 10), "ingestion")
        .when(F.col("lag") > LAG_HIGH, "worker")
        .otherwise("none")
    )
    return runs.withColumn("bottleneck", verdict)


def tuning_decision(runs: DataFrame) -> DataFrame:
    """What to scale next for runs with columns throughput, target and lag; ``done`` when on target."""
    throughput, target, lag = F.col("throughput"), F.col("target"), F.col("lag")
    decision = (
        F.when((throughput >= target) & (lag < TUNE_LAG_DONE), "done")
        .when(lag > TUNE_LAG_HIGH, "worker")
        .when(throughput < F.floor(target / 2), "ingestion")
        .otherwise("worker")
    )
    return runs.withColumn("decision", decision)
