"""Counting: events to (video, shard) counts to video totals, and per-tick snapshots."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.settings import micros, positive_duration, slice_start

SHARD = ("video_id", "counter_shard_id")
#: Ticks that are ordered together in a running sum.
TICKS_PER_SLICE = 3600


def shard_counts(counted: DataFrame) -> DataFrame:
    """Absolute count per (video, shard); partial aggregation absorbs hot videos."""
    return counted.groupBy(*SHARD).agg(F.count("*").alias("count"))


def latest_shards(snapshots: DataFrame) -> DataFrame:
    """Newest value per (video, shard); version equals count, so the maximum is the newest."""
    return snapshots.groupBy(*SHARD).agg(F.max("count").alias("count"))


def video_totals(shards: DataFrame) -> DataFrame:
    """Sum of the latest shard values; ANSI `sum` raises on overflow."""
    return shards.groupBy("video_id").agg(F.sum("count").alias("view_count"))


def as_snapshot(counts: DataFrame, value: str, emitted_at: Column | None = None) -> DataFrame:
    """Absolute snapshot: the version is the count itself."""
    at = F.current_timestamp() if emitted_at is None else emitted_at
    return counts.withColumn("version", F.col(value)).withColumn("emitted_at", at)


def tick_end(at: Column, interval: timedelta = fixed.SNAPSHOT_INTERVAL) -> Column:
    """First tick strictly after the arrival."""
    step = micros(positive_duration("interval", interval))
    return F.timestamp_micros(slice_start(F.unix_micros(at), step) + F.lit(step))


def snapshots_per_tick(
    counted: DataFrame,
    keys: tuple[str, ...] = SHARD,
    value: str = "count",
    interval: timedelta = fixed.SNAPSHOT_INTERVAL,
) -> DataFrame:
    """One absolute snapshot per changed key and tick.

    Events are counted per (key, tick) before anything is ordered. The running sum is built in two levels:
    changes are summed per time slice, slices are summed per key, and ticks are ordered only inside a slice, so
    a key with changes in every tick of a year is no single window group.
    """
    changes = counted.groupBy(*keys, tick_end(F.col("counted_at"), interval).alias("emitted_at")).agg(
        F.count("*").alias("_change")
    )
    width = micros(interval) * TICKS_PER_SLICE
    changes = changes.withColumn("_slice", slice_start(F.unix_micros("emitted_at"), width))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = changes.groupBy(*keys, "_slice").agg(F.sum("_change").alias("_sum"))
    before = slices.select(*keys, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("emitted_at").rowsBetween(Window.unboundedPreceding, 0)
    running = changes.withColumn("_inside", F.sum("_change").over(inside)).join(before, [*keys, "_slice"])
    running = running.select(*keys, (F.col("_before") + F.col("_inside")).alias(value), "emitted_at")
    return as_snapshot(running, value, F.col("emitted_at"))
