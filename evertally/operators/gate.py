"""Version gates: a newer version wins, an equal or older one changes nothing.

A gate is a maximum by version, hence commutative and idempotent: duplicated, late or reordered
input gives the same table. All of it is partial aggregation, so a hot key shrinks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions.identity import projection_key
from evertally.settings import micros, positive_duration, slice_start


def latest_by(rows: DataFrame, keys: Sequence[str], newest: Column) -> DataFrame:
    """The row with the greatest `newest` per key, all columns kept."""
    values = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), newest).alias("_row"))
    return best.select(*keys, "_row.*")


def compact(records: DataFrame, keys: Sequence[str] = ("key",), order: str = "offset") -> DataFrame:
    """Log compaction: the last record of each key."""
    return latest_by(records, keys, F.col(order))


# Two forms of the same gate. The bulk merges touch table and batch once and shuffle both: right when
# they are of similar size. `newer_rows` + `replace_rows` are for a micro-batch that is small beside
# its table: the keys of the batch are broadcast and the table is scanned but not shuffled.


def merge_counter(table: DataFrame, totals: DataFrame) -> DataFrame:
    """Bulk upsert of totals into the counter table where they are newer.

    Version and count are equal by contract, so a plain maximum is the whole gate. `updated_at`
    moves only with an accepted write.
    """
    batch = totals.groupBy("video_id").agg(F.max("view_count").alias("_count"))
    merged = table.join(batch, "video_id", "full_outer")
    newer = F.col("version").isNull() | (F.col("_count") > F.col("version"))
    accepted = F.col("_count").isNotNull() & newer

    def pick(new: Column, old: str) -> Column:
        return F.when(accepted, new).otherwise(F.col(old)).alias(old)

    return merged.select(
        "video_id",
        pick(F.col("_count"), "view_count"),
        pick(F.col("_count"), "version"),
        pick(F.current_timestamp(), "updated_at"),
    )


def merge_projection(
    projection: DataFrame, changes: DataFrame, order: str = "offset", prefix: str = fixed.PROJECTION_PREFIX
) -> DataFrame:
    """Bulk apply of changes (video_id, count, version, order) to the projection.

    Of equal versions the stored one stays, then the one that came first.
    """
    columns = ["key", "video_id", "count", "version"]
    keyed = changes.withColumn("key", projection_key(F.col("video_id"), prefix))
    incoming = keyed.select(*columns, F.lit(0).alias("_stored"), (-F.col(order)).alias("_earliest"))
    stored = projection.select(*columns, F.lit(1).alias("_stored"), F.lit(0).cast("bigint").alias("_earliest"))
    both = stored.unionByName(incoming)
    return latest_by(both, ["key", "video_id"], F.struct("version", "_stored", "_earliest")).select(*columns)


def newer_rows(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch (one per key) whose version the table does not have yet."""
    keys = list(keys)
    known = table.select(*keys, F.col("version").alias("_known")).join(batch.select(*keys), keys, "left_semi")
    fresh = F.col("_known").isNull() | (F.col("version") > F.col("_known"))
    return batch.join(known, keys, "left").filter(fresh).select(*batch.columns)


def replace_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the given rows put in place of those with the same key."""
    keys = list(keys)
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*table.columns))


def newer_totals(totals: DataFrame, table: DataFrame) -> DataFrame:
    """Greatest total per video where it is above the counter table's."""
    batch = totals.groupBy("video_id").agg(F.max("view_count").alias("view_count"))
    return newer_rows(batch.withColumn("version", F.col("view_count")), table, ["video_id"])


def newer_changes(
    changes: DataFrame, projection: DataFrame, order: str = "offset", prefix: str = fixed.PROJECTION_PREFIX
) -> DataFrame:
    """Projection rows that the changes bring forward."""
    nothing = projection.limit(0)
    return newer_rows(merge_projection(nothing, changes, order, prefix), projection, ["key"])


def insert_if_absent(ledger: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of the ledger plus those new ids; the first row of an id wins."""
    return ledger.unionByName(absent_rows(ledger, rows, order))


def absent_rows(ledger: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    values = [c for c in ledger.columns if c != "id"]
    first = F.struct(order, *values) if order else F.struct(*values)
    once = rows.groupBy("id").agg(F.min_by(F.struct(*values), first).alias("_row"))
    return once.select("id", "_row.*").join(ledger.select("id"), "id", "left_anti").select(*ledger.columns)


def flag_stale(
    rows: DataFrame,
    keys: Sequence[str] = ("video_id", "counter_shard_id"),
    order: Sequence[str] = ("arrival", "offset"),
    slice_width: timedelta = timedelta(minutes=1),
    stored: DataFrame | None = None,
) -> DataFrame:
    """Add `stale`: the version is not above every version that arrived earlier for the key.

    `stored` (keys, version; one row per key) is what was there before the first row.

    Every row comes back; one without a key, an arrival or a version is not stale, and makes none stale.

    The running maximum is built in two levels so that a hot key is never one window group: the
    maximum per time slice is aggregated first, its running maximum has one row per slice, and only
    the rows inside one slice are then ordered.
    """
    width = micros(positive_duration("slice width", slice_width))
    complete = reduce(and_, [F.col(c).isNotNull() for c in (*keys, order[0], "version")])
    # rows that take no part get no slice, and so no predecessors
    sliced = rows.withColumn("_slice", F.when(complete, slice_start(F.unix_micros(order[0]), width)))
    slices = sliced.filter("_slice is not null").groupBy(*keys, "_slice").agg(F.max("version").alias("_slice_max"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*keys, "_slice", F.max("_slice_max").over(earlier).alias("_before"))
    if stored is not None:  # joined to the slices, of which a hot key has few
        known = stored.select(*keys, F.col("version").alias("_known"))
        before = before.join(known, list(keys), "left").withColumn("_before", F.greatest("_before", "_known")).drop("_known")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    previous = F.greatest("_before", F.max("version").over(inside))
    flagged = sliced.join(before, [*keys, "_slice"], "left")
    stale = F.col("_slice").isNotNull() & F.coalesce(F.col("version") <= previous, F.lit(False))
    return flagged.withColumn("stale", stale).select(*rows.columns, "stale")


def flag_applied(
    changes: DataFrame,
    order: Sequence[str] = ("arrival", "offset"),
    slice_width: timedelta = timedelta(minutes=1),
    projection: DataFrame | None = None,
) -> DataFrame:
    """Add `applied`: whether the projection's gate takes the change when it arrives.

    `projection` is the stored side before the first change; without one, it was empty.
    """
    flagged = flag_stale(changes, ["video_id"], order, slice_width, projection)
    return flagged.withColumn("applied", ~F.col("stale")).drop("stale")
