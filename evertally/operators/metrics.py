"""The counters of the dataflow as plain aggregates over flagged rows.

The three failure counters (publish, sink, change feed) belong to failed micro-batches and come from
`evertally.streaming.listener`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(wide: DataFrame) -> DataFrame:
    """One row of named counters to (metric, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns]))
    return wide.select(pairs.alias("pair")).select("pair.*")


def collect(*counters: DataFrame) -> DataFrame:
    """(metric, value) of all parts; each part is one aggregate row."""
    rows = [_rows(part) for part in counters]
    result = rows[0]
    for part in rows[1:]:
        result = result.unionByName(part)
    return result


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests with a `reason`; only valid ones count, and each is published."""
    is_valid = F.col("reason").isNull()
    return requests.agg(
        F.count_if(is_valid).alias("view_requests_total"),
        F.count_if(is_valid).alias("view_events_published_total"),
    )


def dedup_counters(events: DataFrame, counted: DataFrame) -> DataFrame:
    """Every event is either counted or a duplicate."""
    arrived = events.agg(F.count("*").alias("arrived"), F.lit(0).cast("bigint").alias("unique"))
    unique = counted.agg(F.lit(0).cast("bigint").alias("arrived"), F.count("*").alias("unique"))
    return arrived.unionByName(unique).agg(
        F.sum("unique").alias("unique_view_events_total"),
        (F.sum("arrived") - F.sum("unique")).alias("duplicate_view_events_total"),
    )


def shard_snapshot_counters(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("counter_shard_snapshots_total"),
        F.count_if("stale").alias("stale_shard_snapshots_total"),
    )


def total_snapshot_counters(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count("*").alias("video_total_snapshots_total"))


def sink_counters(persisted: DataFrame) -> DataFrame:
    """A write that the version gate ignores is a success too."""
    return persisted.agg(F.count("*").alias("counter_sink_success_total"))


def rebuild_counters(inserted: DataFrame) -> DataFrame:
    """Only requests that were new to the ledger count."""
    return inserted.agg(F.count("*").alias("counter_cdc_rebuilds"))


def projection_counters(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count_if("applied").alias("counter_cdc_processed"),
        F.count_if(~F.col("applied")).alias("counter_cdc_stale"),
    )
