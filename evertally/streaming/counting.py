"""Counting queries: requests → events → counted log → shard snapshots → totals → counter table.

Every stage writes a log that the next one reads, so each restarts from its own checkpoint. A stage
that repeats a micro-batch after a failure changes nothing: its batch folder is already there. Under a new
checkpoint, logs get the batches again as those of a new run, and gates and the counted log drop what they
know: nothing is lost, and nothing is counted twice.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evertally import fixed_values as fixed
from evertally.functions import contracts
from evertally.operators import counts, gate, ingest, split
from evertally.operators.dedup import EVENT_KEYS, dedup_arrivals, distinct_arrivals
from evertally.operators.metrics import shard_snapshot_counters, sink_counters
from evertally.settings import positive_duration
from evertally.sources.dated_log import DatedLog, day_of
from evertally.sources.folders import BatchLog, Table, run_of
from evertally.sources.sink_log import SinkLog
from evertally.streaming.counters import Counters
from evertally.streaming.dedup import LATENESS, horizon_dedup_stream
from evertally.streaming.listener import observed

COUNTED = "event_id STRING, video_id BIGINT, counter_shard_id INT, counted_at TIMESTAMP"
SHARD_SNAPSHOTS = "video_id BIGINT, counter_shard_id INT, count BIGINT, version BIGINT, emitted_at TIMESTAMP"
LATEST_SHARDS = "video_id BIGINT, counter_shard_id INT, count BIGINT, version BIGINT"
TOTAL_SNAPSHOTS = "video_id BIGINT, view_count BIGINT, version BIGINT, emitted_at TIMESTAMP"
ROUTED = (
    "partition INT, offset BIGINT, key STRING, value BINARY, arrival TIMESTAMP, event_id STRING, video_id BIGINT, "
    "user_hash STRING, counter_shard_id INT, occurred_at TIMESTAMP, accepted_at TIMESTAMP, reason STRING, topic STRING"
)

ROUTED_SHARDS = (
    "partition INT, offset BIGINT, key STRING, value BINARY, arrival TIMESTAMP, video_id BIGINT, counter_shard_id INT, "
    "count BIGINT, version BIGINT, emitted_at TIMESTAMP, reason STRING, topic STRING"
)


def accept_requests(requests: DataFrame, secret: str) -> DataFrame:
    """Request stream to (topic, key, value) event records; a narrow plan, so any sink will do."""
    admitted = ingest.with_reason(ingest.admitted(ingest.view_mutations(requests)))
    events = ingest.to_events(admitted.filter("reason is null"), secret)
    return events.select(F.lit(fixed.VIEWS_TOPIC).alias("topic"), *contracts.event_record())


def publish_events(
    requests: DataFrame, secret: str, sent: BatchLog | SinkLog, checkpoint: str, counters: Counters | None = None
) -> DataStreamWriter:
    """Accepted requests to a log of event records, under the name that failed publishing is counted by.

    Through the file sink rows are counted by the listener, as observed in the stream.
    """
    if isinstance(sent, SinkLog):
        events = observed(accept_requests(requests, secret), "view_events_published_total")
        return sent.writer(events, checkpoint, "accept-requests")

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch.sparkSession, checkpoint)
        sent.append(batch, batch_id, run=run)
        if counters is not None:
            published = sent.batch(run, batch_id).count()  # every accepted request is published
            values = {"view_requests_total": published, "view_events_published_total": published}
            counters.add("accept-requests", run, batch_id, values)

    return batches(accept_requests(requests, secret), write, checkpoint, "accept-requests")


def routed_log(spark: SparkSession, path: str, schema: str = ROUTED) -> SinkLog:
    """Where checked records go: a folder per topic, dead letters under theirs."""
    return SinkLog(spark, path, schema, ("topic",))


def route_events(records: DataFrame, routed: BatchLog | SinkLog, checkpoint: str) -> DataStreamWriter:
    """Split a record stream: valid events and dead letters, each under its own topic folder."""
    return _route(records, split.checked_events, ROUTED, routed, checkpoint, "route-events")


def route_shards(
    records: DataFrame, routed: BatchLog | SinkLog, checkpoint: str, shard_count: int = fixed.SHARD_COUNT
) -> DataStreamWriter:
    """The same for shard snapshots: one of a shard that cannot be goes to the dead letters, not to a total."""

    def check(batch: DataFrame) -> DataFrame:
        return split.checked_shards(batch, shard_count)

    return _route(records, check, ROUTED_SHARDS, routed, checkpoint, "route-shards")


def _route(
    records: DataFrame, check, schema: str, routed: BatchLog | SinkLog, checkpoint: str, name: str
) -> DataStreamWriter:
    columns = [c.split()[0] for c in schema.split(", ")]
    if isinstance(routed, SinkLog):
        return routed.writer(split.routed(check(records)).select(*columns), checkpoint, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = split.routed(check(batch)).select(*columns)
        routed.append(rows, batch_id, partition_by=("topic",), run=run_of(batch.sparkSession, checkpoint))

    return batches(records, write, checkpoint, name)


def valid_events(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("topic") == fixed.VIEWS_TOPIC)


def counted_log(spark: SparkSession, path: str) -> DatedLog:
    """The log of counted events, by the day on which they were counted."""
    return DatedLog(spark, path, COUNTED, "counted_at")


def count_events(
    events: DataFrame,
    counted: BatchLog,
    checkpoint: str,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    counters: Counters | None = None,
) -> DataStreamWriter:
    """Deduplicate each micro-batch against what was counted within the last horizon.

    `counted` had better be a `counted_log`: a plain log is listed whole in every micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # a micro-batch is computed again by each use: it is read once, and all that follows works on its arrivals
        arrivals = distinct_arrivals(batch, horizon)
        earliest, arrived = arrivals.agg(F.timestamp_micros(F.min("_t")), F.sum("_n")).first()
        if earliest is None:
            return
        run = run_of(batch.sparkSession, checkpoint)
        # older entries cannot suppress anything: their days are not listed, and of the others only those of the
        # batch's ids are aggregated
        reachable = F.col("counted_at") >= F.lit(earliest) - F.lit(horizon)
        seen = counted.apart_from(run, batch_id, since=day_of(earliest - horizon))
        seen = seen.filter(reachable).select(*EVENT_KEYS, "counted_at")
        seen = seen.join(arrivals.select(*EVENT_KEYS), list(EVENT_KEYS), "left_semi")
        fresh = dedup_arrivals(arrivals, horizon, already_counted=seen)
        counted.append(fresh, batch_id, run=run)
        if counters is not None:
            unique = counted.batch(run, batch_id).count()
            values = {"unique_view_events_total": unique, "duplicate_view_events_total": arrived - unique}
            counters.add("count-events", run, batch_id, values)

    # Spark drops no columns of a micro-batch, so those that nothing needs end before it
    return batches(events.select(*EVENT_KEYS, "accepted_at"), write, checkpoint, "count-events")


def count_events_stateful(
    events: DataFrame,
    counted: BatchLog,
    checkpoint: str,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    lateness: timedelta = LATENESS,
) -> DataStreamWriter:
    """The same with keyed state instead of the log: lower latency, lower throughput. Expired ids leave the state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_whole(counted, batch, batch, batch_id, checkpoint)

    return batches(horizon_dedup_stream(events, horizon, lateness=lateness), write, checkpoint, "count-events").outputMode("update")


def emit_shard_snapshots(counted: DataFrame, snapshots: BatchLog, checkpoint: str) -> DataStreamWriter:
    """Absolute count of every (video, shard) that changed in the micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_whole(snapshots, counts.as_snapshot(batch, "count"), batch, batch_id, checkpoint)

    return batches(counts.shard_counts(counted), write, checkpoint, "shard-snapshots").outputMode("update")


def newer_shards(batch: DataFrame, shards: Table) -> DataFrame:
    """Latest value per (video, shard) of a batch, where it is above the table's."""
    latest = counts.latest_shards(batch).withColumn("version", F.col("count"))
    return gate.newer_rows(latest, shards.known(batch), counts.SHARD)


def totals_of(videos: DataFrame, shards: Table) -> DataFrame:
    """(video_id, view_count) of these videos, over all their shards."""
    stored = shards.read(videos, ["count"])
    return counts.video_totals(stored.join(videos.select("video_id"), "video_id", "left_semi"))


def snapshot_counts(batch: DataFrame, shards: Table) -> dict[str, int]:
    """Snapshots of a batch, and those that are not above what came before them for their shard."""
    order = ("arrival", "offset") if {"arrival", "offset"} <= set(batch.columns) else ("emitted_at", "version")
    flagged = gate.flag_stale(batch, counts.SHARD, order, stored=shards.known(batch))
    return shard_snapshot_counters(flagged).first().asDict()


def emit_totals(
    snapshots: DataFrame,
    totals: BatchLog,
    table: Table,
    shards: Table,
    checkpoint: str,
    counters: Counters | None = None,
) -> DataStreamWriter:
    """Changed totals to the totals log and, behind the version gate, to the counter table.

    `shards` holds the latest value of each (video, shard), whatever the shard numbers; a batch reads and
    writes only the rows of its videos. Repeating a batch changes nothing: both gates have seen it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch.sparkSession, checkpoint)
        if counters is not None:  # before the table takes the batch in: a repetition would find it stale
            counters.add("video-totals", run, batch_id, snapshot_counts(batch, shards))
        shards.upsert(newer_shards(batch, shards).select("video_id", "counter_shard_id", "count", "version"))
        fresh = gate.newer_totals(totals_of(batch, shards), table.known(batch))
        totals.append(fresh.withColumn("emitted_at", F.current_timestamp()), batch_id, run=run)
        # what the log says was emitted is what the table gets, also when the batch is repeated
        emitted = totals.batch(run, batch_id)
        newer = gate.newer_totals(emitted, table.known(emitted))
        table.upsert(newer.withColumn("updated_at", F.current_timestamp()))
        if counters is not None:
            sent = emitted.count()
            values = {"video_total_snapshots_total": sent, "counter_sink_success_total": sent}
            counters.add("video-totals", run, batch_id, values)

    return batches(snapshots, write, checkpoint, "video-totals")


def topic_records(snapshots: DataFrame, contract: contracts.Contract, topic: str) -> DataFrame:
    """Snapshots as (topic, key, value) records, keyed by video, for any sink."""
    return snapshots.select(F.lit(topic).alias("topic"), *contracts.snapshot_record(contract))


def every_tick(writer: DataStreamWriter, interval: timedelta = fixed.SNAPSHOT_INTERVAL) -> DataStreamWriter:
    """Run a query once per tick; each run emits the keys that changed since the last one."""
    positive_duration("interval", interval)
    return writer.trigger(processingTime=f"{interval // timedelta(milliseconds=1)} milliseconds")


def persist_totals(
    records: DataFrame, table: Table, dead: BatchLog, checkpoint: str, counters: Counters | None = None
) -> DataStreamWriter:
    """Total records of a topic to the counter table; bad records are quarantined.

    A failing table stops the query with its offset kept, and a restart retries the batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = split.checked_totals(batch).persist()
        try:
            run = run_of(batch.sparkSession, checkpoint)
            dead.append(split.dead_letters(checked), batch_id, run=run)
            valid = split.valid(checked)
            accepted = gate.newer_totals(valid, table.known(valid))
            table.upsert(accepted.withColumn("updated_at", F.current_timestamp()))
            if counters is not None:
                counters.add("persist-totals", run, batch_id, sink_counters(split.valid(checked)).first().asDict())
        finally:
            checked.unpersist()

    return batches(records, write, checkpoint, "persist-totals")


def append_whole(log: BatchLog, rows: DataFrame, batch: DataFrame, batch_id: int, checkpoint: str) -> None:
    """Append the rows of a stateful batch. One that is there already still has to renew its state."""
    if not log.append(rows, batch_id, run=run_of(batch.sparkSession, checkpoint)):
        batch.write.format("noop").mode("overwrite").save()


def batches(stream: DataFrame, write, checkpoint: str, name: str) -> DataStreamWriter:
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
