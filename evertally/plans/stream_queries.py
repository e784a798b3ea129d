"""Registered streaming runs: the whole `events` table replayed in arrival order, to the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evertally import fixed_values as fixed
from evertally.functions import contracts
from evertally.operators import counts
from evertally.plans import mapping as m
from evertally.plans.queries import HOUR, query, us
from evertally.session import ROCKSDB, fresh_folder
from evertally.sources import topics
from evertally.sources.dated_log import DatedLog
from evertally.sources.folders import BatchLog, Table
from evertally.streaming import counting, projection, ticks
from evertally.streaming.counters import Counters

AS_OF = datetime(2024, 1, 31)
# Arrival dates at which the replay is cut; the first and last parts are open-ended
CUTS = ("2024-01-09", "2024-01-17", "2024-01-25")
PART = "replay_part"


def run(writer: DataStreamWriter) -> None:
    """Process everything that is there, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


@contextmanager
def state_stores(spark: SparkSession) -> Iterator[None]:
    """RocksDB state, and no more state partitions than there are cores: their number is fixed when a
    stateful query first runs, and adaptive execution does not merge them."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.shuffle.partitions": str(partitions),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def replay(rows: DataFrame, at: str, path: str, build: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Deliver the rows part by part in arrival order; the query is restarted for every part.

    The rows are computed once, however many parts they are cut into.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    log = BatchLog(rows.sparkSession, path, fields)
    part_of = F.lit(0)
    for part, cut in enumerate(CUTS, start=1):
        part_of = F.when(F.col(at) >= F.lit(cut).cast("timestamp"), part).otherwise(part_of)
    log.stage(rows.filter(F.col(at).isNotNull()).withColumn(PART, part_of), PART)
    for part in range(len(CUTS) + 1):
        log.append_staged(PART, part, part)
        run(build(log.stream()))


def counted_log(spark: SparkSession, sf: str, base: str) -> DatedLog:
    counted = counting.counted_log(spark, f"{base}/counted")

    def count(rows: DataFrame) -> DataStreamWriter:
        return counting.count_events(m.view_events_of(rows), counted, f"{base}/checkpoints/counted")

    replay(m.events(spark, sf), "ts", f"{base}/events", count)
    return counted


@query
def stream_horizon_dedup(spark: SparkSession, sf: str) -> DataFrame:
    counted = counted_log(spark, sf, fresh_folder(spark, "stream")).read()
    return counted.select("event_id", "video_id", "counter_shard_id", us("counted_at", "counted_us"))


@query
def stream_horizon_dedup_stateful(spark: SparkSession, sf: str) -> DataFrame:
    """The low-latency form: one state value per event id."""
    base = fresh_folder(spark, "stream")
    log = counting.counted_log(spark, f"{base}/counted")

    def count(rows: DataFrame) -> DataStreamWriter:
        return counting.count_events_stateful(m.view_events_of(rows), log, f"{base}/checkpoints/counted")

    with state_stores(spark):
        replay(m.events(spark, sf), "ts", f"{base}/events", count)
    return log.read().select("event_id", "video_id", "counter_shard_id", us("counted_at", "counted_us"))


@query
def stream_video_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Events to counted log to shard snapshots to the counter table, each stage its own query."""
    base = fresh_folder(spark, "stream")
    counted = counted_log(spark, sf, base)
    snapshots = BatchLog(spark, f"{base}/shards", counting.SHARD_SNAPSHOTS)
    totals = BatchLog(spark, f"{base}/totals", counting.TOTAL_SNAPSHOTS)
    table = Table(spark, f"{base}/counter", contracts.VIDEO_COUNTER)
    shards = Table(spark, f"{base}/latest", counting.LATEST_SHARDS, counts.SHARD)
    with state_stores(spark):
        run(counting.emit_shard_snapshots(counted.stream(), snapshots, f"{base}/checkpoints/shards"))
    run(counting.emit_totals(snapshots.stream(), totals, table, shards, f"{base}/checkpoints/totals"))
    return table.read().select("video_id", "view_count", "version")


@query
def stream_snapshot_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots by timers; the ticks of the last ten seconds wait for a newer arrival."""
    base = fresh_folder(spark, "stream")
    counted = m.first_arrivals(spark, sf)
    snapshots = BatchLog(spark, f"{base}/shards", counting.SHARD_SNAPSHOTS)

    def emit(rows: DataFrame) -> DataStreamWriter:
        return ticks.emit_ticks(rows, snapshots, f"{base}/checkpoints/ticks", HOUR)

    with state_stores(spark):
        replay(counted, "counted_at", f"{base}/counted", emit)
    names = "video_id", "counter_shard_id", "count", "version"
    return snapshots.read().select(*names, us("emitted_at", "emitted_us"))


@query
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    base = fresh_folder(spark, "stream")
    rows = m.events_stream(spark, sf)
    routed = counting.routed_log(spark, f"{base}/routed")
    run(counting.route_events(m.event_records_of(rows), routed, f"{base}/checkpoints/routed"))
    return routed.read().select("topic", "partition", "offset", "key", "reason")


@query
def stream_shard_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Shard snapshot records: those that break their contract or key never reach a total."""
    base = fresh_folder(spark, "stream")
    records = m.snapshot_records(m.shard_feed(spark, sf), contracts.SHARD_SNAPSHOT, fixed.SHARDS_TOPIC)
    records.write.parquet(f"{base}/records")
    routed = counting.routed_log(spark, f"{base}/routed", counting.ROUTED_SHARDS)
    run(counting.route_shards(topics.file_records(spark, f"{base}/records"), routed, f"{base}/checkpoints/routed"))
    return routed.read().select("topic", "offset", "reason", "video_id", "counter_shard_id", "count", "version")


@query
def stream_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """Totals written under one checkpoint, and all of them again, with newer ones, under another."""
    base = fresh_folder(spark, "stream")
    table = Table(spark, f"{base}/counter", contracts.VIDEO_COUNTER)
    dead = BatchLog(spark, f"{base}/dead", contracts.RAW_RECORD + ", reason STRING")
    feed = m.total_feed(spark, sf)
    for part, rows in enumerate((m.before_midpoint(feed), feed)):
        records = m.snapshot_records(rows, contracts.TOTAL_SNAPSHOT, fixed.TOTALS_TOPIC)
        records.write.parquet(f"{base}/records{part}")
        stream = topics.file_records(spark, f"{base}/records{part}")
        run(counting.persist_totals(stream, table, dead, f"{base}/checkpoints/{part}"))
    letters = dead.read().select("offset", "reason").distinct()  # quarantined once by each run
    stored = table.read().select("video_id", "view_count", "version")
    return stored.unionByName(letters, allowMissingColumns=True)


def empty_projection(counters: DataFrame, base: str) -> projection.Projection:
    """A projection that is still to be built from these stored counters."""
    spark = counters.sparkSession
    source = Table(spark, f"{base}/source", contracts.VIDEO_COUNTER)
    source.replace(counters)
    return projection.Projection(
        Table(spark, f"{base}/projection", contracts.PROJECTION, ["key"]),
        source,
        Table(spark, f"{base}/ledger", contracts.REBUILD_LEDGER, ["id"]),
    )


@query
def stream_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Change feed to projection, starting with a rebuild from the counter table."""
    base = fresh_folder(spark, "stream")
    target = empty_projection(m.stored_counters(spark, sf), base)

    def project(changes: DataFrame) -> DataStreamWriter:
        return projection.project_changes(changes, target, f"{base}/checkpoints/projection")

    feed = m.usable_change_feed(spark, sf).filter(m.pending_video()).drop("video_id")
    replay(feed, "emitted_at", f"{base}/feed", project)
    return target.table.read()


@query
def topic_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Event records written to a dated topic in three batches, expired as of the last one, and read again."""
    columns = "topic", "partition", "offset", "key", "value", "arrival"
    topic = DatedLog(spark, f"{fresh_folder(spark, 'topic')}/views", contracts.RAW_RECORD, "arrival", keep=timedelta(0))
    records = m.event_records(spark, sf).select(*columns)
    for part in range(3):
        topic.append(records.filter(F.col("offset") % 3 == part), part)
    topic.expire_days(AS_OF)
    return topic.read().select("offset", "key", us("arrival", "arrival_us"), F.col("day").cast("string").alias("day"))


@query
def stream_counter_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The counters that the jobs themselves keep, each stage replayed in four restarts."""
    base = fresh_folder(spark, "stream")
    counters = Counters(spark, f"{base}/counters")

    def stage(rows: DataFrame, at: str, name: str, build: Callable[[DataFrame, str], DataStreamWriter]) -> None:
        replay(rows, at, f"{base}/{name}-input", lambda stream: build(stream, f"{base}/checkpoints/{name}"))

    sent = BatchLog(spark, f"{base}/sent", "topic STRING, key STRING, value BINARY")
    events = m.events(spark, sf)

    def publish(rows: DataFrame, checkpoint: str) -> DataStreamWriter:  # requests are accepted at the event's time
        return counting.publish_events(m.raw_requests_of(rows), m.SECRET, sent, checkpoint, counters)

    stage(events, "ts", "publish", publish)

    counted = counting.counted_log(spark, f"{base}/counted")
    stage(events, "ts", "count", lambda s, c: counting.count_events(m.view_events_of(s), counted, c, counters=counters))

    totals = BatchLog(spark, f"{base}/totals", counting.TOTAL_SNAPSHOTS)
    table = Table(spark, f"{base}/counter", contracts.VIDEO_COUNTER)
    shards = Table(spark, f"{base}/latest", counting.LATEST_SHARDS, counts.SHARD)
    feed = m.shard_feed(spark, sf)
    stage(feed, "arrival", "totals", lambda s, c: counting.emit_totals(s, totals, table, shards, c, counters))

    persisted = Table(spark, f"{base}/persisted", contracts.VIDEO_COUNTER)
    dead = BatchLog(spark, f"{base}/dead", contracts.RAW_RECORD + ", reason STRING")
    log = m.total_log(spark, sf)
    log.write.parquet(f"{base}/total-log")  # three inputs come from it
    log = spark.read.schema(log.schema).parquet(f"{base}/total-log")
    records = m.snapshot_records(m.total_feed_of(log), contracts.TOTAL_SNAPSHOT, fixed.TOTALS_TOPIC)
    stage(records, "arrival", "persist", lambda s, c: counting.persist_totals(s, persisted, dead, c, counters))

    target = empty_projection(m.stored_counters_of(log), base)
    changes = m.usable_change_feed_of(m.total_feed_of(log)).filter(m.pending_video()).drop("video_id")
    stage(changes, "arrival", "project", lambda s, c: projection.project_changes(s, target, c, counters))
    return counters.read()
