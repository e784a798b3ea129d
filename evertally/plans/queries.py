"""One registered query per operator; each reads the whole `events` table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions import contracts, identity, validation
from evertally.operators import audit, cdc, counts, gate, ingest, metrics, reads, retention, split
from evertally.operators.dedup import horizon_dedup
from evertally.plans import mapping as m
from evertally.session import fresh_folder
from evertally.sources.folders import Folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def query(build: Query) -> Query:
    QUERIES[build.__name__.removesuffix("_query")] = build
    return build


def us(name: str, alias: str) -> Column:
    return F.unix_micros(name).alias(alias)


# --- scans ------------------------------------------------------------------------------------


@query
def request_scan(spark: SparkSession, sf: str) -> DataFrame:
    times = us("occurred_at", "occurred_us"), us("accepted_at", "accepted_us")
    return m.requests(spark, sf).select("source_id", "video_id", "email", "idempotency_key", *times)


@query
def counter_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return reads.lookup_counter(m.counter_table(m.total_log(spark, sf)), 7)


@query
def projection_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return reads.lookup_projection(m.user_projection(spark, sf), 8)


@query
def snapshot_reread(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.reread(m.counter_table(m.total_log(spark, sf)))


# --- sinks and gates --------------------------------------------------------------------------


@query
def compact_latest(spark: SparkSession, sf: str) -> DataFrame:
    feed = m.total_feed(spark, sf).select(F.col("video_id").cast("string").alias("key"), "offset", "view_count")
    return gate.compact(feed)


@query
def retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    records = m.event_records(spark, sf)
    kept = retention.retained(records, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return kept.select("offset", "key", us("arrival", "arrival_us"))


@query
def version_gated_upsert(spark: SparkSession, sf: str) -> DataFrame:
    feed = m.total_feed(spark, sf).filter(m.pending_video())
    return gate.merge_counter(m.stored_counters(spark, sf), feed).select("video_id", "view_count", "version")


@query
def projection_apply(spark: SparkSession, sf: str) -> DataFrame:
    stored = m.stored_projection(spark, sf)
    return gate.merge_projection(stored, m.clean_changes(spark, sf).filter(m.pending_video()))


@query
def projection_apply_outcome(spark: SparkSession, sf: str) -> DataFrame:
    stored = m.stored_projection(spark, sf)
    changes = gate.flag_applied(m.clean_changes(spark, sf), slice_width=HOUR, projection=stored)
    return changes.select("offset", "video_id", "version", "applied")


@query
def ledger_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    ledger, rows = m.rebuild_requests(spark, sf)
    return gate.insert_if_absent(ledger, rows, order="event_id")


# --- projections ------------------------------------------------------------------------------


@query
def email_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return m.raw_requests(spark, sf).select(
        "source_id", identity.normalize_email(F.col("email")).alias("normalized_email")
    )


@query
def user_hash(spark: SparkSession, sf: str) -> DataFrame:
    return m.requests(spark, sf).select("source_id", identity.user_hash(m.SECRET, F.col("email")).alias("user_hash"))


@query
def event_identity(spark: SparkSession, sf: str) -> DataFrame:
    digest = identity.event_id(m.SECRET, F.col("email"), F.col("video_id"), F.col("idempotency_key"))
    return m.requests(spark, sf).select("source_id", digest.alias("event_id"))


@query
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return m.view_events(spark, sf).select("source_id", "counter_shard_id")


@query
def shard_key_parse(spark: SparkSession, sf: str) -> DataFrame:
    keyed = m.view_events(spark, sf).select(
        "source_id", identity.shard_key(F.col("video_id"), F.col("counter_shard_id")).alias("key")
    )
    video, shard = identity.parse_shard_key(F.col("key"))
    return keyed.select("source_id", "key", video.alias("video_id"), shard.alias("counter_shard_id"))


@query
def occurred_default(spark: SparkSession, sf: str) -> DataFrame:
    return m.view_events(spark, sf).select("source_id", us("occurred_at", "occurred_us"))


@query
def identity_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    clean = validation.sanitize_identity(m.raw_requests(spark, sf))
    generated = F.col("request_id").rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")
    return clean.select(
        "source_id",
        "authenticated_email",
        F.when(generated, "generated").otherwise(F.col("request_id")).alias("request_id"),
    )


@query
def decode_contract(spark: SparkSession, sf: str) -> DataFrame:
    decoded = contracts.decode(m.event_records(spark, sf), contracts.VIEW_EVENT)
    names = ("event_id", "video_id", "user_hash", "counter_shard_id")
    return decoded.select(
        "offset",
        "decoded",
        *[F.when(F.col("decoded"), F.col(name)).alias(name) for name in names],
        us("occurred_at", "occurred_us"),
        us("accepted_at", "accepted_us"),
    )


@query
def decode_shard_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    records = m.snapshot_records(m.shard_feed(spark, sf), contracts.SHARD_SNAPSHOT, fixed.SHARDS_TOPIC)
    checked = split.checked_shards(records)
    return checked.select(
        "offset", "reason", "video_id", "counter_shard_id", "count", "version", us("emitted_at", "emitted_us")
    )


@query
def decode_total_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    records = m.snapshot_records(m.total_feed(spark, sf), contracts.TOTAL_SNAPSHOT, fixed.TOTALS_TOPIC)
    checked = split.checked_totals(records)
    return checked.select("offset", "reason", "video_id", "view_count", "version", us("emitted_at", "emitted_us"))


@query
def accepted_response(spark: SparkSession, sf: str) -> DataFrame:
    admitted = ingest.admitted(ingest.view_mutations(m.raw_requests(spark, sf)))
    accepted = ingest.with_reason(admitted).filter("reason is null")
    return ingest.accepted_response(ingest.to_events(accepted, m.SECRET))


@query
def cdc_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    changes = cdc.unwrap(m.change_feed(spark, sf))
    usable = F.col("error").isNull()
    values = [F.when(usable, F.col(c)).alias(c) for c in ("video_id", "count", "version")]
    return changes.select("offset", F.when(usable, F.col("op")).alias("op"), *values, "error")


# --- filters ----------------------------------------------------------------------------------


@query
def route_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.view_mutations(m.raw_requests(spark, sf)).select("source_id", "method", "path")


@query
def admission_filter(spark: SparkSession, sf: str) -> DataFrame:
    passes = validation.is_admitted(*map(F.col, ("method", "path", "email", "idempotency_key")))
    return m.raw_requests(spark, sf).select("source_id", passes.alias("admitted"))


@query
def request_validate(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.with_reason(m.raw_requests(spark, sf), email="email").select("source_id", "reason")


@query
def occurrence_bounds(spark: SparkSession, sf: str) -> DataFrame:
    plausible = validation.is_plausible_occurrence(F.col("occurred_at"), F.col("accepted_at"))
    return m.raw_requests(spark, sf).select("source_id", plausible.alias("plausible"))


@query
def contract_view_event(spark: SparkSession, sf: str) -> DataFrame:
    damaged = m.view_events(spark, sf).withColumns(
        {
            "event_id": F.when(m.every(61), F.upper("event_id"))
            .when(m.every(61, 1), F.concat("event_id", F.lit("\n")))
            .otherwise(F.col("event_id")),
            "video_id": F.when(m.every(41), 0).otherwise(F.col("video_id")),
            "user_hash": F.when(m.every(67), F.lit(None)).otherwise(F.col("user_hash")),
            "counter_shard_id": F.when(m.every(71), -1).otherwise(F.col("counter_shard_id")),
            "occurred_at": F.when(m.every(73), F.lit(None)).otherwise(F.col("occurred_at")),
        }
    )
    return damaged.select("source_id", contracts.is_view_event().alias("is_valid"))


@query
def contract_shard_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    damaged = m.shard_feed(spark, sf).withColumns(
        {
            "version": F.when(F.col("offset") % 5 == 0, F.col("version") - 1).otherwise(F.col("version")),
            "counter_shard_id": F.when(F.col("offset") % 7 == 0, -1).otherwise(F.col("counter_shard_id")),
            "emitted_at": F.when(F.col("offset") % 11 == 0, F.lit(None)).otherwise(F.col("emitted_at")),
        }
    )
    return damaged.select("offset", contracts.is_shard_snapshot().alias("is_valid"))


@query
def contract_total_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    damaged = m.total_feed(spark, sf).withColumns(
        {
            "version": F.when(F.col("offset") % 5 == 0, F.col("version") - 1).otherwise(F.col("version")),
            "video_id": F.when(F.col("offset") % 7 == 0, -F.col("video_id")).otherwise(F.col("video_id")),
        }
    )
    return damaged.select("offset", contracts.is_total_snapshot().alias("is_valid"))


@query
def contract_projection(spark: SparkSession, sf: str) -> DataFrame:
    damaged = m.clean_changes(spark, sf).withColumns(
        {
            "count": F.when(F.col("offset") % 5 == 0, -F.col("count")).otherwise(F.col("count")),
            "version": F.when(F.col("offset") % 7 == 0, F.lit(None)).otherwise(F.col("version")),
        }
    )
    return damaged.select("offset", contracts.is_projection().alias("is_valid"))


@query
def key_agreement(spark: SparkSession, sf: str) -> DataFrame:
    records = m.view_events(spark, sf)
    shard = identity.shard_key(F.col("video_id"), F.col("counter_shard_id"))
    video = F.col("video_id").cast("string")
    event_key = F.when(m.every(89), F.concat(shard, F.lit("0"))).otherwise(shard)
    video_key = F.when(m.every(79), F.concat(F.lit("0"), video)).otherwise(video)
    return records.select(
        "source_id",
        contracts.agrees_with_event_key(event_key, shard_count=120).alias("event_stage"),
        contracts.agrees_with_video_key(video_key, shard_count=120).alias("shard_stage"),
        contracts.agrees_with_video_key(video_key).alias("total_sink"),
    )


@query
def valid_invalid_split(spark: SparkSession, sf: str) -> DataFrame:
    records = split.routed(split.checked_events(m.event_records(spark, sf)))
    return records.select("topic", "partition", "offset", "key", "reason")


@query
def cdc_op_filter(spark: SparkSession, sf: str) -> DataFrame:
    changes = cdc.unwrap(m.change_feed(spark, sf))
    return changes.groupBy(F.coalesce("error", F.lit("usable")).alias("outcome")).agg(F.count("*").alias("changes"))


@query
def table_audit(spark: SparkSession, sf: str) -> DataFrame:
    sound = m.user_counters(spark, sf)
    damaged = sound.withColumns(
        {
            "view_count": F.when(F.col("video_id") % 13 == 0, -F.col("view_count")).otherwise(F.col("view_count")),
            "version": F.when(F.col("video_id") % 7 == 0, F.lit(None)).otherwise(F.col("version")),
        }
    )
    repeated = damaged.filter("video_id % 11 = 0")
    return audit.table_violations(damaged.unionByName(repeated))


@query
def stale_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    flagged = gate.flag_stale(m.shard_feed(spark, sf), slice_width=HOUR)
    return flagged.select("offset", "video_id", "counter_shard_id", "version", "stale")


# --- deduplication and aggregation ------------------------------------------------------------


def counted(spark: SparkSession, sf: str) -> DataFrame:
    return horizon_dedup(m.view_events(spark, sf))


@query
def horizon_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    return counted(spark, sf).select("event_id", "video_id", "counter_shard_id", us("counted_at", "counted_us"))


@query
def horizon_dedup_hot_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Five ids hold all rows; cells are coarse, so that expiries fall among many arrivals."""
    hot = m.requests(spark, sf).select(F.col("idempotency_key").alias("event_id"), "accepted_at")
    kept = horizon_dedup(hot, 3 * DAY, keys=["event_id"], cells_per_horizon=8)
    return kept.select("event_id", us("counted_at", "counted_us"))


@query
def shard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.shard_counts(counted(spark, sf))


@query
def latest_shard(spark: SparkSession, sf: str) -> DataFrame:
    return counts.latest_shards(m.shard_feed(spark, sf))


@query
def video_totals(spark: SparkSession, sf: str) -> DataFrame:
    return counts.video_totals(counts.shard_counts(counted(spark, sf)))


@query
def unique_events_full_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return m.first_arrivals(spark, sf).groupBy("video_id").agg(F.count("*").alias("unique_events"))


@query
def late_events_counted(spark: SparkSession, sf: str) -> DataFrame:
    late = m.view_events(spark, sf).filter(F.col("occurred_at") < F.col("accepted_at") - F.lit(fixed.DEDUP_HORIZON))
    return counts.video_totals(counts.shard_counts(horizon_dedup(late)))


@query
def snapshot_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    return counts.snapshots_per_tick(counted(spark, sf)).select(
        "video_id", "counter_shard_id", "count", "version", us("emitted_at", "emitted_us")
    )


@query
def total_snapshot_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    totals = counts.snapshots_per_tick(counted(spark, sf), keys=("video_id",), value="view_count")
    return totals.select("video_id", "view_count", "version", us("emitted_at", "emitted_us"))


@query
def replay_invariance(spark: SparkSession, sf: str) -> DataFrame:
    return counts.video_totals(counts.latest_shards(m.shard_feed(spark, sf)))


@query
def accepted_view_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Access log to totals: admission, validation, identity, deduplication, counting."""
    admitted = ingest.admitted(ingest.view_mutations(m.raw_requests(spark, sf)))
    accepted = ingest.with_reason(admitted).filter("reason is null")
    kept = horizon_dedup(ingest.to_events(accepted, m.SECRET))
    return counts.video_totals(counts.shard_counts(kept))


@query
def counter_metrics(spark: SparkSession, sf: str) -> DataFrame:
    raw = m.raw_requests(spark, sf)
    admitted = ingest.with_reason(ingest.admitted(ingest.view_mutations(raw)))
    return metrics.collect(
        metrics.request_counters(admitted),
        metrics.dedup_counters(m.view_events(spark, sf), counted(spark, sf)),
        metrics.shard_snapshot_counters(gate.flag_stale(m.shard_feed(spark, sf), slice_width=HOUR)),
        metrics.total_snapshot_counters(m.total_log(spark, sf)),
        metrics.sink_counters(m.total_feed(spark, sf)),
        metrics.rebuild_counters(gate.absent_rows(*m.rebuild_requests(spark, sf), order="event_id")),
        metrics.projection_counters(gate.flag_applied(m.clean_changes(spark, sf), slice_width=HOUR)),
    )


# --- reads, rebuild ---------------------------------------------------------------------------


@query
def resolve_counts(spark: SparkSession, sf: str) -> DataFrame:
    ids = m.requests(spark, sf).select(F.explode(F.array(F.col("user_id"), F.col("user_id") * 2 - 1)).alias("video_id"))
    table = m.user_counters(spark, sf).filter("video_id % 2 = 1")
    return reads.resolve_counts(ids, m.user_projection(spark, sf), table)


@query
def resolve_counts_lost_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The projection's files go between planning and reading: the table answers."""
    ids = m.requests(spark, sf).select(F.explode(F.array(F.col("user_id"), F.col("user_id") * 2 - 1)).alias("video_id"))
    table = m.user_counters(spark, sf).filter("video_id % 2 = 1")
    folder = Folder(spark, fresh_folder(spark, "projection"))
    folder.publish(m.user_projection(spark, sf), "lost")
    projection = spark.read.parquet(f"{folder.path}/lost")
    folder.remove("lost")
    return reads.resolve_counts(ids, reads.survived(lambda: projection, ids), table)


@query
def projection_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Lost projection: re-read table plus pending changes, through the same gate."""
    pending = m.total_feed(spark, sf).filter(m.pending_video())
    pending = pending.select("offset", "video_id", F.col("view_count").alias("count"), "version")
    reread = cdc.reread(m.stored_counters(spark, sf)).withColumn("offset", F.lit(-1).cast("bigint"))
    nothing = spark.createDataFrame([], contracts.PROJECTION)
    return gate.merge_projection(nothing, pending.unionByName(reread.drop("op")))


@query
def projection_lag_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.projection_lag(m.user_counters(spark, sf), m.user_projection(spark, sf))
