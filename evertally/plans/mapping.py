"""Counting inputs derived from the whole `events` table.

Defects (malformed values, spoofed identities, out-of-order and repeated records) are spread over the
rows by their id so that every rule has rows that break it; no row is left out anywhere.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally.fixed_values import REBUILD_SIGNAL, VIEWS_TOPIC
from evertally.functions import contracts
from evertally.functions.identity import projection_key
from evertally.operators import cdc, counts, ingest

SECRET = "test-only-secret-with-at-least-32-characters"  # fixed value
LARGE_VERSION = 9007199254740993  # fixed value: first integer past 2^53 that a double cannot hold
MIDPOINT = "2024-01-16 00:00:00"


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def every(n: int, remainder: int = 0) -> Column:
    return F.col("source_id") % n == remainder


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(events(spark, sf_dir))


def requests_of(rows: DataFrame) -> DataFrame:
    """Well-formed requests; one user, video and event type make one identity."""
    at = F.col("ts").cast("timestamp")
    days_ago = F.make_dt_interval((F.col("event_id") % 4000).cast("int"))
    return rows.select(
        F.col("event_id").alias("source_id"),
        "user_id",
        (F.get_json_object("props", "$.k").cast("bigint") % 10 + 1).alias("video_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("event_type").alias("idempotency_key"),
        F.when(F.col("event_id") % 3 != 0, at - days_ago).alias("occurred_at"),
        at.alias("accepted_at"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_requests_of(events(spark, sf_dir))


def raw_requests_of(rows: DataFrame) -> DataFrame:
    """Access-log form of the requests with malformed and spoofed values among them."""
    user = F.col("user_id").cast("string")
    video = F.when(every(41), 0).otherwise(F.col("video_id"))
    plain_path = F.concat(F.lit("/api/videos/"), video.cast("string"), F.lit("/views"))
    return requests_of(rows).select(
        "source_id",
        F.when(every(7), "GET").otherwise("POST").alias("method"),
        F.when(every(37), "/api/videos//views")
        .when(every(31, 1), F.concat(plain_path, F.lit("\n")))
        .when(every(5), F.concat(plain_path, F.lit("/")))
        .otherwise(plain_path)
        .alias("path"),
        video.alias("video_id"),
        F.when(every(11), F.concat(F.lit(" \tUser"), user, F.lit("@Example.COM\n ")))
        .when(every(13, 1), F.lit("not-an-email"))
        .when(every(17, 2), F.lit(None))
        .when(every(19, 3), F.concat(F.repeat(F.lit("x"), 243), F.lit("@example.com")))
        .when(every(19, 4), F.concat(F.repeat(F.lit("x"), 242), F.lit("@example.com")))
        .otherwise(F.col("email"))
        .alias("email"),
        F.when(every(3), "attacker@example.com").alias("authenticated_email"),
        F.when(every(23), "bad key")
        .when(every(29, 1), "")
        .when(every(31, 2), F.lit(None))
        .otherwise(F.col("idempotency_key"))
        .alias("idempotency_key"),
        F.when(every(2), F.concat(F.lit("req-"), F.col("source_id").cast("string")))
        .when(every(9), "bad id!")
        .alias("request_id"),
        F.when(every(43, 1), F.col("accepted_at") + F.lit(timedelta(minutes=5)))
        .when(every(43, 2), F.col("accepted_at") + F.lit(timedelta(minutes=5, microseconds=1)))
        .when(every(43, 3), F.col("accepted_at") - F.lit(timedelta(days=3650)))
        .when(every(43, 4), F.col("accepted_at") - F.lit(timedelta(days=3650, microseconds=1)))
        .otherwise(F.col("occurred_at"))
        .alias("occurred_at"),
        "accepted_at",
    )


def view_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_events_of(events(spark, sf_dir))


def view_events_of(rows: DataFrame) -> DataFrame:
    return ingest.to_events(requests_of(rows), SECRET, email="email", keep=("source_id",))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records_of(events(spark, sf_dir))


def event_records_of(rows: DataFrame) -> DataFrame:
    """View events as topic records: some tombstones, truncated values and foreign keys."""
    value = contracts.encode(contracts.VIEW_EVENT).cast("binary")
    key = contracts.shard_key(F.col("video_id"), F.col("counter_shard_id"))
    return view_events_of(rows).select(
        F.lit(VIEWS_TOPIC).alias("topic"),
        (F.col("source_id") % 24).cast("int").alias("partition"),
        F.col("source_id").alias("offset"),
        F.when(every(89), F.concat(key, F.lit("0"))).otherwise(key).alias("key"),
        F.when(every(83), F.lit(None))
        .when(every(97), F.substring(value, 1, 40))
        .otherwise(value)
        .alias("value"),
        F.col("accepted_at").alias("arrival"),
    )


def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identity once, at its first arrival: deduplication with an unlimited horizon."""
    first = view_events(spark, sf_dir).groupBy("event_id", "video_id", "counter_shard_id")
    return first.agg(F.min("accepted_at").alias("counted_at"))


def _number(*parts: Column) -> Column:
    """60 bits of an MD5, the same in any engine; used as an arbitrary but fixed order."""
    text = F.concat_ws("/", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _replayed(log: DataFrame, *identity: str) -> DataFrame:
    """The log in a scrambled arrival order, a third of it delivered twice."""
    columns = [F.col(c) for c in identity]
    copies = F.when(_number(*columns) % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = log.withColumn("_copy", F.explode(copies)).withColumn("offset", _number(*columns, F.col("_copy")))
    delay = F.make_dt_interval(secs=(F.col("offset") % 432000).cast("decimal(18,6)"))
    return repeated.withColumn("arrival", F.col("emitted_at") + delay).drop("_copy")


def shard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.snapshots_per_tick(first_arrivals(spark, sf_dir), interval=timedelta(days=1))


def shard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(shard_log(spark, sf_dir), "video_id", "counter_shard_id", "version")


def total_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.snapshots_per_tick(
        first_arrivals(spark, sf_dir), keys=("video_id",), value="view_count", interval=timedelta(hours=1)
    )


def total_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_feed_of(total_log(spark, sf_dir))


def total_feed_of(log: DataFrame) -> DataFrame:
    return _replayed(log, "video_id", "version")


def snapshot_records(feed: DataFrame, contract: contracts.Contract, topic: str) -> DataFrame:
    """Snapshots as topic records, some with a damaged version, a foreign key or no value."""
    damaged = feed.withColumn("version", F.col("version") - F.when(F.col("offset") % 97 == 0, 1).otherwise(0))
    key, value = contracts.snapshot_record(contract)
    return damaged.select(
        F.lit(topic).alias("topic"),
        (F.col("offset") % 24).cast("int").alias("partition"),
        "offset",
        F.when(F.col("offset") % 89 == 0, F.concat(F.lit("0"), key)).otherwise(key).alias("key"),
        F.when(F.col("offset") % 83 != 0, value).alias("value"),
        "arrival",
    )


def counter_table(totals: DataFrame) -> DataFrame:
    """Counter table rows of a totals log."""
    latest = totals.groupBy("video_id").agg(F.max("view_count").alias("view_count"))
    return latest.select(
        "video_id", "view_count", F.col("view_count").alias("version"), F.current_timestamp().alias("updated_at")
    )


def stored_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_counters_of(total_log(spark, sf_dir))


def stored_counters_of(log: DataFrame) -> DataFrame:
    """A counter table that is ahead of the feed for every third video and lacks every fifth."""
    table = counter_table(before_midpoint(log)).filter("video_id % 5 > 0")
    ahead = F.when(F.col("video_id") % 3 == 0, 1_000_000).otherwise(0)
    return table.withColumns({c: F.col(c) + ahead for c in ("view_count", "version")})


def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection of the stored counters; a tie with the feed, told apart by its count, for every seventh video."""
    rows = stored_counters(spark, sf_dir)
    last = counter_table(total_log(spark, sf_dir)).select("video_id", F.col("version").alias("_last"))
    tie = F.col("video_id") % 7 == 0
    version = F.when(tie, F.col("_last")).otherwise(F.col("version")) + F.lit(LARGE_VERSION)
    return rows.join(last, "video_id").select(
        projection_key(F.col("video_id")).alias("key"),
        "video_id",
        F.when(tie, -1).otherwise(F.col("view_count")).alias("count"),
        version.alias("version"),
    )


def pending_video() -> Column:
    """The videos that still have changes to come: not every fourth."""
    return F.col("video_id") % 4 > 0


def before_midpoint(log: DataFrame) -> DataFrame:
    return log.filter(F.col("emitted_at") < F.lit(MIDPOINT).cast("timestamp"))


def rebuild_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ledger that knows every second user's generation, and a request for a generation per event."""
    generation = F.concat(F.lit("gen-"), F.col("user_id").cast("string")).alias("id")
    kind = F.lit(REBUILD_SIGNAL).alias("type")
    rows = events(spark, sf_dir).select(generation, kind, F.col("props").alias("data"), "event_id", "user_id")
    known = rows.filter("user_id % 2 = 0").select("id", "type", F.lit("earlier").alias("data")).distinct()
    return known, rows


def user_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wider counter table: one counter per user."""
    per_user = requests(spark, sf_dir).groupBy(F.col("user_id").alias("video_id"))
    totals = per_user.agg(F.count("*").alias("view_count"))
    return totals.withColumn("version", F.col("view_count"))


def user_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection of the user counters: parts of it missing, ahead, or not a number."""
    rows = user_counters(spark, sf_dir).filter("video_id % 3 > 0")
    ahead = F.col("view_count") + F.when(F.col("video_id") % 4 == 0, 1).otherwise(0)
    return rows.select(
        projection_key(F.col("video_id")).alias("key"),
        "video_id",
        F.when(F.col("video_id") % 5 == 0, "broken").otherwise(ahead.cast("string")).alias("count"),
        ahead.alias("version"),
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change envelopes of the totals, bare or wrapped, some of them unusable."""
    feed = total_feed(spark, sf_dir).withColumn("version", F.col("version") + F.lit(LARGE_VERSION))
    offset = F.col("offset")
    usable = F.substring(F.lit("cur"), (offset % 3 + 1).cast("int"), F.lit(1))
    op = F.when(offset % 83 == 0, "d").otherwise(usable)
    json = cdc.envelope(op, offset % 2 == 0)
    value = (
        F.when(offset % 79 == 0, F.regexp_replace(json, r'"version":\d+', '"version":1.5'))
        .when(offset % 73 == 0, F.regexp_replace(json, r'"video_id":\d+', '"video_id":0'))
        .when(offset % 89 == 0, F.lit(None))
        .when(offset % 97 == 0, F.substring(json, 1, 20))
        .otherwise(json)
    )
    return feed.select("offset", "arrival", value.cast("binary").alias("value"))


def usable_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_change_feed_of(total_feed(spark, sf_dir))


def usable_change_feed_of(feed: DataFrame) -> DataFrame:
    """Change envelopes without damage: what a strict projection can take."""
    json = cdc.envelope(F.lit("u"), F.col("offset") % 2 == 0)
    return feed.select("offset", "arrival", "emitted_at", "video_id", json.cast("binary").alias("value"))


def clean_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable changes only, as (offset, arrival, video_id, count, version)."""
    return total_feed(spark, sf_dir).select(
        "offset",
        "arrival",
        "video_id",
        F.col("view_count").alias("count"),
        (F.col("version") + F.lit(LARGE_VERSION)).alias("version"),
        "emitted_at",
    )
