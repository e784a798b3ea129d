import json
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from evertally.functions import contracts
from evertally.operators import counts
from evertally.operators.dedup import horizon_dedup
from evertally.plans import stream_queries
from evertally.sources import topics
from evertally.sources.dated_log import DatedLog
from evertally.sources.folders import BatchLog, Folder, Table, file_stream
from evertally.sources.sink_log import SinkLog
from evertally.streaming import counting, listener, ticks
from evertally.streaming.counters import Counters
from evertally.streaming.dedup import horizon_dedup_stream
from evertally.streaming.projection import Projection, project_changes

SECRET = "test-only-secret-with-at-least-32-characters"
NOW = datetime(2026, 1, 1)
EVENT = "event_id STRING, video_id BIGINT, counter_shard_id INT, accepted_at TIMESTAMP"
DAY = 86400


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


class Counting:
    """All counting stages over one folder; every `deliver` restarts every query."""

    def __init__(self, spark, folder, stateful=False):
        self.spark, self.folder = spark, folder
        self.events = BatchLog(spark, f"{folder}/events", EVENT)
        self.counted = counting.counted_log(spark, f"{folder}/counted")
        self.shards = BatchLog(spark, f"{folder}/shards", counting.SHARD_SNAPSHOTS)
        self.totals = BatchLog(spark, f"{folder}/totals", counting.TOTAL_SNAPSHOTS)
        self.table = Table(spark, f"{folder}/table", contracts.VIDEO_COUNTER)
        self.latest = Table(spark, f"{folder}/latest", counting.LATEST_SHARDS, counts.SHARD)
        self.count = counting.count_events_stateful if stateful else counting.count_events
        self.batch = 0

    def checkpoint(self, name):
        return f"{self.folder}/checkpoints/{name}"

    def deliver(self, *events):
        rows = [(i, 123, 0, NOW + timedelta(seconds=s)) for i, s in events]
        self.events.append(self.spark.createDataFrame(rows, EVENT), self.batch)
        self.batch += 1
        run(self.count(self.events.stream(), self.counted, self.checkpoint("counted")))
        run(counting.emit_shard_snapshots(self.counted.stream(), self.shards, self.checkpoint("shards")))
        self.total()
        row = self.table.read().first()
        return row["view_count"] if row else None

    def total(self):
        run(counting.emit_totals(self.shards.stream(), self.totals, self.table, self.latest, self.checkpoint("totals")))


@pytest.mark.parametrize("stateful", [False, True])
def test_counts_survive_restarts(spark, folder, stateful):
    job = Counting(spark, folder, stateful)
    assert job.deliver(("A", 0), ("A", 1), ("B", 2)) == 2
    assert job.deliver(("A", 3), ("C", 4)) == 3
    assert job.deliver(("A", 6 * DAY), ("B", 7 * DAY + 2)) == 3
    assert job.deliver(("A", 8 * DAY)) == 4
    emitted = [r["view_count"] for r in job.totals.read().orderBy("batch_id").collect()]
    assert emitted == [2, 3, 4]  # nothing is emitted for a batch of duplicates


def test_expired_ids_leave_the_state(spark, folder):
    """Forty days of ids, restarted every four days: the state holds the last nine, the result is that of a batch."""
    events, counted = BatchLog(spark, f"{folder}/events", EVENT), BatchLog(spark, f"{folder}/counted", counting.COUNTED)
    rows = [(f"{day}-{i}", 123, 0, NOW + timedelta(days=day, seconds=i)) for day in range(40) for i in range(20)]
    rows += [(i, v, s, t + timedelta(days=d)) for i, v, s, t in rows[::3] for d in (1, 7, 8)]  # repeats: two inside
    rows += [(i, v, s, t - timedelta(hours=20)) for i, v, s, t in rows[1:800:7]]  # earlier arrivals, some delivered late
    state = []
    for part in range(12):
        during = [r for r in rows if part * 4 <= (r[3] - NOW).days < part * 4 + 4 or (part == 0 and r[3] < NOW)]
        events.append(spark.createDataFrame(during, EVENT), part)
        query = counting.count_events_stateful(events.stream(), counted, f"{folder}/checkpoint")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    names = ["event_id", "counted_at"]
    batch = horizon_dedup(spark.createDataFrame(rows, EVENT))
    assert sorted(counted.read().select(names).collect()) == sorted(batch.select(names).collect())
    # a value and a timer (kept twice: by id and by time) per id of some twelve days, not of forty
    assert max(state) < 3 * 20 * 14 and state[-1] < state[5]


def test_ids_share_calls_and_state(spark, folder):
    """Ids of a bucket are one group: few state rows for many ids, each judged alone, with the same names apart."""
    events = BatchLog(spark, f"{folder}/events", EVENT)
    rows = [(f"{i}\n\"{i % 7}", 1 + i % 2, i % 3, NOW + timedelta(seconds=i)) for i in range(300)]
    rows += [(f"{i}\n\"{i % 7}", 2 - i % 2, i % 3, NOW + timedelta(seconds=i)) for i in range(0, 300, 5)]  # other videos
    rows += [(i, v, s, t + timedelta(days=d)) for i, v, s, t in rows[::2] for d in (1, 7, 8, 15, 16, 24)]
    names, found = ["event_id", "video_id", "counter_shard_id", "counted_at"], []
    for part in range(2):
        during = [r for r in rows if (r[3] < NOW + timedelta(days=12)) == (part == 0)]
        events.append(spark.createDataFrame(during, EVENT), part)
        stream = horizon_dedup_stream(events.stream(), buckets=4).writeStream.outputMode("update")
        stream = stream.option("checkpointLocation", f"{folder}/checkpoint")
        stream = stream.foreachBatch(lambda batch, _: found.extend(batch.select(names).collect()))
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4
    assert sorted(found) == sorted(horizon_dedup(spark.createDataFrame(rows, EVENT)).select(names).collect())


def test_snapshots_are_gated_by_version(spark, folder):
    job = Counting(spark, folder)

    def snapshot(batch, *values):
        rows = spark.createDataFrame([(123, s, n, n) for s, n in values], "video_id BIGINT, counter_shard_id INT, count BIGINT, version BIGINT")
        job.shards.append(rows.withColumn("emitted_at", F.current_timestamp()), batch)
        job.total()
        return job.table.read().first()["view_count"], job.totals.read().count()

    assert snapshot(0, (0, 100), (1, 120), (2, 80)) == (300, 1)
    assert snapshot(1, (0, 110)) == (310, 2)
    assert snapshot(2, (0, 110)) == (310, 2)
    assert snapshot(3, (0, 100)) == (310, 2)


def test_a_repeated_micro_batch_changes_nothing(spark, folder):
    job = Counting(spark, folder)
    assert job.deliver(("A", 0), ("B", 0)) == 2
    # the commit of the last batch is lost: the query runs it again
    for name in ("counted", "shards", "totals"):
        Folder(spark, f"{job.checkpoint(name)}/commits").remove("0")
        Folder(spark, f"{job.checkpoint(name)}/commits").remove(".0.crc")
    assert job.deliver(("C", 1)) == 3
    assert job.counted.read().count() == 3


def test_requests_to_routed_events(spark, folder):
    rows = [
        ("POST", "/api/videos/5/views", 5, " User@Example.COM ", "x@y.z", "k1", "r", None, NOW),
        ("POST", "/api/videos/5/views", 5, "bad", None, "k1", "r", None, NOW),
        ("POST", "/api/videos/0/views", 0, "a@b.c", None, "k1", "r", None, NOW),
        ("GET", "/api/videos/5/views", 5, None, None, None, None, None, NOW),
    ]
    spark.createDataFrame(rows, contracts.VIEW_REQUEST).write.parquet(f"{folder}/requests")
    sent = BatchLog(spark, f"{folder}/sent", "topic STRING, key STRING, value BINARY")
    run(counting.publish_events(topics.file_requests(spark, f"{folder}/requests"), SECRET, sent, f"{folder}/c1"))
    [record] = sent.read().collect()
    assert record["topic"] == "video-view-events" and record["key"].startswith("5:")

    raw = sent.read().selectExpr("topic", "0 AS partition", "0L AS offset", "key", "value", "current_timestamp() AS arrival")
    broken = raw.withColumn("value", F.encode(F.lit("broken"), "UTF-8"))
    raw.unionByName(broken).write.parquet(f"{folder}/records")
    routed = BatchLog(spark, f"{folder}/routed", counting.ROUTED)
    run(counting.route_events(topics.file_records(spark, f"{folder}/records"), routed, f"{folder}/c2"))
    assert counting.valid_events(routed.read()).count() == 1
    [letter] = routed.read().filter("topic = 'video-view-events.DLT'").collect()
    assert bytes(letter["value"]) == b"broken" and letter["reason"] == "undecodable"


def broken_off(spark, checkpoint, sink):
    """The state after a crash in which files of batch 0 were written but not committed."""
    for folder in (f"{checkpoint}/commits", f"{sink}/_spark_metadata"):
        for name in ("0", ".0.crc"):
            Folder(spark, folder).remove(name)


def test_the_file_sink_commits_a_batch_once(spark, folder):
    """A crash between writing and committing: the files of the broken batch are never read, its repetition is."""
    rows = [("POST", "/api/videos/5/views", 5, f"u{i}@b.c", f"u{i}@b.c", "k1", "r", None, NOW) for i in range(7)]
    spark.createDataFrame(rows, contracts.VIEW_REQUEST).repartition(3).write.parquet(f"{folder}/requests")
    sent = SinkLog(spark, f"{folder}/sent", "topic STRING, key STRING, value BINARY")

    def publish(checkpoint):
        run(counting.publish_events(topics.file_requests(spark, f"{folder}/requests"), SECRET, sent, checkpoint))
        return sent.read().count()

    assert sent.read().count() == 0
    assert publish(f"{folder}/c1") == 7
    [first] = sent.runs()
    broken_off(spark, f"{folder}/c1", f"{folder}/sent/run={first}")
    assert publish(f"{folder}/c1") == 7 and sent.runs() == [first]
    written = [n for n in Folder(spark, f"{folder}/sent/run={first}").names() if n.endswith(".parquet")]
    assert len(written) > len(sent.read().inputFiles())  # what was left behind is there, and not read
    assert publish(f"{folder}/c2") == 14  # a new checkpoint is a new run: its batch 0 is not taken for the old one
    assert len(sent.runs()) == 2
    assert sorted(r["n"] for r in sent.read().groupBy("run").agg(F.count("*").alias("n")).collect()) == [7, 7]
    counted = sent.stream(first).writeStream.format("memory").queryName("sent_once").option("checkpointLocation", f"{folder}/c3")
    run(counted)
    assert spark.table("sent_once").count() == 7


def test_routes_through_the_file_sink(spark, folder):
    rows = []
    for offset, shard in enumerate((0, 127, 128, -1)):
        value = {"videoId": 1, "counterShardId": shard, "count": 3, "version": 3, "emittedAt": 1}
        rows.append(("counter-shard-snapshots", 0, offset, "1", json.dumps(value).encode(), NOW))
    spark.createDataFrame(rows, contracts.RAW_RECORD).write.parquet(f"{folder}/records")
    routed = counting.routed_log(spark, f"{folder}/routed", counting.ROUTED_SHARDS)
    for _ in range(2):
        run(counting.route_shards(topics.file_records(spark, f"{folder}/records"), routed, f"{folder}/c"))
    assert {r["offset"]: r["reason"] for r in routed.read().collect()} == {0: None, 1: None, 2: "key", 3: "contract"}
    assert routed.read().count() == 4 and routed.read().filter("topic = 'counter-shard-snapshots.DLT'").count() == 2


def test_failed_publishing_is_counted(spark, folder):
    rows = [("POST", "/api/videos/5/views", 5, "a@b.c", "a@b.c", "k1", "r", None, NOW)]
    spark.createDataFrame(rows, contracts.VIEW_REQUEST).write.parquet(f"{folder}/requests")

    class Broken(BatchLog):
        def append(self, *args, **options):
            raise OSError("no space left")

    watch = listener.CounterListener()
    spark.streams.addListener(watch)
    try:
        sent = Broken(spark, f"{folder}/sent", "topic STRING, key STRING, value BINARY")
        with pytest.raises(StreamingQueryException):
            run(counting.publish_events(topics.file_requests(spark, f"{folder}/requests"), SECRET, sent, f"{folder}/c"))
        for _ in range(50):
            if watch.counters["view_event_publish_failures_total"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert watch.counters["view_event_publish_failures_total"] == 1


def test_totals_of_a_topic_are_persisted_and_bad_ones_quarantined(spark, folder):
    def total(video, count, version):
        return json.dumps({"videoId": video, "viewCount": count, "version": version, "emittedAt": 1}).encode()

    values = [("1", total(1, 1000, 1000)), ("1", total(1, 900, 900)), ("1", total(1, 5, 4)), ("2", total(1, 1, 1)), ("1", None)]
    rows = [("video-total-snapshots", 3, n, k, v, NOW) for n, (k, v) in enumerate(values)]
    spark.createDataFrame(rows, contracts.RAW_RECORD).write.parquet(f"{folder}/records")
    table = Table(spark, f"{folder}/table", contracts.VIDEO_COUNTER)
    dead = BatchLog(spark, f"{folder}/dead", contracts.RAW_RECORD + ", reason STRING")
    records = topics.file_records(spark, f"{folder}/records")
    run(counting.persist_totals(records, table, dead, f"{folder}/checkpoint"))
    assert [(r["video_id"], r["view_count"]) for r in table.read().collect()] == [(1, 1000)]
    letters = dead.read().orderBy("offset").collect()
    assert [(r["offset"], r["reason"]) for r in letters] == [(2, "contract"), (3, "key"), (4, "tombstone")]


# --- projection -------------------------------------------------------------------------------


def projection_over(spark, folder, counters):
    source = Table(spark, f"{folder}/table", contracts.VIDEO_COUNTER)
    rows = [(v, n, n, NOW) for v, n in counters]
    source.replace(spark.createDataFrame(rows, contracts.VIDEO_COUNTER))
    target = Table(spark, f"{folder}/projection", contracts.PROJECTION, ["key"])
    return Projection(target, source, Table(spark, f"{folder}/ledger", contracts.REBUILD_LEDGER))


def changes(spark, *rows):
    return spark.createDataFrame([(v, n, n, i) for i, (v, n) in enumerate(rows)], "video_id BIGINT, count BIGINT, version BIGINT, offset BIGINT")


def stored(projection):
    return {r["video_id"]: r["count"] for r in projection.table.read().collect()}


def lose(spark, projection, folder):
    Folder(spark, folder).remove("projection")
    assert stored(projection) == {}


def test_lost_projection_is_rebuilt_once(spark, folder):
    projection = projection_over(spark, folder, [(n, n) for n in range(1, 21)])
    projection.recover()
    everything = stored(projection)
    assert everything == {n: n for n in range(1, 21)}
    assert projection.ledger.read().count() == 1

    lose(spark, projection, folder)
    for _ in range(5):
        projection.recover()
    assert stored(projection) == everything
    assert projection.ledger.read().count() == 2
    entry = projection.ledger.read().first()
    assert entry["type"] == "execute-snapshot"
    assert json.loads(entry["data"]) == {"type": "incremental", "data-collections": ["public.video_counter"]}


def test_newer_change_wins_over_the_rebuild(spark, folder):
    projection = projection_over(spark, folder, [(n, 1) for n in range(12000, 14000)])
    projection.apply(changes(spark, (13999, 999)))
    found = stored(projection)
    assert found.pop(13999) == 999
    assert set(found.values()) == {1} and len(found) == 1999


def test_crash_before_the_mark_repeats_the_rebuild_without_a_second_request(spark, folder):
    projection = projection_over(spark, folder, [(1, 5)])
    generation = projection.pending_generation()
    assert projection.request(generation) and not projection.request(generation)
    assert projection.pending_generation() == generation
    projection.recover()
    assert stored(projection) == {1: 5}
    assert projection.ledger.read().count() == 1
    assert projection.pending_generation() is None


def test_rebuild_goes_on_from_its_last_chunk(spark, folder, monkeypatch):
    """Chunk by chunk beside live changes; killed in the third, restarted, and no finished chunk is read twice."""
    counters = {video: 10 * video for video in (1, 2, 3, 7, 8, 21, 22, 23, 40)}
    projection = projection_over(spark, folder, counters.items())
    projection.chunk_ids = 5
    read, chunk, upsert = [], Projection._chunk, Table.upsert
    monkeypatch.setattr(Projection, "_chunk", lambda self, first: read.append(first) or chunk(self, first))
    projection.apply(changes(spark, (8, 500)))  # newer than its row, which comes in the next chunk
    assert stored(projection) == {1: 10, 2: 20, 3: 30, 8: 500}
    projection.apply(changes(spark, (1, 11), (2, 1)))  # one newer, one older than the rebuilt row
    assert stored(projection) == {1: 11, 2: 20, 3: 30, 7: 70, 8: 500}

    def killed(self, rows):
        raise OSError("killed")

    monkeypatch.setattr(Table, "upsert", killed)
    with pytest.raises(OSError):
        projection.apply(changes(spark, (50, 5)))
    monkeypatch.setattr(Table, "upsert", upsert)
    assert projection.pending_generation() is not None
    again = projection_over(spark, folder, counters.items())
    again.chunk_ids = 5
    again.apply(changes(spark, (50, 5)))
    again.recover()
    assert stored(again) == {**counters, 1: 11, 8: 500, 50: 5}
    assert read == [1, 7, 21, 21, 40]  # the third chunk broke off before it was stored
    again.recover()
    assert len(read) == 5 and again.pending_generation() is None and again.ledger.read().count() == 1


def test_old_generation_does_not_hide_a_newer_loss(spark, folder):
    projection = projection_over(spark, folder, [(1, 5)])
    old = projection.pending_generation()
    Folder(spark, f"{folder}/projection").remove("_generation")
    new = projection.pending_generation()
    projection.mark_requested(old)
    assert projection.pending_generation() == new != old


def test_unusable_change_stops_the_feed_until_it_is_fixed(spark, folder):
    projection = projection_over(spark, folder, [])
    feed = BatchLog(spark, f"{folder}/feed", "offset BIGINT, value BINARY")

    def deliver(batch, *values):
        feed.append(spark.createDataFrame(list(values), "offset BIGINT, value BINARY"), batch)

    def good(offset, video, count):
        after = {"video_id": video, "view_count": count, "version": count}
        return offset, json.dumps({"op": "u", "after": after}).encode()

    watch = listener.CounterListener()
    spark.streams.addListener(watch)
    try:
        deliver(0, good(0, 1, 10), (1, None), good(2, 1, 9))
        run(project_changes(feed.stream(), projection, f"{folder}/checkpoint"))
        assert stored(projection) == {1: 10}

        deliver(1, good(3, 1, 11), (4, b'{"op":"d"}'))
        for _ in range(2):  # a restart meets the same change again
            with pytest.raises(StreamingQueryException):
                run(project_changes(feed.stream(), projection, f"{folder}/checkpoint"))
        assert stored(projection) == {1: 10}
    finally:
        spark.streams.removeListener(watch)
    assert watch.counters["counter_cdc_failures"] >= 1


def test_observed_rows_are_added_up(spark, folder):
    log = BatchLog(spark, f"{folder}/log", "n INT")
    watch = listener.CounterListener()
    spark.streams.addListener(watch)
    try:
        for batch in range(2):
            log.append(spark.range(10 + batch).selectExpr("CAST(id AS INT) AS n"), batch)
            rows = listener.observed(log.stream(), "view_events_published_total")
            run(rows.writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint"))
        for _ in range(50):
            if watch.counters["view_events_published_total"] == 21:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert watch.counters["view_events_published_total"] == 21


# --- pieces -----------------------------------------------------------------------------------


def test_totals_take_in_any_shard(spark, folder):
    job = Counting(spark, folder)
    batches = [[(1, 0, 10), (1, 128, 5), (2, 200, 7)], [(1, 200, 7), (1, 0, 9), (3, -1, 1)], [(1, 128, 6), (2, 0, 1)]]
    schema = "video_id BIGINT, counter_shard_id INT, count BIGINT"
    for number, rows in enumerate(batches):
        frame = counts.as_snapshot(spark.createDataFrame(rows, schema), "count")
        job.shards.append(frame, number)
        job.total()
    everything = spark.createDataFrame([r for rows in batches for r in rows], schema)
    expected = {r["video_id"]: r["view_count"] for r in counts.video_totals(counts.latest_shards(everything)).collect()}
    assert {r["video_id"]: r["view_count"] for r in job.table.read().collect()} == expected == {1: 23, 2: 8, 3: 1}


def test_shards_out_of_range_are_quarantined(spark, folder):
    rows = []
    for offset, shard in enumerate((0, 127, 128, -1)):
        value = {"videoId": 1, "counterShardId": shard, "count": 3, "version": 3, "emittedAt": 1}
        rows.append(("counter-shard-snapshots", 0, offset, "1", json.dumps(value).encode(), NOW))
    spark.createDataFrame(rows, contracts.RAW_RECORD).write.parquet(f"{folder}/records")
    routed = BatchLog(spark, f"{folder}/routed", counting.ROUTED_SHARDS)
    run(counting.route_shards(topics.file_records(spark, f"{folder}/records"), routed, f"{folder}/c"))
    found = {r["offset"]: r["reason"] for r in routed.read().collect()}
    assert found == {0: None, 1: None, 2: "key", 3: "contract"}
    assert routed.read().filter("topic = 'counter-shard-snapshots.DLT'").count() == 2


def test_a_new_checkpoint_loses_nothing(spark, folder):
    """Batch numbers start over; what is there already stays, and what is new arrives."""
    table = Table(spark, f"{folder}/table", contracts.VIDEO_COUNTER)
    dead = BatchLog(spark, f"{folder}/dead", contracts.RAW_RECORD + ", reason STRING")
    for part, (count, broken) in enumerate(((1000, b"x"), (5000, b"y"), (5000, b"y"))):
        good = json.dumps({"videoId": 1, "viewCount": count, "version": count, "emittedAt": 1}).encode()
        rows = [("video-total-snapshots", 0, n, "1", v, NOW) for n, v in enumerate((good, broken))]
        spark.createDataFrame(rows, contracts.RAW_RECORD).write.parquet(f"{folder}/records{part}")
        stream = topics.file_records(spark, f"{folder}/records{part}")
        run(counting.persist_totals(stream, table, dead, f"{folder}/checkpoints/{part}"))
        assert table.read().first()["view_count"] == count
    assert sorted(bytes(r["value"]) for r in dead.read().collect()) == [b"x", b"y", b"y"]

    job = Counting(spark, f"{folder}/job")
    assert job.deliver(("A", 0), ("B", 0)) == 2
    job.checkpoint = lambda name: f"{folder}/job/other/{name}"
    assert job.deliver(("A", 1), ("C", 1)) == 3
    assert sorted(r["event_id"] for r in job.counted.read().collect()) == ["A", "B", "C"]


def test_batch_folders_appear_whole_and_once(spark, folder):
    log = BatchLog(spark, f"{folder}/log", "n INT")
    assert log.read().isEmpty()
    assert log.append(spark.createDataFrame([(1,)], "n INT"), 0)
    assert not log.append(spark.createDataFrame([(2,)], "n INT"), 0)
    Folder(spark, f"{folder}/log").publish(spark.createDataFrame([(9,)], "n INT"), ".writing-batch_id=7")
    assert [r["n"] for r in log.read().collect()] == [1]
    assert log.append(spark.createDataFrame([(3,)], "n INT"), 0, run="other")
    assert [r["n"] for r in log.apart_from("direct", 0).collect()] == [3]
    assert sorted(r["n"] for r in log.apart_from("direct", 1).collect()) == [1, 3]


def dated(spark, folder, keep=timedelta(0)):
    log = DatedLog(spark, f"{folder}/log", "n INT, arrival TIMESTAMP", "arrival", keep)
    for batch in range(3):
        rows = [(10 * batch + n, NOW + timedelta(days=batch + n, hours=23)) for n in range(3)]
        assert log.append(spark.createDataFrame(rows, "n INT, arrival TIMESTAMP"), batch)
    return log


def test_a_dated_log_opens_only_the_days_it_needs(spark, folder):
    log = dated(spark, folder)
    assert [(day - NOW.date()).days for day in log.days()] == [0, 1, 2, 3, 4]
    since = (NOW + timedelta(days=3)).date()
    late = log.apart_from("direct", 2, since=since)
    assert sorted(r["n"] for r in late.collect()) == [12]
    assert all(f"day={since}" in file or f"day={since + timedelta(days=1)}" in file for file in late.inputFiles())
    assert re.search(r"PartitionFilters: \[[^\]]*day", late._jdf.queryExecution().executedPlan().toString())
    assert not log.append(spark.createDataFrame([(99, NOW)], "n INT, arrival TIMESTAMP"), 1)
    assert sorted(r["n"] for r in log.read().collect()) == [0, 1, 2, 10, 11, 12, 20, 21, 22]


def test_a_dated_batch_that_broke_off_is_completed(spark, folder, monkeypatch):
    log = DatedLog(spark, f"{folder}/log", "n INT, arrival TIMESTAMP", "arrival")
    rows = spark.createDataFrame([(n, NOW + timedelta(days=n)) for n in range(3)], "n INT, arrival TIMESTAMP")
    move, moved = Folder._move, []

    def breaks_off(self, source, name):
        if len(moved) == 2:
            raise OSError("lost")
        moved.append(name)
        move(self, source, name)

    monkeypatch.setattr(Folder, "_move", breaks_off)
    with pytest.raises(OSError):
        log.append(rows, 0)
    monkeypatch.undo()
    assert log.read().count() == 2
    assert log.append(rows, 0) and not log.append(rows, 0)
    assert sorted(r["n"] for r in log.read().collect()) == [0, 1, 2]


def test_retention_hides_days_first_and_removes_them_later(spark, folder):
    log = dated(spark, folder, keep=timedelta(hours=1))
    before = log.read()
    assert log.expire_days(NOW + timedelta(days=16)) == []  # hidden for less than an hour: nothing goes
    assert sorted(r["n"] for r in log.read().collect()) == [2, 11, 12, 20, 21, 22]
    assert before.count() == 9  # a reader from before goes on
    assert log.expire_days(NOW + timedelta(days=15)) == []  # a bound never goes back
    assert log.read().count() == 6
    log.keep = timedelta(0)
    assert [(day - NOW.date()).days for day in log.expire_days(NOW + timedelta(days=16))] == [0, 1]
    assert sorted(r["n"] for r in log.read().collect()) == [2, 11, 12, 20, 21, 22]
    assert log.append(spark.createDataFrame([(30, NOW + timedelta(days=9))], "n INT, arrival TIMESTAMP"), 3)
    assert log.read().count() == 7


def test_counting_reads_the_days_of_the_horizon(spark, folder, monkeypatch):
    """The days before the horizon are not listed, and dropping them changes nothing."""
    job = Counting(spark, folder)
    for day in range(0, 40, 4):
        job.deliver((f"{day}", day * DAY), ("A", day * DAY + 5))
    asked = []
    read = DatedLog.read
    monkeypatch.setattr(DatedLog, "read", lambda self, since=None: asked.append(since) or read(self, since))
    assert job.deliver(("A", 40 * DAY), ("36", 41 * DAY)) == 16
    assert asked[0] == (NOW + timedelta(days=33)).date()
    job.counted.keep = timedelta(0)
    assert len(job.counted.expire_days(NOW + timedelta(days=41), timedelta(days=8))) == 9
    assert job.deliver(("A", 42 * DAY), ("B", 42 * DAY)) == 17


def test_expired_batches_are_dropped_whole(spark, folder):
    log = BatchLog(spark, f"{folder}/log", "n INT, arrival TIMESTAMP")
    for batch in range(4):
        rows = [(n, NOW + timedelta(days=batch + n)) for n in range(2)]
        log.append(spark.createDataFrame(rows, "n INT, arrival TIMESTAMP"), batch)
    assert log.expire("arrival", NOW + timedelta(days=2)) == [("direct", 0)]
    assert log.read().count() == 6


def test_table_versions(spark, folder):
    schema = "video_id BIGINT, version BIGINT"
    table = Table(spark, f"{folder}/table", schema, compact_every=3, keep=timedelta(0))

    def rows(*values):
        return spark.createDataFrame(list(values), schema)

    table.replace(rows((1, 5), (2, 5)))
    for version in range(6, 10):
        table.upsert(rows((1, version), (version, 1)))
        assert {r["video_id"]: r["version"] for r in table.read().collect()} == {1: version, 2: 5, **{v: 1 for v in range(6, version + 1)}}
    # the fourth version after the first made a whole one, and the older ones went
    assert [kind for _, kind in table.versions()] == ["whole", "rows"]
    assert [number for number, _ in table.versions()] == [4, 5]


def test_gates_open_the_buckets_of_their_batch_only(spark, folder):
    schema = "video_id BIGINT, view_count BIGINT, version BIGINT"
    table = Table(spark, f"{folder}/table", schema)
    table.replace(spark.range(500).selectExpr("id AS video_id", "id AS view_count", "5L AS version"))
    assert len(table.read().inputFiles()) > 40
    batch = spark.createDataFrame([(7, 9), (8, 3), (None, 1)], "video_id INT, version BIGINT")  # narrower than the table's key
    known = table.known(batch)
    assert len(known.inputFiles()) <= 3 and known.columns == ["video_id", "version"]
    assert {r["video_id"]: r["version"] for r in known.collect() if r["video_id"] in (7, 8)} == {7: 5, 8: 5}
    # later versions count too, whichever bucket they would be in
    table.upsert(spark.createDataFrame([(7, 1, 9), (1000, 1, 1)], schema))
    known = {r["video_id"]: r["version"] for r in table.known(batch).collect()}
    assert known[7] == 9 and known[8] == 5 and known[1000] == 1
    assert table.read().count() == 501
    assert table.read(batch, ["view_count"]).filter("video_id = 7").first().asDict() == {"video_id": 7, "view_count": 1, "version": 9}
    # a version without rows, and one from before there were buckets
    empty = Table(spark, f"{folder}/empty", schema)
    empty.replace(spark.createDataFrame([], schema))
    assert empty.known(batch).isEmpty()
    plain = Table(spark, f"{folder}/plain", schema)
    plain.folder.publish(spark.createDataFrame([(7, 1, 2)], schema), "v=0-whole")
    assert [tuple(r) for r in plain.known(batch).collect()] == [(7, 2)]


def test_ticks_emit_changed_keys_until_stopped(spark, folder):
    job = Counting(spark, folder)
    job.events.append(spark.createDataFrame([("A", 123, 0, NOW), ("B", 123, 1, NOW)], EVENT), 0)
    counted = counting.count_events(job.events.stream(), job.counted, job.checkpoint("counted"))
    query = counting.every_tick(counted, timedelta(milliseconds=200)).start()
    try:
        query.processAllAvailable()
        job.events.append(spark.createDataFrame([("A", 123, 0, NOW), ("C", 123, 1, NOW)], EVENT), 1)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["event_id"] for r in job.counted.read().collect()) == ["A", "B", "C"]
    with pytest.raises(ValueError):
        counting.every_tick(counted, timedelta(0))


def test_emitted_totals_are_read_back_from_their_topic(spark, folder):
    snapshots = counts.as_snapshot(spark.createDataFrame([(1, 5), (2, 7)], "video_id BIGINT, view_count BIGINT"), "view_count")
    sent = counting.topic_records(snapshots, contracts.TOTAL_SNAPSHOT, "video-total-snapshots")
    raw = sent.selectExpr("topic", "0 AS partition", "0L AS offset", "key", "value", "current_timestamp() AS arrival")
    raw.write.parquet(f"{folder}/records")
    table = Table(spark, f"{folder}/table", contracts.VIDEO_COUNTER)
    dead = BatchLog(spark, f"{folder}/dead", contracts.RAW_RECORD + ", reason STRING")
    run(counting.persist_totals(topics.file_records(spark, f"{folder}/records"), table, dead, f"{folder}/checkpoint"))
    assert {r["video_id"]: r["view_count"] for r in table.read().collect()} == {1: 5, 2: 7}
    assert dead.read().isEmpty()


def test_kafka_options():
    options = topics.kafka_options("broker:9092", "video-total-snapshots", 50)
    assert options["startingOffsets"] == "earliest"
    assert options["kafka.isolation.level"] == "read_committed"
    assert options["maxOffsetsPerTrigger"] == "50"
    for bad in (("", "t", None), ("s", " ", None), ("s", "t", 0)):
        with pytest.raises(ValueError):
            topics.kafka_options(*bad)


def test_counters_take_a_batch_once(spark, folder):
    counters = Counters(spark, f"{folder}/counters")
    assert counters.read().count() == 0
    counters.add("a", "r1", 0, {"x": 5, "y": 1})
    counters.add("a", "r1", 0, {"x": 5, "y": 1})  # repeated
    counters.add("a", "r1", 1, {"x": 2})
    counters.add("a", "r1", 1, {"x": 2, "y": 3})  # broke off between the two
    counters.add("a", "r2", 0, {"x": 10})  # another checkpoint
    counters.add("b", "r1", 0, {"x": 100})
    assert {r["metric"]: r["value"] for r in counters.read().collect()} == {"x": 117, "y": 4}


def test_repeated_batches_are_not_counted_twice(spark, folder):
    job = Counting(spark, folder)
    counters = Counters(spark, f"{folder}/counters")
    job.count = lambda *args: counting.count_events(*args, counters=counters)
    assert job.deliver(("A", 0), ("A", 1), ("B", 0)) == 2
    for name in ("0", ".0.crc"):
        Folder(spark, f"{job.checkpoint('counted')}/commits").remove(name)
    assert job.deliver(("C", 1), ("A", 2)) == 3
    found = {r["metric"]: r["value"] for r in counters.read().collect()}
    assert found == {"unique_view_events_total": 3, "duplicate_view_events_total": 2}


def test_a_tick_over_two_batches_gives_one_snapshot(spark, folder):
    """Changes wait for the end of their tick, over batches and restarts; quiet keys are not emitted."""
    counted = BatchLog(spark, f"{folder}/counted", counting.COUNTED)
    snapshots = BatchLog(spark, f"{folder}/shards", counting.SHARD_SNAPSHOTS)
    minute = timedelta(minutes=1)

    def deliver(batch, *rows):
        events = [(f"{batch}-{n}", 1, shard, NOW + timedelta(seconds=s)) for n, (shard, s) in enumerate(rows)]
        counted.append(spark.createDataFrame(events, counting.COUNTED), batch)
        run(ticks.emit_ticks(counted.stream(), snapshots, f"{folder}/checkpoint", minute, timedelta(seconds=5)))
        found = snapshots.read().collect()
        return sorted((r["counter_shard_id"], r["count"], (r["emitted_at"] - NOW).total_seconds()) for r in found)

    assert deliver(0, (0, 1), (0, 2), (1, 3)) == []
    assert deliver(1, (0, 30), (1, 64)) == []  # the watermark is at 59 seconds
    first = [(0, 3, 60.0), (1, 1, 60.0)]
    assert deliver(2, (1, 70), (1, 71)) == first
    assert deliver(3, (0, 130)) == sorted([*first, (1, 4, 120.0)])
    late = sorted([*first, (1, 4, 120.0), (1, 5, 60.0), (0, 4, 180.0)])
    assert deliver(4, (1, 58), (0, 200)) == late  # late for its tick, but counted
    with pytest.raises(ValueError):
        ticks.emit_ticks(counted.stream(), snapshots, f"{folder}/c", timedelta(microseconds=1500))


def test_counting_reads_a_micro_batch_once(spark, folder):
    """A micro-batch has no statistics and drops no columns: each reading of it would make all identities again."""
    rows = [(f"{i % 60}", 1, 0, NOW + timedelta(days=i // 20)) for i in range(200)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{folder}/events")
    counted, counters, made = counting.counted_log(spark, f"{folder}/counted"), Counters(spark, f"{folder}/c"), spark.sparkContext.accumulator(0)

    def identities(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    events = file_stream(spark, f"{folder}/events", EVENT).mapInArrow(identities, EVENT)
    run(counting.count_events(events, counted, f"{folder}/checkpoint", counters=counters))
    names = ["event_id", "video_id", "counter_shard_id", "counted_at"]
    batch = horizon_dedup(spark.createDataFrame(rows, EVENT))
    assert sorted(counted.read().select(names).collect()) == sorted(batch.select(names).collect())
    values = {row["metric"]: row["value"] for row in counters.read().collect()}
    unique = counted.read().count()
    assert values == {"unique_view_events_total": unique, "duplicate_view_events_total": 200 - unique}
    assert made.value == 200


def test_a_replay_computes_its_rows_once(spark, folder):
    days = ("2024-01-08 23:59:59.999999", "2024-01-09", "2024-01-16", "2024-01-17", "2024-01-24", "2024-01-25", "2024-02-01")
    rows = spark.createDataFrame([(i, day) for i, day in enumerate([*days, None])], "i INT, at STRING")
    made, seen = spark.sparkContext.accumulator(0), []

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    rows = rows.withColumn("at", F.col("at").cast("timestamp")).mapInArrow(counted, "i INT, at TIMESTAMP")

    def build(stream):
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        return writer.foreachBatch(lambda batch, _: seen.append(sorted(row["i"] for row in batch.collect())))

    stream_queries.replay(rows, "at", f"{folder}/log", build)
    assert seen == [[0], [1, 2], [3, 4], [5, 6]] and made.value == 8
