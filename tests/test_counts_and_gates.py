import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from conftest import SMALL
from evertally.functions import contracts
from evertally.operators import audit, counts, gate, metrics, retention

NOW = datetime(2026, 1, 1)
BIG = 9007199254740993
SNAPSHOT = "video_id BIGINT, counter_shard_id INT, count BIGINT, version BIGINT, arrival TIMESTAMP, offset BIGINT"


def snapshots(spark, values):
    rows = [(v, s, n, n, NOW + timedelta(seconds=i), i) for i, (v, s, n) in enumerate(values)]
    return spark.createDataFrame(rows, SNAPSHOT)


def totals_of(spark, values):
    result = counts.video_totals(counts.latest_shards(snapshots(spark, values)))
    return {r["video_id"]: r["view_count"] for r in result.collect()}


def test_shards_add_up_and_newer_replaces_older(spark):
    first = [(1, 0, 100), (1, 1, 120), (1, 2, 80)]
    assert totals_of(spark, first) == {1: 300}
    later = [*first, (1, 0, 110)]
    assert totals_of(spark, later) == {1: 310}
    assert totals_of(spark, [*later, (1, 0, 110), (1, 0, 100)]) == {1: 310}


def test_first_snapshot_of_zero_gives_a_total_of_zero(spark):
    assert totals_of(spark, [(5, 0, 0)]) == {5: 0}


def test_order_and_repetition_do_not_matter(spark):
    log = [(v, s, n) for v in range(3) for s in range(4) for n in range(1, 20, 3)]
    shuffled = log * 2
    random.Random(7).shuffle(shuffled)
    assert totals_of(spark, shuffled) == totals_of(spark, log)


def test_overflow_is_an_error(spark):
    with pytest.raises(ArithmeticException):
        totals_of(spark, [(1, 0, 2**63 - 1), (1, 1, 1)])


def test_stale_flags_match_arrival_order(spark):
    values = [(1, 0, 100), (1, 1, 120), (1, 0, 110), (1, 0, 110), (1, 0, 100), (2, 0, 100), (1, 0, 111)]
    flagged = gate.flag_stale(snapshots(spark, values)).orderBy("offset").collect()
    assert [r["stale"] for r in flagged] == [False, False, False, True, True, False, False]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_stale_flags_equal_brute_force(spark, width):
    pick = random.Random(width)
    values = [(pick.randint(1, 2), pick.randint(0, 1), pick.randint(0, 40)) for _ in range(300)]
    best, expected = {}, []
    for video, shard, version in values:
        expected.append(version <= best.get((video, shard), -1))
        best[video, shard] = max(version, best.get((video, shard), -1))
    flagged = gate.flag_stale(snapshots(spark, values), slice_width=timedelta(seconds=width))
    assert [r["stale"] for r in flagged.orderBy("offset").collect()] == expected


def test_snapshots_per_tick_coalesce(spark):
    seconds = [0.1, 0.2, 0.999999, 1.0, 5.5]
    rows = [(1, 0, NOW + timedelta(seconds=s)) for s in seconds]
    counted = spark.createDataFrame(rows, "video_id BIGINT, counter_shard_id INT, counted_at TIMESTAMP")
    result = counts.snapshots_per_tick(counted).orderBy("emitted_at").collect()
    assert [(r["count"], r["version"], (r["emitted_at"] - NOW).total_seconds()) for r in result] == [
        (3, 3, 1.0),
        (4, 4, 2.0),
        (5, 5, 6.0),
    ]


def counter(spark, rows):
    return spark.createDataFrame([(v, n, n, NOW) for v, n in rows], contracts.VIDEO_COUNTER)


def upsert(spark, table, rows):
    return gate.merge_counter(table, spark.createDataFrame(rows, "video_id BIGINT, view_count BIGINT"))


@pytest.mark.parametrize("values, last", [([1000, 1000, 900], 1000), ([BIG, BIG - 1, BIG, BIG + 1], BIG + 1)])
def test_upsert_gate(spark, values, last):
    table = counter(spark, [])
    for value in values:
        table = upsert(spark, table, [(1, value)])
    row = table.first()
    assert (row["view_count"], row["version"]) == (last, last)
    assert table.count() == 1


def test_refused_write_keeps_updated_at(spark):
    merged = {r["video_id"]: r for r in upsert(spark, counter(spark, [(1, 10), (2, 10)]), [(1, 10), (2, 11)]).collect()}
    assert merged[1]["updated_at"] == NOW
    assert merged[2]["updated_at"] > NOW


def test_only_newer_totals_pass(spark):
    totals = spark.createDataFrame([(1, 10), (2, 11), (2, 9), (3, 0)], "video_id BIGINT, view_count BIGINT")
    fresh = gate.newer_totals(totals, counter(spark, [(1, 10), (2, 10)]))
    assert sorted(r["video_id"] for r in fresh.collect()) == [2, 3]


def projection(spark, rows):
    changes = spark.createDataFrame(rows, "video_id BIGINT, count BIGINT, version BIGINT, offset BIGINT")
    return changes


def test_projection_replay_and_shuffled_writes(spark):
    base = spark.createDataFrame([], contracts.PROJECTION)
    table = gate.merge_projection(base, projection(spark, [(10003, 10, 10, 0), (10003, 10, 10, 1), (10003, 9, 9, 2)]))
    assert tuple(table.first()) == ("video:10003:views", 10003, 10, 10)

    versions = list(range(BIG, BIG + 200))
    random.Random(3).shuffle(versions)
    rows = [(1, v, v, n) for n, v in enumerate([*versions, 1])]
    assert gate.merge_projection(base, projection(spark, rows)).first()["version"] == BIG + 199


def test_equal_versions_keep_the_first(spark):
    base = spark.createDataFrame([], contracts.PROJECTION)
    table = gate.merge_projection(base, projection(spark, [(1, 100, 5, 7), (1, 200, 5, 3)]))
    assert table.first()["count"] == 200
    again = gate.merge_projection(table, projection(spark, [(1, 300, 5, 0)]))
    assert again.first()["count"] == 200


def test_applied_flags(spark):
    rows = spark.createDataFrame(
        [(1, 10, 10, NOW, 0), (1, 10, 10, NOW, 1), (1, 9, 9, NOW, 2), (1, 11, 11, NOW, 3)],
        "video_id BIGINT, count BIGINT, version BIGINT, arrival TIMESTAMP, offset BIGINT",
    )
    flagged = gate.flag_applied(rows)
    assert [r["applied"] for r in flagged.orderBy("offset").collect()] == [True, False, False, True]
    assert metrics.projection_counters(flagged).first().asDict() == {"counter_cdc_processed": 2, "counter_cdc_stale": 2}


def test_compaction_keeps_the_last_record(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 0, "z")], "key STRING, offset BIGINT, value STRING")
    assert sorted(map(tuple, gate.compact(rows).collect())) == [("a", 3, None), ("b", 0, "z")]


def test_ledger_inserts_once(spark):
    schema = contracts.REBUILD_LEDGER
    ledger = spark.createDataFrame([("g1", "t", "old")], schema)
    rows = spark.createDataFrame([("g1", "t", "new"), ("g2", "t", "new"), ("g2", "t", "new")], schema)
    assert sorted(map(tuple, gate.insert_if_absent(ledger, rows).collect())) == [("g1", "t", "old"), ("g2", "t", "new")]


def test_table_audit(spark):
    rows = [(1, 5, 5), (2, 5, 4), (3, -1, -1), (4, None, None), (5, 1, 1), (5, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(rows, "video_id BIGINT, view_count BIGINT, version BIGINT")
    assert sorted(map(tuple, audit.table_violations(table).collect()), key=str) == sorted(
        [
            (2, "version_not_count"),
            (3, "negative_count"),
            (4, "null_value"),
            (5, "duplicate_id"),
            (None, "null_id"),
        ],
        key=str,
    )


def test_projection_lag(spark):
    table = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "video_id BIGINT, version BIGINT")
    projected = spark.createDataFrame([(1, 5), (2, 5), (4, 1)], "video_id BIGINT, version BIGINT")
    assert sorted(map(tuple, audit.projection_lag(table, projected).collect())) == [(2, 6, 5), (3, 7, None), (4, None, 1)]


def test_retention_is_fourteen_days(spark):
    rows = spark.createDataFrame([(n, NOW - timedelta(days=n)) for n in range(20)], "n INT, arrival TIMESTAMP")
    kept = retention.retained(retention.with_arrival_date(rows), F.lit(NOW))
    assert sorted(r["n"] for r in kept.collect()) == list(range(15))


def test_rows_without_key_or_arrival_come_back_as_not_stale(spark):
    at = datetime(2026, 1, 1)
    rows = [(1, 0, 5, at, 0), (1, 0, 4, at, 1), (None, 0, 9, at, 2), (None, 0, 1, at, 3), (1, 0, 1, None, 4), (1, 0, None, at, 5), (1, None, 0, at, 6)]
    schema = "video_id BIGINT, counter_shard_id INT, version BIGINT, arrival TIMESTAMP, offset BIGINT"
    flagged = gate.flag_stale(spark.createDataFrame(rows, schema))
    assert {r["offset"]: r["stale"] for r in flagged.collect()} == {n: n == 1 for n in range(7)}


@pytest.mark.parametrize("name", ["version_gated_upsert", "projection_apply", "projection_rebuild"])
def test_registered_gates_need_both_sides(spark, monkeypatch, name):
    """Without the stored side, or without the changes, the registered result is another one."""
    from evertally.plans import mapping, queries

    def result():
        return sorted(map(tuple, queries.QUERIES[name](spark, SMALL).collect()))

    whole = result()
    for part in ("stored_counters", "stored_projection", "total_feed", "clean_changes"):
        with monkeypatch.context() as patched:
            full = getattr(mapping, part)
            patched.setattr(mapping, part, lambda spark, sf, full=full: full(spark, sf).limit(0))
            used = {"version_gated_upsert": ("stored_counters", "total_feed"), "projection_rebuild": ("stored_counters", "total_feed")}
            if part in used.get(name, ("stored_projection", "clean_changes")):
                assert result() != whole, part


@pytest.mark.parametrize("width", [2, 1000])
def test_outcomes_start_from_what_is_stored(spark, width):
    pick = random.Random(width)
    best = {1: 25, 2: 0}
    values = [(pick.randint(1, 3), 0, pick.randint(0, 40)) for _ in range(200)]
    stored = spark.createDataFrame(list(best.items()), "video_id BIGINT, version BIGINT")
    expected = []
    for video, _, version in values:
        expected.append(version > best.get(video, -1))
        best[video] = max(version, best.get(video, -1))
    flagged = gate.flag_applied(snapshots(spark, values), slice_width=timedelta(seconds=width), projection=stored)
    assert [r["applied"] for r in flagged.orderBy("offset").collect()] == expected
