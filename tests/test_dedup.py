from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evertally.operators.dedup import horizon_dedup

EPOCH = datetime(2026, 1, 1, tzinfo=timezone.utc)
ROW = "event_id STRING, video_id BIGINT, counter_shard_id INT, accepted_at TIMESTAMP"


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def greedy(times, horizon):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > horizon:
            kept.append(t)
    return kept


def run(spark, arrivals, horizon, **options):
    """arrivals: (id, second) pairs; result: id → kept seconds."""
    rows = [(i, 1, 0, at(t)) for i, t in arrivals]
    result = horizon_dedup(spark.createDataFrame(rows, ROW), timedelta(seconds=horizon), **options)
    kept = {}
    for r in result.collect():
        second = (r["counted_at"].astimezone(timezone.utc) - EPOCH).total_seconds()
        kept.setdefault(r["event_id"], []).append(int(second))
    return {i: sorted(v) for i, v in kept.items()}


def expected(arrivals, horizon):
    ids = {i for i, _ in arrivals}
    return {i: greedy([t for j, t in arrivals if j == i], horizon) for i in ids}


def test_duplicates_inside_the_horizon(spark):
    assert run(spark, [("a", 0), ("a", 1), ("b", 2)], 604800) == {"a": [0], "b": [2]}


def test_the_horizon_is_closed(spark):
    assert run(spark, [("a", 0), ("a", 10), ("b", 0), ("b", 11)], 10) == {"a": [0], "b": [0, 11]}


def test_expired_id_counts_again(spark):
    day = 86400
    assert run(spark, [("a", 0), ("a", 8 * day)], 7 * day) == {"a": [0, 8 * day]}


def test_duplicate_does_not_extend_the_horizon(spark):
    assert run(spark, [("a", 0), ("a", 6), ("a", 12)], 10) == {"a": [0, 12]}


def test_horizon_must_be_positive(spark):
    with pytest.raises(ValueError):
        run(spark, [("a", 0)], 0)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    arrivals=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), min_size=1, max_size=80),
    horizon=st.integers(1, 30),
    cells=st.integers(1, 40),
)
def test_equals_brute_force(spark, arrivals, horizon, cells):
    assert run(spark, arrivals, horizon, cells_per_horizon=cells) == expected(arrivals, horizon)


def test_hot_id_with_a_third_of_all_rows(spark):
    arrivals = [("hot", t) for t in range(0, 3000)] + [(f"id{n}", n % 500) for n in range(6000)]
    assert run(spark, arrivals, 700, cells_per_horizon=3) == expected(arrivals, 700)


def test_short_spans_one_after_the_other(spark):
    horizon = 20
    arrivals = [(i, (t * 7 + ord(i)) % 51) for i in "abcdef" for t in range(ord(i) % 7, 45)]
    rows = lambda part: spark.createDataFrame([(i, 1, 0, at(t)) for i, t in part], ROW)
    reach = timedelta(seconds=horizon)
    counted = None
    for start in range(0, 51, 10):
        part = rows([a for a in arrivals if start <= a[1] < start + 10])
        fresh = horizon_dedup(part, reach, already_counted=counted)
        counted = fresh if counted is None else counted.union(fresh)
    kept = {}
    for r in counted.collect():
        second_of = int((r["counted_at"].astimezone(timezone.utc) - EPOCH).total_seconds())
        kept.setdefault(r["event_id"], []).append(second_of)
    assert {i: sorted(v) for i, v in kept.items()} == expected(arrivals, horizon)


@pytest.mark.parametrize("cut", [1, 17, 30, 59])
def test_continues_from_what_was_counted(spark, cut):
    arrivals = [(i, (t * 7 + ord(i)) % 61) for i in "abcd" for t in range(40)]
    rows = lambda part: spark.createDataFrame([(i, 1, 0, at(t)) for i, t in part], ROW)
    horizon = timedelta(seconds=9)
    first = horizon_dedup(rows([a for a in arrivals if a[1] < cut]), horizon, cells_per_horizon=2)
    second = horizon_dedup(
        rows([a for a in arrivals if a[1] >= cut]), horizon, cells_per_horizon=2, already_counted=first
    )
    kept = {}
    for r in first.union(second).collect():
        second_of = int((r["counted_at"].astimezone(timezone.utc) - EPOCH).total_seconds())
        kept.setdefault(r["event_id"], []).append(second_of)
    assert {i: sorted(v) for i, v in kept.items()} == expected(arrivals, 9)


def test_old_occurrence_does_not_matter(spark):
    # deduplication reads the arrival only; a six-year-old occurrence counts
    rows = spark.createDataFrame(
        [("a", 1, 0, at(0), datetime(2020, 1, 1))], ROW + ", occurred_at TIMESTAMP"
    )
    assert horizon_dedup(rows).count() == 1


def test_the_source_is_read_once(spark):
    """Lookups of stuck cells, which these hot ids need, work on what the first pass has written."""
    reads = spark.sparkContext.accumulator(0)

    def seen(value):
        reads.add(1)
        return value

    arrivals = [(i, t) for i in "abc" for t in range(0, 400)]
    rows = spark.createDataFrame([(i, 1, 0, at(t)) for i, t in arrivals], ROW)
    rows = rows.withColumn("event_id", F.udf(seen)("event_id"))
    kept = horizon_dedup(rows, timedelta(seconds=45), cells_per_horizon=2)
    assert kept.count() == len(greedy(range(400), 45)) * 3
    assert reads.value == len(arrivals)
