import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evertally.functions import contracts
from evertally.operators import split

ID, USER = "a" * 64, "b" * 64
EVENT = {
    "eventId": ID,
    "videoId": 123,
    "userHash": USER,
    "counterShardId": 0,
    "occurredAt": "2026-01-01T00:00:00.123456789Z",
    "acceptedAt": 1767225600.5,
}


def records(spark, *pairs, topic="t"):
    rows = [(topic, 3, n, key, value, None) for n, (key, value) in enumerate(pairs)]
    return spark.createDataFrame(rows, contracts.RAW_RECORD)


def event(**changes):
    fields = {**EVENT, **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not ...}).encode()


def reason_of(spark, value, key="123:0"):
    return split.checked_events(records(spark, (key, value))).first()


def test_instants_keep_nanoseconds(spark):
    row = reason_of(spark, event(acceptedAt=None).replace(b"null", b"1767225600.123456789"))
    assert row["reason"] is None
    assert row["occurred_at_epoch"] == row["accepted_at_epoch"] == Decimal("1767225600.123456789")
    assert row["occurred_at"].microsecond == 123456


@pytest.mark.parametrize(
    "text, epoch",
    [
        ("2026-01-01T00:00:00Z", "1767225600"),
        ("2026-01-01T01:00:00.5+01:00", "1767225600.5"),
        ("1969-12-31T23:59:59.5Z", "-0.5"),
        ("1767225600", "1767225600"),
        ("2026-01-01", None),
        ("2026-01-01T00:00:00", None),
        ("2026-13-01T00:00:00Z", None),
        ("soon", None),
    ],
)
def test_instant_texts(spark, text, epoch):
    row = reason_of(spark, event(occurredAt=text))
    if epoch is None:
        assert row["reason"] == "undecodable"
    else:
        assert row["reason"] is None and row["occurred_at_epoch"] == Decimal(epoch)


@pytest.mark.parametrize(
    "changes, key, reason",
    [
        ({}, "123:0", None),
        ({"counterShardId": ...}, "123:0", None),  # a missing number is 0
        ({"counterShardId": None}, "123:0", None),
        ({"videoId": "123"}, "123:0", None),  # numeric strings and floats are read as numbers
        ({"videoId": 123.9}, "123:0", None),
        ({"videoId": ...}, "0:0", "contract"),
        ({"videoId": True}, "1:0", "undecodable"),
        ({"videoId": "x"}, "123:0", "undecodable"),
        ({"videoId": 2**63}, "123:0", "undecodable"),
        ({"counterShardId": 2**31}, "123:0", "undecodable"),
        ({"counterShardId": -1}, "123:-1", "contract"),
        ({"eventId": ID.upper()}, "123:0", "contract"),
        ({"eventId": ID + "\n"}, "123:0", "contract"),
        ({"eventId": ...}, "123:0", "contract"),
        ({"userHash": "x"}, "123:0", "contract"),
        ({"occurredAt": None}, "123:0", "contract"),
        ({"acceptedAt": ...}, "123:0", "contract"),
        ({"extra": 1}, "123:0", "undecodable"),
        ({}, "123:1", "key"),
        ({}, None, "key"),
        ({"counterShardId": 128}, "123:128", "key"),
    ],
)
def test_event_reasons(spark, changes, key, reason):
    assert reason_of(spark, event(**changes), key)["reason"] == reason


def test_bad_bytes_are_quarantined_unchanged(spark):
    bad = [("123:0", b"broken"), ("123:0", b"\xff\xfe"), ("123:0", b"[1]"), ("123:0", b""), ("123:0", None)]
    checked = split.checked_events(records(spark, *bad, ("123:0", event()), topic="video-view-events"))
    letters = split.dead_letters(checked).orderBy("offset").collect()
    assert [(r["key"], None if r["value"] is None else bytes(r["value"])) for r in letters] == bad
    assert {(r["topic"], r["partition"]) for r in letters} == {("video-view-events.DLT", 3)}
    assert [r["reason"] for r in letters] == ["undecodable"] * 4 + ["tombstone"]
    assert split.valid(checked).count() == 1


@pytest.mark.parametrize(
    "value, reason",
    [
        ({"videoId": 1, "counterShardId": 2, "count": 5, "version": 5, "emittedAt": 1}, None),
        ({"videoId": 1, "counterShardId": 2, "count": 0, "version": 0, "emittedAt": 1}, None),
        ({"videoId": 1, "counterShardId": 2, "count": 5, "version": 4, "emittedAt": 1}, "contract"),
        ({"videoId": 1, "counterShardId": 2, "count": -1, "version": -1, "emittedAt": 1}, "contract"),
        ({"videoId": 1, "counterShardId": 128, "count": 5, "version": 5, "emittedAt": 1}, "key"),
        ({"videoId": 2, "counterShardId": 2, "count": 5, "version": 5, "emittedAt": 1}, "key"),
    ],
)
def test_shard_snapshots(spark, value, reason):
    checked = split.checked_shards(records(spark, ("1", json.dumps(value).encode())))
    assert checked.first()["reason"] == reason


@pytest.mark.parametrize(
    "value, reason",
    [
        ({"videoId": 1, "viewCount": 100, "version": 100, "emittedAt": 1}, None),
        ({"videoId": 1, "viewCount": 100, "version": 99, "emittedAt": 1}, "contract"),
        ({"videoId": 1, "viewCount": 100, "version": 100}, "contract"),
        ({"videoId": 2, "viewCount": 100, "version": 100, "emittedAt": 1}, "key"),
    ],
)
def test_total_snapshots(spark, value, reason):
    checked = split.checked_totals(records(spark, ("1", json.dumps(value).encode())))
    assert checked.first()["reason"] == reason


@pytest.mark.parametrize("text", [b'{"eventId":"x","videoId":1', b'{"eventId":"x"', event()[:-1], event()[:-20], event() + b"x", event() + event()])
def test_cut_records_are_undecodable_but_trailing_text_is_ignored(spark, text):
    expected = None if text.startswith(event()) else "undecodable"
    assert reason_of(spark, text)["reason"] == expected


def test_last_of_repeated_fields_wins(spark):
    text = event(videoId=5, occurredAt=1).replace(b"{", b'{"videoId": 9, ', 1)
    row = reason_of(spark, text, "5:0")
    assert (row["reason"], row["video_id"]) == (None, 5)


def test_encode_decode_round_trip(spark):
    rows = spark.createDataFrame([(ID, 9007199254740993, USER, 7)], "event_id STRING, video_id BIGINT, user_hash STRING, counter_shard_id INT")
    rows = rows.withColumns(
        {c: F.lit("2026-01-01 00:00:00.123456").cast("timestamp") for c in ("occurred_at", "accepted_at")}
    )
    record = rows.select(*contracts.event_record()).first()
    assert record["key"] == "9007199254740993:7"
    assert b'"occurredAt":1767225600.123456000' in bytes(record["value"])
    back = reason_of(spark, bytes(record["value"]), record["key"])
    assert back["reason"] is None
    assert [back[c] for c in rows.columns] == list(rows.first())
