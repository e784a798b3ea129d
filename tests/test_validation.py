from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evertally.functions import validation
from evertally.operators import ingest

NOW = datetime(2026, 1, 1)
GOOD = (123, "user@example.com", "retry_1", NOW - timedelta(seconds=1))
SCHEMA = "video_id BIGINT, email STRING, idempotency_key STRING, occurred_at TIMESTAMP"


def reasons(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    as_of = F.lit(NOW)
    return [r["reason"] for r in ingest.with_reason(frame, email="email", as_of=as_of).collect()]


def changed(position, value):
    row = list(GOOD)
    row[position] = value
    return tuple(row)


def test_good_requests(spark):
    rows = [
        GOOD,
        changed(3, None),
        changed(3, NOW + timedelta(minutes=5)),
        changed(3, NOW - timedelta(days=3650)),
        changed(1, "x" * 242 + "@example.com"),
        changed(2, "k" * 128),
    ]
    assert reasons(spark, rows) == [None] * len(rows)


@pytest.mark.parametrize(
    "position, value, reason",
    [
        (0, 0, "video"),
        (0, -1, "video"),
        (0, None, "video"),
        (1, None, "identity"),
        (1, " ", "identity"),
        (1, "invalid", "identity"),
        (1, "User@Example.COM", "identity"),
        (1, " user@example.com", "identity"),
        (1, "user@example.com\n", "identity"),
        (1, "x" * 243 + "@example.com", "identity"),
        (2, None, "identity"),
        (2, "", "identity"),
        (2, "bad key", "identity"),
        (2, "key\n", "identity"),
        (2, "k" * 129, "identity"),
        (3, NOW - timedelta(days=3651), "occurrence"),
        (3, NOW + timedelta(minutes=6), "occurrence"),
        (3, NOW + timedelta(minutes=5, microseconds=1), "occurrence"),
    ],
)
def test_each_rule_rejects_alone(spark, position, value, reason):
    assert reasons(spark, [changed(position, value)]) == [reason]


def gateway(spark, **fields):
    row = {
        "method": "POST",
        "path": "/api/videos/123/views",
        "email": "user@example.com",
        "authenticated_email": "attacker@example.com",
        "idempotency_key": "key",
        "request_id": "req-1",
        **fields,
    }
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{name} STRING" for name in row))
    return [r.asDict() for r in ingest.admitted(frame).collect()]


def test_spoofed_identity_is_replaced(spark):
    [row] = gateway(spark, email=" User@Example.COM ")
    assert row["authenticated_email"] == "user@example.com"
    assert "email" not in row
    assert row["request_id"] == "req-1"


def test_read_needs_no_email(spark):
    [row] = gateway(spark, method="GET", path="/api/videos/123", email=None, idempotency_key=None)
    assert row["authenticated_email"] is None


@pytest.mark.parametrize(
    "fields",
    [
        {"email": None},
        {"email": "not-an-email"},
        {"email": " " * 240 + "user@example.com"},  # the limit applies before trimming
        {"idempotency_key": None},
        {"idempotency_key": "bad key"},
        {"path": "/api/videos/123/views/", "email": None},
    ],
)
def test_malformed_mutation_is_rejected(spark, fields):
    assert gateway(spark, **fields) == []


def test_bad_request_id_is_regenerated(spark):
    [row] = gateway(spark, request_id="bad id!")
    assert len(row["request_id"]) == 36


@pytest.mark.parametrize(
    "method, path, expected",
    [
        ("POST", "/api/videos/1/views", True),
        ("POST", "/api/videos/1/views/", True),
        ("POST", "/api/videos/a b/views", True),
        ("POST", "/api/videos//views", False),
        ("POST", "/api/videos/1/2/views", False),
        ("POST", "/api/videos/1/views\n", False),
        ("POST", "/x/api/videos/1/views", False),
        ("GET", "/api/videos/1/views", False),
        (None, None, False),
    ],
)
def test_mutation_route(spark, method, path, expected):
    frame = spark.createDataFrame([(method, path)], "m STRING, p STRING")
    assert frame.select(validation.is_mutation(F.col("m"), F.col("p"))).first()[0] is expected
