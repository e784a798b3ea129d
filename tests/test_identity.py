import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from evertally.functions import identity

SECRET = "test-only-secret-with-at-least-32-characters"


def digest(message, secret=SECRET):
    return hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_event_id_is_stable_and_separates_its_parts(spark):
    rows = [
        ("user@example.com", 123, "A"),
        ("user@example.com", 123, "A"),
        ("user@example.com", 123, "B"),
        ("other@example.com", 123, "A"),
        ("user@example.com", 124, "A"),
    ]
    ids = values(
        spark, rows, "e STRING, v BIGINT, k STRING", identity.event_id(SECRET, F.col("e"), F.col("v"), F.col("k"))
    )
    assert ids[0] == ids[1]
    assert len(set(ids)) == 4
    assert ids[0][0] == digest("event:16:user@example.com:123:A")


def test_length_prefix_counts_utf16_units(spark):
    email = "\U0001f600@example.com"
    [(found,)] = values(
        spark,
        [(email, 1, "k")],
        "e STRING, v BIGINT, k STRING",
        identity.event_id(SECRET, F.col("e"), F.col("v"), F.col("k")),
    )
    assert found == digest(f"event:14:{email}:1:k")


def test_missing_part_gives_no_id(spark):
    rows = [(None, 1, "k"), ("a@b.c", None, "k"), ("a@b.c", 1, None)]
    found = values(
        spark, rows, "e STRING, v BIGINT, k STRING", identity.event_id(SECRET, F.col("e"), F.col("v"), F.col("k"))
    )
    assert found == [(None,)] * 3


@pytest.mark.parametrize("secret", [SECRET, "x" * 64, "y" * 65, "é" * 100])
def test_user_hash_equals_hmac(spark, secret):
    [(found,)] = values(spark, [("user@example.com",)], "e STRING", identity.user_hash(secret, F.col("e")))
    assert found == digest("user:user@example.com", secret)


@pytest.mark.parametrize("secret", [None, "", "weak", "x" * 31])
def test_weak_secret_is_refused(secret):
    with pytest.raises(ValueError):
        identity.user_hash(secret, None)


def test_all_shards_are_used(spark):
    ids = spark.range(10_000).select(
        identity.event_id(SECRET, F.lit("user@example.com"), F.lit(123), F.col("id").cast("string")).alias("id")
    )
    shards = [r[0] for r in ids.select(identity.shard_of(F.col("id"), 128)).collect()]
    assert set(shards) == set(range(128))


@pytest.mark.parametrize("shards", [1, 7, 128, 1000, 2**31 - 1])
def test_shard_is_an_unsigned_remainder(spark, shards):
    ids = [h + "0" * 48 for h in ("0" * 16, "f" * 16, "8000000000000000", "7fffffffffffffff", "0123456789abcdef")]
    found = values(spark, [(i,) for i in ids], "i STRING", identity.shard_of(F.col("i"), shards))
    assert [f[0] for f in found] == [int(i[:16], 16) % shards for i in ids]


def test_shard_count_must_be_positive():
    with pytest.raises(ValueError):
        identity.shard_of(None, 0)


def test_normalize_strips_controls_and_lowers(spark):
    found = values(
        spark,
        [(" User@Example.COM ",), ("\t\nA@B.C\x00",), (" a@b.c",), (None,)],
        "e STRING",
        identity.normalize_email(F.col("e")),
    )
    assert [f[0] for f in found] == ["user@example.com", "a@b.c", " a@b.c", ""]


def test_keys(spark):
    video, shard = identity.parse_shard_key(F.lit("123:45"))
    row = spark.range(1).select(
        identity.shard_key(F.lit(123), F.lit(45)), video, shard, identity.projection_key(F.lit(7), "p:")
    )
    assert tuple(row.first()) == ("123:45", 123, 45, "p:7:views")
    with pytest.raises(ValueError):
        identity.projection_key(F.lit(7), " ")
