"""Deterministic keyed identity, sharding and key columns (built-in functions only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.settings import not_blank, positive_count, strong_secret

_BLOCK = 64  # SHA-256 block size


def _binary(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column; both pads are literals made on the driver."""
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = _binary(bytes(b ^ 0x36 for b in key))
    outer_pad = _binary(bytes(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; Spark's own `length` counts code points.

    The two agree for ASCII, which therefore is not encoded again.
    """
    encoded = F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)
    return F.when(F.octet_length(text) > F.length(text), encoded).otherwise(F.length(text))


def trim_controls(text: Column) -> Column:
    """Strip every leading and trailing character up to U+0020, not only spaces."""
    return F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def normalize_email(email: Column) -> Column:
    return F.lower(trim_controls(F.coalesce(email, F.lit(""))))


def user_hash(secret: str, email: Column) -> Column:
    return hmac_sha256(strong_secret(secret), F.concat(F.lit("user:"), email))


def event_id(secret: str, email: Column, video_id: Column, idempotency_key: Column) -> Column:
    """The length prefix keeps `email:video:key` unambiguous."""
    message = F.concat_ws(
        ":",
        F.lit("event"),
        utf16_length(email).cast("string"),
        email,
        video_id.cast("string"),
        idempotency_key,
    )
    complete = email.isNotNull() & video_id.isNotNull() & idempotency_key.isNotNull()
    return F.when(complete, hmac_sha256(strong_secret(secret), message))


def shard_of(event_id: Column, shard_count: int = fixed.SHARD_COUNT) -> Column:
    """Unsigned first 64 bits of the hex id modulo the shard count.

    Split into two 32-bit halves so that everything stays in long arithmetic.
    """
    positive_count("shard count", shard_count)
    high = F.conv(F.substring(event_id, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(event_id, 9, 8), 16, 10).cast("bigint")
    return (((high % shard_count) * (2**32 % shard_count) + low % shard_count) % shard_count).cast("int")


def shard_key(video_id: Column, shard: Column) -> Column:
    return F.concat(video_id.cast("string"), F.lit(":"), shard.cast("string"))


def parse_shard_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, ":")
    return parts[0].cast("bigint"), parts[1].cast("int")


def projection_key(video_id: Column, prefix: str = fixed.PROJECTION_PREFIX) -> Column:
    not_blank("key prefix", prefix)
    return F.concat(F.lit(prefix), video_id.cast("string"), F.lit(fixed.PROJECTION_SUFFIX))
