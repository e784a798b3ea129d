"""Ingest: request rows to view events and rejects, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions import identity, validation


def view_mutations(requests: DataFrame) -> DataFrame:
    return requests.filter(validation.is_mutation(F.col("method"), F.col("path")))


def admitted(requests: DataFrame) -> DataFrame:
    """Sanitized requests that pass admission, keeping the normalized email as identity."""
    passes = validation.is_admitted(*map(F.col, ("method", "path", "email", "idempotency_key")))
    return validation.sanitize_identity(requests.filter(passes))


def with_reason(requests: DataFrame, email: str = "authenticated_email", as_of: Column | None = None) -> DataFrame:
    """Add `reason`, null for a valid request; times are judged against `as_of` (arrival by default)."""
    clock = F.col("accepted_at") if as_of is None else as_of
    fields = map(F.col, ("video_id", email, "idempotency_key", "occurred_at"))
    return validation.computed_once(requests, "reason", validation.rejection_reason(*fields, clock))


def to_events(
    requests: DataFrame,
    secret: str,
    email: str = "authenticated_email",
    shard_count: int = fixed.SHARD_COUNT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """View events of valid requests. An unstated occurrence time is the acceptance time."""
    who = F.col(email)
    digest = identity.event_id(secret, who, F.col("video_id"), F.col("idempotency_key"))
    identified = validation.computed_once(requests, "event_id", digest)
    return identified.select(
        *keep,
        "event_id",
        "video_id",
        identity.user_hash(secret, who).alias("user_hash"),
        identity.shard_of(F.col("event_id"), shard_count).alias("counter_shard_id"),
        F.coalesce("occurred_at", "accepted_at").alias("occurred_at"),
        "accepted_at",
    )


def accepted_response(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.lit(fixed.ACCEPTED_STATUS).alias("status"))
