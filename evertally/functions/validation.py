"""Admission and request rules as boolean and reason columns."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions.identity import normalize_email, trim_controls, utf16_length


def holds(condition: Column) -> Column:
    """A rule that cannot be decided (null) is not met."""
    return F.coalesce(condition, F.lit(False))


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) a costly column that later filters and join keys read instead of recomputing.

    The optimizer substitutes a plain column into every filter on it, the inferred not-null ones
    included, and would run its hashing or parsing once per mention. The output of a generator is
    not substituted; a one-element array costs next to nothing.
    """
    others = [c for c in rows.columns if c != name]
    return rows.select(*others, F.explode(F.array(value)).alias(name))


def is_mutation(method: Column, path: Column) -> Column:
    return holds((method == "POST") & path.rlike(fixed.MUTATION_PATH))


def is_token(token: Column) -> Column:
    return holds(token.rlike(fixed.TOKEN))


def is_admissible_email(email: Column) -> Column:
    """The length limit applies to the raw value, the pattern to the trimmed one."""
    fits = utf16_length(email) <= fixed.MAX_EMAIL_LENGTH
    return holds(fits & trim_controls(email).rlike(fixed.EMAIL))


def is_admitted(method: Column, path: Column, email: Column, idempotency_key: Column) -> Column:
    """Only mutations must carry an email and an idempotency key."""
    identified = is_admissible_email(email) & is_token(idempotency_key)
    return ~is_mutation(method, path) | identified


def is_canonical_identity(email: Column, idempotency_key: Column) -> Column:
    canonical = (
        (utf16_length(email) <= fixed.MAX_EMAIL_LENGTH)
        & email.rlike(fixed.EMAIL)
        & (email == normalize_email(email))
    )
    return holds(canonical) & is_token(idempotency_key)


def is_plausible_occurrence(
    occurred_at: Column,
    as_of: Column,
    max_age: timedelta = fixed.MAX_OCCURRENCE_AGE,
    future_skew: timedelta = fixed.MAX_FUTURE_SKEW,
) -> Column:
    """Both bounds are inclusive; a missing occurrence time passes."""
    return occurred_at.isNull() | holds(occurred_at.between(as_of - F.lit(max_age), as_of + F.lit(future_skew)))


def rejection_reason(
    video_id: Column, email: Column, idempotency_key: Column, occurred_at: Column, as_of: Column
) -> Column:
    """First broken rule in checking order, or null for a valid request."""
    return (
        F.when(~holds(video_id > 0), "video")
        .when(~is_canonical_identity(email, idempotency_key), "identity")
        .when(~is_plausible_occurrence(occurred_at, as_of), "occurrence")
    )


def request_id_or_new(request_id: Column) -> Column:
    return F.when(is_token(request_id), request_id).otherwise(F.uuid())


def sanitize_identity(requests: DataFrame) -> DataFrame:
    """Replace client-sent identity: only a mutation gets one, from its normalized email."""
    mutation = is_mutation(F.col("method"), F.col("path"))
    identity = F.when(mutation, normalize_email(F.col("email")))
    named = requests.withColumn("request_id", request_id_or_new(F.col("request_id")))
    return computed_once(named, "authenticated_email", identity).drop("email")
