"""Driver-side argument checks shared by the operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from evertally import fixed_values as fixed


def micros(duration: timedelta) -> int:
    return duration // timedelta(microseconds=1)


def slice_start(at: Column, width: int) -> Column:
    """Start of the slice of `width` that holds the integer `at`; exact for times before 1970 too."""
    return at - F.pmod(at, F.lit(width).cast("bigint"))


def positive_duration(name: str, duration: timedelta) -> timedelta:
    if duration <= timedelta(0):
        raise ValueError(f"{name} must be positive")
    return duration


def positive_count(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def not_blank(name: str, text: str | None) -> str:
    if text is None or not text.strip():
        raise ValueError(f"{name} must not be blank")
    return text


def strong_secret(secret: str | None) -> str:
    # the limit counts UTF-16 code units
    if secret is None or len(secret.encode("utf-16-be")) // 2 < fixed.MIN_SECRET_LENGTH:
        raise ValueError(f"HMAC secret must have at least {fixed.MIN_SECRET_LENGTH} characters")
    return secret
