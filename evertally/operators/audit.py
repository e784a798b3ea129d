"""Audits: table constraints and projection lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_violations(table: DataFrame) -> DataFrame:
    """One row per (video_id, rule) the counter table breaks; empty for a sound table."""
    per_id = table.groupBy("video_id").agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("view_count").isNull() | F.col("version").isNull()).alias("_nulls"),
        F.count_if(F.col("view_count") < 0).alias("_negative"),
        F.count_if(F.col("version") != F.col("view_count")).alias("_unequal"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("video_id").isNull(), "null_id"),
            F.when(F.col("_rows") > 1, "duplicate_id"),
            F.when(F.col("_nulls") > 0, "null_value"),
            F.when(F.col("_negative") > 0, "negative_count"),
            F.when(F.col("_unequal") > 0, "version_not_count"),
        )
    )
    return per_id.select("video_id", F.explode(rules).alias("rule"))


def projection_lag(table: DataFrame, projection: DataFrame) -> DataFrame:
    """Ids whose table and projection versions differ or that only one side has."""
    stored = table.select("video_id", F.col("version").alias("table_version"))
    projected = projection.select("video_id", F.col("version").alias("projection_version"))
    both = stored.join(projected, "video_id", "full_outer")
    return both.filter(~F.col("table_version").eqNullSafe(F.col("projection_version")))
