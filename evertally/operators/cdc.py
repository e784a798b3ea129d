"""Change feed of the counter table: unwrap, check, and re-read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions import contracts
from evertally.functions.validation import computed_once, holds

FIELDS = ("video_id", "view_count", "version")


def unwrap(feed: DataFrame) -> DataFrame:
    """Add `op`, `video_id`, `count`, `version` and `error` (null when the change is usable).

    Tombstones (null values) are dropped. The envelope may be bare or sit under `payload`.
    """
    text = F.col("value").cast("string")
    document = F.try_parse_json(F.when(F.is_valid_utf8(text), text))
    envelope = F.coalesce(F.try_variant_get("_json", "$.payload", "variant"), F.col("_json"))
    parsed = (
        feed.filter("value is not null")
        .withColumn("_json", document)
        .withColumn("_envelope", envelope)
        .withColumn("op", F.try_variant_get("_envelope", "$.op", "string"))
        .withColumns({f"_{name}": _integral(name) for name in FIELDS})
    )
    changes = parsed.select(
        *feed.columns,
        "op",
        F.col("_video_id").alias("video_id"),
        F.col("_view_count").alias("count"),
        F.col("_version").alias("version"),
        F.col("_json").isNotNull().alias("_json_ok"),
    )
    complete = F.col("video_id").isNotNull() & F.col("count").isNotNull() & F.col("version").isNotNull()
    error = (
        F.when(~F.col("_json_ok"), "json")
        .when(~holds(F.col("op").isin(*fixed.CDC_OPERATIONS)), "operation")
        .when(~complete, "field")
        .when(~contracts.is_projection(), "contract")
    )
    return computed_once(changes, "error", error).drop("_json_ok")


def _integral(name: str) -> Column:
    """Only integral numbers that fit a long; 1.5, strings and missing fields are null."""
    path = f"$.after.{name}"
    kind = F.schema_of_variant(F.try_variant_get("_envelope", path, "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get("_envelope", path, "bigint"))


def strict(changes: DataFrame) -> DataFrame:
    """Fail closed: an unusable change stops the job, nothing is skipped."""
    message = F.concat(F.lit("Invalid counter change: "), F.col("error"))
    # the check is part of a column that the result needs, so it cannot be pruned away
    checked = F.when(F.col("error").isNull(), F.col("video_id")).otherwise(F.raise_error(message).cast("bigint"))
    return changes.withColumn("video_id", checked).drop("error")


def reread(table: DataFrame) -> DataFrame:
    """The whole counter table as `r` changes; Spark's scan partitions are the chunks."""
    return table.select(F.lit("r").alias("op"), "video_id", F.col("view_count").alias("count"), "version")


def envelope(op: Column, wrapped: Column) -> Column:
    """JSON envelope of a counter row, bare or under `payload`."""
    after = F.struct(*FIELDS).alias("after")
    bare = F.struct(op.alias("op"), after)
    return F.when(wrapped, F.to_json(F.struct(bare.alias("payload")))).otherwise(F.to_json(bare))
