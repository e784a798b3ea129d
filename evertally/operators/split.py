"""Valid/invalid split: contract rows go on, everything else is quarantined with its exact bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions import contracts
from evertally.functions.contracts import Contract
from evertally.functions.validation import computed_once

RECORD = ("topic", "partition", "offset", "key", "value", "arrival")


def checked_events(records: DataFrame, shard_count: int = fixed.SHARD_COUNT) -> DataFrame:
    agrees = contracts.agrees_with_event_key(F.col("key"), shard_count)
    return _checked(records, contracts.VIEW_EVENT, contracts.is_view_event(), agrees)


def checked_shards(records: DataFrame, shard_count: int = fixed.SHARD_COUNT) -> DataFrame:
    agrees = contracts.agrees_with_video_key(F.col("key"), shard_count)
    return _checked(records, contracts.SHARD_SNAPSHOT, contracts.is_shard_snapshot(), agrees)


def checked_totals(records: DataFrame) -> DataFrame:
    agrees = contracts.agrees_with_video_key(F.col("key"))
    return _checked(records, contracts.TOTAL_SNAPSHOT, contracts.is_total_snapshot(), agrees)


def _checked(records: DataFrame, contract: Contract, is_valid: Column, agrees: Column) -> DataFrame:
    """Decoded records with `reason`: null when valid, else the first broken rule."""
    reason = (
        F.when(F.col("value").isNull(), "tombstone")
        .when(~F.col("decoded"), "undecodable")
        .when(~is_valid, "contract")
        .when(~agrees, "key")
    )
    return computed_once(contracts.decode(records, contract), "reason", reason)


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").drop("reason", "decoded", "value")


def dead_letters(checked: DataFrame) -> DataFrame:
    """Same key, same bytes, same source partition, on `<topic>.DLT`."""
    rows = checked.filter("reason is not null").select(*RECORD, "reason")
    return rows.withColumn("topic", F.concat("topic", F.lit(fixed.DEAD_LETTER_SUFFIX)))


def routed(checked: DataFrame) -> DataFrame:
    """Both branches in one pass: `topic` becomes the dead-letter topic where `reason` is set.

    Written with `partitionBy("topic")`, this is the split without reading the input twice.
    """
    dead = F.concat("topic", F.lit(fixed.DEAD_LETTER_SUFFIX))
    return checked.withColumn("topic", F.when(F.col("reason").isNull(), F.col("topic")).otherwise(dead))
