"""Record contracts: schemas, validity predicates, JSON decoding and encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions.identity import shard_key
from evertally.functions.validation import holds

# Schemas (fixed values)
VIEW_REQUEST = (
    "method STRING, path STRING, video_id BIGINT, email STRING, authenticated_email STRING, "
    "idempotency_key STRING, request_id STRING, occurred_at TIMESTAMP, accepted_at TIMESTAMP"
)
RAW_RECORD = "topic STRING, partition INT, offset BIGINT, key STRING, value BINARY, arrival TIMESTAMP"
VIDEO_COUNTER = "video_id BIGINT, view_count BIGINT, version BIGINT, updated_at TIMESTAMP"
REBUILD_LEDGER = "id STRING, type STRING, data STRING"
PROJECTION = "key STRING, video_id BIGINT, count BIGINT, version BIGINT"


@dataclass(frozen=True)
class Contract:
    """JSON field names paired with column names and kinds, in wire order."""

    fields: tuple[tuple[str, str, str], ...]

    @property
    def names(self) -> list[str]:
        return [column for _, column, _ in self.fields]


# Wire fields (fixed values)
VIEW_EVENT = Contract(
    (
        ("eventId", "event_id", "string"),
        ("videoId", "video_id", "bigint"),
        ("userHash", "user_hash", "string"),
        ("counterShardId", "counter_shard_id", "int"),
        ("occurredAt", "occurred_at", "instant"),
        ("acceptedAt", "accepted_at", "instant"),
    )
)
SHARD_SNAPSHOT = Contract(
    (
        ("videoId", "video_id", "bigint"),
        ("counterShardId", "counter_shard_id", "int"),
        ("count", "count", "bigint"),
        ("version", "version", "bigint"),
        ("emittedAt", "emitted_at", "instant"),
    )
)
TOTAL_SNAPSHOT = Contract(
    (
        ("videoId", "video_id", "bigint"),
        ("viewCount", "view_count", "bigint"),
        ("version", "version", "bigint"),
        ("emittedAt", "emitted_at", "instant"),
    )
)


# --- predicates -------------------------------------------------------------------------------


def is_view_event() -> Column:
    return holds(
        F.col("event_id").rlike(fixed.HEX_DIGEST)
        & (F.col("video_id") > 0)
        & (F.col("counter_shard_id") >= 0)
        & F.col("user_hash").rlike(fixed.HEX_DIGEST)
        & F.col("occurred_at").isNotNull()
        & F.col("accepted_at").isNotNull()
    )


def is_shard_snapshot() -> Column:
    return holds(
        (F.col("video_id") > 0)
        & (F.col("counter_shard_id") >= 0)
        & (F.col("count") >= 0)
        & (F.col("version") == F.col("count"))
        & F.col("emitted_at").isNotNull()
    )


def is_total_snapshot() -> Column:
    return holds(
        (F.col("video_id") > 0)
        & (F.col("view_count") >= 0)
        & (F.col("version") == F.col("view_count"))
        & F.col("emitted_at").isNotNull()
    )


def is_projection() -> Column:
    """The projection does not require the version to equal the count."""
    return holds((F.col("video_id") > 0) & (F.col("count") >= 0) & (F.col("version") >= 0))


def agrees_with_event_key(key: Column, shard_count: int = fixed.SHARD_COUNT) -> Column:
    shard = F.col("counter_shard_id")
    return holds((shard < shard_count) & (shard_key(F.col("video_id"), shard) == key))


def agrees_with_video_key(key: Column, shard_count: int | None = None) -> Column:
    same = F.col("video_id").cast("string") == key
    if shard_count is not None:
        same = (F.col("counter_shard_id") < shard_count) & same
    return holds(same)


# --- decoding ---------------------------------------------------------------------------------

_INSTANT_TEXT = r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:\d\d)\z"
_FRACTION = r"\.(\d{1,9})(Z|[+-]\d\d:\d\d)\z"


# How a well-formed record is read in one go
_PLAIN_TYPES = {"string": "STRING", "bigint": "BIGINT", "int": "INT", "instant": "DECIMAL(29,9)"}


def _whole_number(text: Column, kind: str, cast: Column) -> tuple[Column, Column]:
    """Missing, null and empty become 0; floats are cut to integers; numeric strings are read."""
    number = F.when(~text.isin("true", "false"), cast)  # the cast would read booleans too
    absent = text.isNull() | (F.trim(text) == "")
    return F.coalesce(number, F.when(absent, F.lit(0).cast(kind))), holds(number.isNotNull() | absent)


def _instant(text: Column) -> tuple[Column, Column]:
    """Epoch seconds with nine decimals, from a number, a numeric string or an ISO-8601 string."""
    iso = F.when(text.rlike(_INSTANT_TEXT), text)
    whole = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(iso, _FRACTION, "$2")))
    fraction = F.rpad(F.regexp_extract(iso, _FRACTION, 1), 9, "0")
    from_iso = whole.cast("decimal(29,9)") + F.concat(F.lit("0."), fraction).cast("decimal(29,9)")
    epoch = F.coalesce(text.try_cast("decimal(29,9)"), from_iso.cast("decimal(29,9)"))
    return epoch, holds(text.isNull() | epoch.isNotNull())


def instant_to_timestamp(epoch: Column) -> Column:
    """Timestamps hold microseconds; the decimal column keeps all nine digits."""
    return F.timestamp_micros(F.floor(epoch * 1_000_000).cast("bigint"))


def decode(records: DataFrame, contract: Contract) -> DataFrame:
    """Parse `value` bytes and add the contract columns plus `decoded`.

    `decoded` is false for null values, invalid UTF-8, broken JSON, non-objects, unknown fields
    and unreadable field values. Every instant also gets a nine-digit `<name>_epoch` column.

    A record whose fields all have their plain JSON type is read at once. Only the others are parsed
    as a variant, which can tell a missing field, a numeric string, a float and a boolean apart.
    """
    text = F.col("value").cast("string")
    readable_text = F.when(F.col("value").isNotNull() & F.is_valid_utf8(text), text)
    schema = ", ".join(f"{field} {_PLAIN_TYPES[kind]}" for field, _, kind in contract.fields)
    complete = F.lit(True)
    for field, _, _ in contract.fields:
        complete = complete & F.col(f"_plain.{field}").isNotNull()
    parsed = (
        records.withColumn("_text", readable_text)
        .withColumn("_plain", F.from_json("_text", schema))
        .withColumn("_complete", holds(complete))
        .withColumn("_json", F.try_parse_json(F.when(~F.col("_complete"), F.col("_text"))))
    )
    texts = {f"_{field}": F.try_variant_get("_json", f"$.{field}", "string") for field, _, _ in contract.fields}
    parsed = parsed.withColumns(texts)

    columns, readable = [], F.col("_json").isNotNull()
    for field, name, kind in contract.fields:
        plain, other = F.col(f"_plain.{field}"), F.col(f"_{field}")
        if kind == "string":
            columns.append(F.coalesce(plain, other).alias(name))
        elif kind == "instant":
            epoch, ok = _instant(other)
            epoch, readable = F.coalesce(plain, epoch), readable & ok
            columns += [instant_to_timestamp(epoch).alias(name), epoch.alias(f"{name}_epoch")]
        else:
            number, ok = _whole_number(other, kind, F.try_variant_get("_json", f"$.{field}", kind))
            columns.append(F.coalesce(plain, F.when(F.col("_json").isNotNull(), number)).alias(name))
            readable = readable & ok

    known = F.array(*[F.lit(field) for field, _, _ in contract.fields])
    only_known = F.size(F.array_except(F.json_object_keys("_text"), known)) == 0
    decoded = holds(only_known) & (F.col("_complete") | readable)
    return parsed.select(*records.columns, *columns, decoded.alias("decoded"))


# --- encoding ---------------------------------------------------------------------------------


def instant_number(at: Column) -> Column:
    return (F.unix_micros(at).cast("decimal(29,0)") / F.lit(1_000_000)).cast("decimal(29,9)")


def encode(contract: Contract) -> Column:
    """JSON text of the contract columns; instants become decimal epoch seconds."""
    fields = [
        (instant_number(F.col(name)) if kind == "instant" else F.col(name)).alias(field)
        for field, name, kind in contract.fields
    ]
    return F.to_json(F.struct(*fields))


def event_record() -> list[Column]:
    return [
        shard_key(F.col("video_id"), F.col("counter_shard_id")).alias("key"),
        encode(VIEW_EVENT).cast("binary").alias("value"),
    ]


def snapshot_record(contract: Contract) -> list[Column]:
    return [
        F.col("video_id").cast("string").alias("key"),
        encode(contract).cast("binary").alias("value"),
    ]
