import json

import pytest
from pyspark.sql import functions as F

from evertally.functions import contracts
from evertally.operators import cdc, reads

BIG = 9007199254740993
AFTER = {"video_id": 7, "view_count": 100, "version": BIG}


def feed(spark, *values):
    rows = [(n, value) for n, value in enumerate(values)]
    return spark.createDataFrame(rows, "offset BIGINT, value BINARY")


def text(document):
    return json.dumps(document).encode()


@pytest.mark.parametrize("op", ["c", "u", "r"])
@pytest.mark.parametrize("wrapped", [False, True])
def test_operations_bare_and_wrapped(spark, op, wrapped):
    change = {"op": op, "after": AFTER}
    row = cdc.strict(cdc.unwrap(feed(spark, text({"payload": change} if wrapped else change)))).first()
    assert (row["op"], row["video_id"], row["count"], row["version"]) == (op, 7, 100, BIG)


def test_tombstone_is_skipped(spark):
    assert cdc.unwrap(feed(spark, None)).count() == 0


@pytest.mark.parametrize(
    "value, error",
    [
        (b"{}", "operation"),
        (b'{"op":"d"}', "operation"),
        (b'{"op":"r","after":{}}', "field"),
        (b"{", "json"),
        (b"", "json"),
        (text({"op": "c", "after": {**AFTER, "version": 1.5}}), "field"),
        (text({"op": "c", "after": {**AFTER, "version": 1.0}}), "field"),
        (text({"op": "c", "after": {**AFTER, "version": "1"}}), "field"),
        (text({"op": "c", "after": {**AFTER, "version": True}}), "field"),
        (text({"op": "c", "after": {**AFTER, "version": 2**63}}), "field"),
        (text({"op": "c", "after": {**AFTER, "version": -1}}), "contract"),
        (text({"op": "c", "after": {**AFTER, "video_id": 0}}), "contract"),
        (text({"payload": None, "op": "c", "after": AFTER}), "operation"),
        (text({"op": "c", "after": None}), "field"),
    ],
)
def test_unusable_changes_fail_closed(spark, value, error):
    changes = cdc.unwrap(feed(spark, value))
    assert changes.first()["error"] == error
    with pytest.raises(Exception, match="Invalid counter change"):
        cdc.strict(changes).collect()


def test_envelope_round_trip(spark):
    row = spark.createDataFrame([(7, 100, BIG)], "video_id BIGINT, view_count BIGINT, version BIGINT")
    for wrapped in (False, True):
        value = row.select(F.lit(0).alias("offset"), F.encode(cdc.envelope(F.lit("u"), F.lit(wrapped)), "UTF-8").alias("value"))
        found = cdc.strict(cdc.unwrap(value)).first()
        assert (found["video_id"], found["count"], found["version"]) == (7, 100, BIG)


def test_reread_has_every_row(spark):
    table = spark.createDataFrame([(n, n, n) for n in range(1, 21)], "video_id BIGINT, view_count BIGINT, version BIGINT")
    rows = cdc.reread(table).collect()
    assert {r["op"] for r in rows} == {"r"} and len(rows) == 20


def projection(spark, *rows):
    return spark.createDataFrame(
        [(f"video:{v}:views", v, count, 1) for v, count in rows], "key STRING, video_id BIGINT, count STRING, version BIGINT"
    )


def test_lookup_falls_back_from_projection_to_table_to_zero(spark):
    ids = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 0, -5, 1)], "video_id BIGINT")
    table = spark.createDataFrame([(1, 41), (2, 43), (3, 44)], "video_id BIGINT, view_count BIGINT")
    found = reads.resolve_counts(ids, projection(spark, (1, "42"), (3, "broken")), table)
    assert {r["video_id"]: r["views"] for r in found.collect()} == {1: 42, 2: 43, 3: 44, 4: 0}
    assert found.count() == 4


def test_point_lookups(spark):
    table = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "video_id BIGINT, view_count BIGINT, version BIGINT")
    assert [tuple(r) for r in reads.lookup_counter(table, 2).collect()] == [(2, 6, 6)]
    stored = projection(spark, (1, "42"), (2, "broken"))
    assert [tuple(r) for r in reads.lookup_projection(stored, 1).collect()] == [(42, 42)]
    assert reads.lookup_projection(stored, 2).isEmpty()
    assert reads.lookup_projection(stored, 1, prefix="other:").isEmpty()
    for lookup, source in ((reads.lookup_counter, table), (reads.lookup_projection, stored)):
        with pytest.raises(ValueError):
            lookup(source, 0)


def test_empty_projection_reads_the_table(spark):
    ids = spark.createDataFrame([(1,)], "video_id BIGINT")
    table = spark.createDataFrame([(1, 9)], "video_id BIGINT, view_count BIGINT")
    lost = spark.createDataFrame([], contracts.PROJECTION)
    assert reads.resolve_counts(ids, lost, table).first()["views"] == 9


def test_a_damaged_projection_leaves_the_table(spark, folder):
    """Missing, removed while it is read, or no parquet at all: the table answers, and a sound projection is used."""
    ids = spark.createDataFrame([(1,), (2,), (3,), (0,), (None,)], "video_id BIGINT")
    table = spark.createDataFrame([(1, 10), (2, 20)], "video_id BIGINT, view_count BIGINT")
    rows = spark.createDataFrame([("video:1:views", "11"), ("video:2:views", "x"), ("video:9:views", "9")], "key STRING, count STRING")
    rows.coalesce(1).write.parquet(f"{folder}/projection")
    sound = spark.read.parquet(f"{folder}/projection")

    def views(load):
        found = reads.resolve_counts(ids, reads.survived(load, ids), table)
        return {r["video_id"]: r["views"] for r in found.collect()}

    assert views(lambda: sound) == {1: 11, 2: 20, 3: 0}
    assert views(lambda: spark.read.parquet(f"{folder}/nowhere")) == {1: 10, 2: 20, 3: 0}
    spark.createDataFrame([("no parquet",)], "line STRING").write.text(f"{folder}/text")
    assert views(lambda: spark.read.schema("key STRING, count STRING").parquet(f"{folder}/text")) == {1: 10, 2: 20, 3: 0}
    with pytest.raises(ZeroDivisionError):  # a mistake of the caller is none of the source
        views(lambda: 1 / 0)
