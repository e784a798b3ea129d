"""The plans at scale: what is pushed down, shuffled, broadcast and computed."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from conftest import SMALL
from evertally.functions import contracts
from evertally.operators import gate, reads, retention
from evertally.operators.counts import shard_counts
from evertally.operators.dedup import EVENT_KEYS, _arrivals, _cells_per_id, _resolve, _walk
from evertally.plans import mapping


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffles(frame):
    return plan(frame).count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "name",
    ["event_identity", "user_hash", "shard_assign", "decode_contract", "valid_invalid_split", "request_validate",
     "identity_sanitize", "admission_filter", "accepted_response", "retention_filter", "key_agreement"],
)
def test_ingest_is_narrow(spark, name):
    text = plan(registered.queries()[name](spark, SMALL))
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("name", [n for n in registered.QUERIES if not n.startswith("stream_")])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(registered.queries()[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapIn", text)


def test_scan_reads_only_the_columns_it_needs(spark):
    text = plan(mapping.view_events(spark, SMALL).select("event_id"))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in text


def test_identity_is_hashed_once_per_row(spark):
    events = mapping.view_events(spark, SMALL)
    keyed = events.join(events.groupBy("counter_shard_id").count(), "counter_shard_id")
    side = plan(keyed).split("BroadcastExchange")[0].split("Exchange")[0]
    assert side.count("concat_ws(:, event") <= 1


def test_counting_combines_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 1, 0, None)], "event_id STRING, video_id BIGINT, counter_shard_id INT, counted_at TIMESTAMP")
    text = plan(shard_counts(rows))
    below_the_shuffle = text[text.index("Exchange") :]
    assert "partial_count" in below_the_shuffle
    assert shuffles(shard_counts(rows)) == 1


def test_dedup_combines_before_the_shuffle_and_stays_on_the_hash_path(spark):
    keys = list(EVENT_KEYS)
    arrivals = _arrivals(mapping.view_events(spark, SMALL), keys, "accepted_at", 1000)
    assert shuffles(arrivals) == 1 and "SortAggregate" not in plan(arrivals)
    ids = _cells_per_id(arrivals.checkpoint(), keys)
    text = plan(ids)
    assert "partial_min" in text and "SortAggregate" not in text and "FileScan" not in text
    assert shuffles(ids) == 2
    walked = _walk(ids.withColumn("_last", F.lit(None).cast("bigint")).withColumn("_kept", F.expr("array()").cast("array<bigint>")), 5000)
    assert shuffles(walked) == 2 and "Join" not in plan(walked)
    resolved = plan(_resolve(arrivals.checkpoint(), walked.checkpoint(), keys, 5000, 1000))
    assert not re.search("CartesianProduct|NestedLoop|FileScan", resolved) and "partial_min" in resolved


@pytest.fixture
def table_folder(spark, folder):
    rows = spark.range(1, 200_001).select(F.col("id").alias("video_id"), F.col("id").alias("view_count"))
    table = rows.withColumn("version", F.col("view_count")).withColumn("updated_at", F.current_timestamp())
    table.write.parquet(f"{folder}/table")
    return f"{folder}/table"


def test_point_lookup_reaches_the_scan(spark, table_folder):
    text = plan(reads.lookup_counter(spark.read.parquet(table_folder), 7))
    assert "EqualTo(video_id,7)" in text
    assert "updated_at" not in text.split("ReadSchema")[1]


def test_small_batch_does_not_shuffle_the_table(spark, table_folder, folder):
    table = spark.read.schema(contracts.VIDEO_COUNTER).parquet(table_folder)
    batch = spark.createDataFrame([(5, 9), (6, 1)], "video_id BIGINT, view_count BIGINT")
    accepted = gate.newer_totals(batch, table).withColumn("updated_at", F.current_timestamp())
    accepted.write.parquet(f"{folder}/accepted")
    written = spark.read.parquet(f"{folder}/accepted")
    merged = gate.replace_rows(table, written, ["video_id"])
    assert "LeftAnti" in plan(merged) and shuffles(merged) == 0
    assert [tuple(r)[:3] for r in merged.filter("video_id IN (5, 6)").orderBy("video_id").collect()] == [(5, 9, 9), (6, 6, 6)]
    assert merged.count() == 200_000


def test_retention_prunes_partitions(spark, folder):
    rows = spark.range(40).select("id", F.expr("timestamp'2026-01-01' + make_dt_interval(CAST(id AS INT))").alias("arrival"))
    retention.with_arrival_date(rows).write.partitionBy("arrival_date").parquet(f"{folder}/log")
    kept = retention.retained(spark.read.parquet(f"{folder}/log"), F.lit("2026-02-01").cast("timestamp"))
    assert re.search(r"PartitionFilters: \[[^\]]*arrival_date", plan(kept))
    assert kept.count() == 23
