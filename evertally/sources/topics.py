"""Topic readers and writers: Kafka options and the file form of the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evertally.functions.contracts import RAW_RECORD, VIEW_REQUEST
from evertally.settings import not_blank, positive_count
from evertally.sources.folders import file_stream


def kafka_options(servers: str, topic: str, max_records: int | None = None) -> dict[str, str]:
    """Committed records only, from the earliest offset; losing data is an error."""
    options = {
        "kafka.bootstrap.servers": not_blank("servers", servers),
        "subscribe": not_blank("topic", topic),
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "failOnDataLoss": "true",
    }
    if max_records is not None:
        options["maxOffsetsPerTrigger"] = str(positive_count("records per trigger", max_records))
    return options


def kafka_records(spark: SparkSession, servers: str, topic: str, max_records: int | None = None) -> DataFrame:
    """Raw records of a topic; needs the Kafka connector package on the class path."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_records)).load()
    return stream.select(
        "topic",
        "partition",
        "offset",
        F.col("key").cast("string").alias("key"),
        "value",
        F.col("timestamp").alias("arrival"),
    )


def kafka_sink(records: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """Write (topic, key, value) rows; the key decides the partition."""
    return (
        records.select("topic", "key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", not_blank("servers", servers))
        .option("checkpointLocation", checkpoint)
    )


def file_records(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw records from parquet files, as a stream."""
    return file_stream(spark, path, RAW_RECORD, max_files)


def file_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A request log from parquet files, as a stream."""
    return file_stream(spark, path, VIEW_REQUEST, max_files)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEW_REQUEST).parquet(path)


def read_records(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    rows = spark.read.schema(RAW_RECORD).parquet(path)
    return rows if topic is None else rows.filter(F.col("topic") == topic)
