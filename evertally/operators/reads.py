"""Reads: point lookups and the projection → table → 0 fallback."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.functions.identity import projection_key
from evertally.session import enable_checkpoints
from evertally.settings import positive_count

log = logging.getLogger(__name__)


def lookup_counter(table: DataFrame, video_id: int) -> DataFrame:
    """Point read; the equality reaches the scan. The id is checked before anything is read."""
    positive_count("video id", video_id)
    return table.filter(F.col("video_id") == video_id).select("video_id", "view_count", "version")


def lookup_projection(
    projection: DataFrame, video_id: int, prefix: str = fixed.PROJECTION_PREFIX
) -> DataFrame:
    """A cached counter's version is its count; a count that is no number is an absent counter."""
    positive_count("video id", video_id)
    wanted = projection.filter(F.col("key") == projection_key(F.lit(video_id), prefix))
    number = F.col("count").try_cast("bigint")
    return wanted.select(number.alias("count"), number.alias("version")).filter("count is not null")


def survived(
    load: Callable[[], DataFrame], ids: DataFrame, prefix: str = fixed.PROJECTION_PREFIX
) -> DataFrame:
    """What the projection holds of the ids, read now; nothing if it cannot be read.

    A failing source fails whatever query it is part of. So its part is a job of its own: the few columns of the ids are
    checkpointed, and a missing or damaged projection leaves the caller with its other sources. Only errors of
    Spark's read are taken; a wrong argument is still an error.
    """
    spark = ids.sparkSession
    wanted = ids.filter("video_id > 0").select(projection_key(F.col("video_id"), prefix).alias("key")).distinct()
    enable_checkpoints(spark)
    try:
        held = load().join(wanted, "key", "left_semi").select("key", F.col("count").try_cast("bigint").alias("count"))
        return held.checkpoint()
    except (PySparkException, Py4JJavaError) as error:
        log.warning("projection not readable, reading the table instead: %s", str(error).split("\n", 1)[0])
        return spark.createDataFrame([], "key STRING, count BIGINT")


def resolve_counts(
    ids: DataFrame, projection: DataFrame, table: DataFrame, prefix: str = fixed.PROJECTION_PREFIX
) -> DataFrame:
    """(video_id, views) of the distinct positive ids; a lost projection is an empty one."""
    wanted = ids.filter("video_id > 0").select("video_id").distinct()
    wanted = wanted.withColumn("key", projection_key(F.col("video_id"), prefix))
    # of both sides only what is asked for takes part in the outer joins
    cached = projection.join(wanted, "key", "left_semi").select("key", F.col("count").try_cast("bigint").alias("_cached"))
    stored = table.join(wanted, "video_id", "left_semi").select("video_id", F.col("view_count").alias("_stored"))
    views = F.coalesce("_cached", "_stored", F.lit(0).cast("bigint")).alias("views")
    return wanted.join(cached, "key", "left").join(stored, "video_id", "left").select("video_id", views)
