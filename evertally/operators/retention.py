"""Topic retention on a date-partitioned log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.settings import positive_duration


def with_arrival_date(records: DataFrame) -> DataFrame:
    return records.withColumn("arrival_date", F.to_date("arrival"))


def retained(
    records: DataFrame, as_of: Column, retention: timedelta = fixed.TOPIC_RETENTION, at: str = "arrival"
) -> DataFrame:
    """Rows not older than the retention; on a dated log whole partitions are pruned too."""
    oldest = as_of - F.lit(positive_duration("retention", retention))
    kept = records.filter(F.col(at) >= oldest)
    if "arrival_date" in records.columns:
        kept = kept.filter(F.col("arrival_date") >= F.to_date(oldest))
    return kept
