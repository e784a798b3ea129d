"""Durable counters of the running queries.

A query adds what a micro-batch has counted under its run and the number of the batch. A total moves only with a newer
batch, so a repeated batch, or one that broke off after it was counted, adds nothing twice. Counts are taken of rows as
they flow through a batch or of what its log holds, never of a second reading of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally.sources.folders import Folder, Table

TOTALS = "metric STRING, run STRING, value BIGINT, version BIGINT"


class Counters:
    """A folder with a small table for each query, which alone writes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _table(self, job: str) -> Table:
        return Table(self.spark, f"{self.path}/{job}", TOTALS, ["metric", "run"])

    def add(self, job: str, run: str, batch_id: int, values: dict[str, int]) -> None:
        table = self._table(job)
        known = {row["metric"]: row for row in table.read().filter(F.col("run") == run).collect()}  # a row per metric
        rows = []
        for metric, value in values.items():
            before = known.get(metric)
            if before is None or before["version"] < batch_id:
                rows.append((metric, run, value + (before["value"] if before else 0), batch_id))
        if rows:
            table.upsert(self.spark.createDataFrame(rows, TOTALS).coalesce(1))

    def read(self) -> DataFrame:
        """(metric, value) over all queries and runs."""
        totals = self.spark.createDataFrame([], TOTALS)
        for job in Folder(self.spark, self.path).names():
            totals = totals.unionByName(self._table(job).read())
        return totals.groupBy("metric").agg(F.sum("value").alias("value"))
