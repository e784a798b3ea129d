"""An append-only log written by Spark's own file sink.

The sink notes the files of each micro-batch in its commit log, and readers see noted files only: what a broken batch
has left behind is never read, and its repetition is noted once. Micro-batch numbers start over with a new checkpoint
and the sink would take such batches for old ones; so every checkpoint, which is a run, has a folder of its own below
the log. The run's name lies in its checkpoint: whoever loses the checkpoint gets a new run, and nothing is lost.

For stages whose batches are only appended. What must be read back by batch number stays in a `BatchLog`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evertally.sources.folders import file_stream


class SinkLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.partition_by = partition_by

    def writer(self, rows: DataFrame, checkpoint: str, name: str) -> DataStreamWriter:
        """Appends a stream; every row is in the log once, however often batches are repeated."""
        writer = rows.writeStream.queryName(name).format("parquet").partitionBy(*self.partition_by)
        return writer.option("checkpointLocation", checkpoint).option("path", self._folder(self._run(checkpoint)))

    def runs(self) -> list[str]:
        return sorted(self._lines(f"{self.path}/runs"))

    def read(self) -> DataFrame:
        """The rows of all runs, with their `run`."""
        rows = self.spark.createDataFrame([], f"{self.schema}, run STRING")
        for run in self.runs():
            try:
                found = self.spark.read.schema(self.schema).parquet(self._folder(run))
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue  # no batch yet
            rows = rows.unionByName(found.withColumn("run", F.lit(run)))
        return rows

    def stream(self, run: str, max_files: int | None = None) -> DataFrame:
        """One run as a stream, for a query with a checkpoint of its own."""
        return file_stream(self.spark, self._folder(run), self.schema, max_files)

    def _folder(self, run: str) -> str:
        return f"{self.path}/run={run}"

    def _lines(self, path: str) -> list[str]:
        try:
            return [row["value"] for row in self.spark.read.text(path).collect()]  # a line per run
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _run(self, checkpoint: str) -> str:
        named = self._lines(f"{checkpoint}/run")
        run = named[0] if named else str(uuid.uuid4())
        line = self.spark.createDataFrame([(run,)], "value STRING").coalesce(1)
        if run not in self.runs():  # registered before it is named: a run that can write can be read
            line.write.mode("append").text(f"{self.path}/runs")
        if not named:
            line.write.text(f"{checkpoint}/run")
        return run
