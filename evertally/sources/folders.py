"""Batch folders and versioned tables on a shared file system.

Readers only ever see complete folders: a batch is written aside under a hidden name and renamed into
place once, and a batch that is already there is not written again. This keeps a replayed micro-batch
from showing up twice. Micro-batch numbers start over with a new checkpoint, so a batch is named by the
run, the identity of its checkpoint, as well. On stores without an atomic rename use a table format with
transactions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evertally.operators.gate import latest_by
from evertally.settings import positive_count


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gave the checkpoint of a running query; a new checkpoint is a new run."""
    return json.loads(Folder(spark, checkpoint).read_text("metadata"))["id"]


def file_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream, oldest first; files stay readable for longer than any retention."""
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", positive_count("files per trigger", max_files))
    return reader.parquet(path)


class Folder:
    """A path and the Hadoop file system that owns it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(configuration)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{self.path}/{name}"))

    def names(self, below: str = "") -> list[str]:
        at = self._at(f"{self.path}/{below}".rstrip("/"))
        if not self._fs.exists(at):
            return []
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(at))

    def publish(self, rows: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> bool:
        """Write `rows` as sub-folder `name`; false when it is already there."""
        if self.has(name):
            return False
        aside = f".writing-{name.replace('/', '-')}"  # hidden from listings
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{aside}")
        self._move(aside, name)
        return True

    def publish_parts(self, rows: DataFrame, part: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
        """Write `rows` as sub-folders `part=value/name`, one per value; those that are there already stay."""
        aside = f".writing-{name.replace('/', '-')}"
        rows.write.mode("overwrite").partitionBy(part, *partition_by).parquet(f"{self.path}/{aside}")
        for value in self.names(aside):
            if value.startswith(f"{part}=") and not self.has(f"{value}/{name}"):
                self._move(f"{aside}/{value}", f"{value}/{name}")
        self.remove(aside)

    def _move(self, source: str, name: str) -> None:
        self._fs.mkdirs(self._at(f"{self.path}/{name}").getParent())
        if not self._fs.rename(self._at(f"{self.path}/{source}"), self._at(f"{self.path}/{name}")):
            raise OSError(f"cannot publish {self.path}/{name}")

    def age(self, name: str) -> timedelta:
        """Time since the folder was put in place."""
        at = self._fs.getFileStatus(self._at(f"{self.path}/{name}")).getModificationTime()
        return datetime.now() - datetime.fromtimestamp(at / 1000)

    def create(self) -> None:
        self._fs.mkdirs(self._at(self.path))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def read_text(self, name: str) -> str | None:
        if not self.has(name):
            return None
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._at(f"{self.path}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


STAGED = ".staged"
#: Buckets of a whole version, a folder each. Part of the layout: with another number, write the tables anew.
BUCKETS = 64
BUCKET = "table_bucket"


class BatchLog:
    """Append-only log, one folder per micro-batch of a run."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.folder = Folder(spark, path)
        self.schema = f"{schema}, run STRING, batch_id BIGINT"

    def append(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = (), run: str = "direct") -> bool:
        """False when this batch of this run is there already."""
        return self.folder.publish(rows, f"run={run}/batch_id={batch_id}", partition_by)

    def stage(self, rows: DataFrame, part: str) -> None:
        """Write rows aside, out of sight of readers, a folder for each value of `part`."""
        rows.write.partitionBy(part).parquet(f"{self.folder.path}/{STAGED}")

    def append_staged(self, part: str, value: int, batch_id: int, run: str = "direct") -> None:
        """Make the staged rows of this value a batch, without writing them again; no rows are an empty batch."""
        if self.folder.has(f"{STAGED}/{part}={value}"):
            self.folder._move(f"{STAGED}/{part}={value}", f"run={run}/batch_id={batch_id}")
        else:
            self.append(self.spark.createDataFrame([], self.schema).drop("run", "batch_id"), batch_id, run=run)

    def read(self) -> DataFrame:
        if not any(name.startswith("run=") for name in self.folder.names()):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder.path)

    def batch(self, run: str, batch_id: int) -> DataFrame:
        """What one batch of a run has appended."""
        return self.read().filter((F.col("run") == run) & (F.col("batch_id") == batch_id))

    def apart_from(self, run: str, batch_id: int, since: date | None = None) -> DataFrame:
        """What other runs and the earlier batches of this one have appended; a dated log needs no days before `since`."""
        return self.read().filter((F.col("run") != run) | (F.col("batch_id") < batch_id))

    def stream(self, max_files: int | None = None) -> DataFrame:
        self.folder.create()  # a file source can only watch what is there
        return file_stream(self.spark, self.folder.path, self.schema, max_files)

    def expire(self, at: str, oldest: datetime) -> list[tuple[str, int]]:
        """Drop the batches whose rows are all older; returns their runs and numbers."""
        ages = self.read().groupBy("run", "batch_id").agg(F.max(at).alias("newest"))
        old = ages.filter(F.col("newest") < F.lit(oldest)).select("run", "batch_id")
        expired = sorted((row["run"], row["batch_id"]) for row in old.toLocalIterator())
        for run, batch_id in expired:
            self.folder.remove(f"run={run}/batch_id={batch_id}")
        return expired


class Table:
    """A table as versions: whole ones, and between them the rows that replaced others.

    A micro-batch adds only its own rows. Of several rows of a key the one of greatest `newest` counts, so
    rows must be gated before; after `compact_every` such versions the next one is whole. A version that a
    newer whole one has made needless stays for `keep`, longer than any reader runs.

    Whole versions lie in buckets of the first key, so a gate opens those that its micro-batch touches. The rows of
    the few later versions are as many as recent micro-batches brought, and are not split.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: Sequence[str] = ("video_id",),
        newest: str = "version",
        compact_every: int = 32,
        keep: timedelta = timedelta(hours=1),
    ):
        self.spark = spark
        self.folder = Folder(spark, path)
        self.schema = schema
        self.keys = list(keys)
        self.newest = newest
        self.compact_every = positive_count("versions between whole ones", compact_every)
        self.keep = keep

    def versions(self) -> list[tuple[int, str]]:
        """(number, "whole" or "rows") in order."""
        named = (name[2:].split("-") for name in self.folder.names() if name.startswith("v="))
        return sorted((int(number), kind) for number, kind in named)

    def _current(self) -> list[tuple[int, str]]:
        """The last whole version and all later ones."""
        versions = self.versions()
        whole = [at for at, (_, kind) in enumerate(versions) if kind == "whole"]
        return versions[whole[-1] :] if whole else versions

    def read(self, near: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The table, or its keys and these columns; given `near`, all rows at least whose first key is in there."""
        paths, later = [], False
        for number, kind in self._current():
            name = f"v={number}-{kind}"
            paths += self._whole(name, near) if kind == "whole" else [f"{self.folder.path}/{name}"]
            later = later or kind == "rows"
        if paths:
            rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        else:
            rows = self.spark.createDataFrame([], self.schema)
        if columns is not None:
            rows = rows.select(*dict.fromkeys([*self.keys, *columns, self.newest]))
        names = rows.columns
        return latest_by(rows, self.keys, F.col(self.newest)).select(*names) if later else rows

    def known(self, batch: DataFrame) -> DataFrame:
        """(keys, version) of at least the keys of a micro-batch: what its gate compares with."""
        return self.read(batch, [self.newest])

    def _bucket(self) -> Column:
        kind = StructType.fromDDL(self.schema)[self.keys[0]].dataType
        return F.pmod(F.xxhash64(F.col(self.keys[0]).cast(kind)), F.lit(BUCKETS))

    def _whole(self, name: str, near: DataFrame | None) -> list[str]:
        """The folders of a whole version that can hold what is wanted; at most BUCKETS numbers come to the driver."""
        path = f"{self.folder.path}/{name}"
        there = {found for found in self.folder.names(name) if found.startswith(f"{BUCKET}=")}
        if near is None or not there:  # a version without buckets is one of no rows, or of an earlier layout
            return [path]
        touched = near.select(self._bucket().alias(BUCKET)).distinct().collect()
        return [f"{path}/{found}" for found in sorted({f"{BUCKET}={row[0]}" for row in touched} & there)]

    def replace(self, rows: DataFrame) -> None:
        """Make `rows` the table, as the next version."""
        self._publish(rows, "whole")
        kept = {number for number, _ in self._current()}
        for number, kind in self.versions():
            name = f"v={number}-{kind}"
            if number not in kept and self.folder.age(name) > self.keep:
                self.folder.remove(name)

    def upsert(self, rows: DataFrame) -> None:
        """Put these rows, newer than those of the table, in place of the ones with the same key."""
        self._publish(rows, "rows")
        if len(self._current()) > self.compact_every:
            self.replace(self.read())

    def _publish(self, rows: DataFrame, kind: str) -> None:
        number = max((number for number, _ in self.versions()), default=-1) + 1
        parts = ()
        keyed = self.keys[0] in StructType.fromDDL(self.schema).names
        if kind == "whole" and keyed:  # few files a bucket, and large buckets in several tasks
            rows, parts = rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET), (BUCKET,)
        if not self.folder.publish(rows, f"v={number}-{kind}", parts):
            raise OSError(f"version {number} of {self.folder.path} was written by someone else")
