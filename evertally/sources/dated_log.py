"""An append-only log in folders of days: readers name the days they need, and retention drops whole days.

Layout: `day=…/run=…/batch_id=…`. A reader with a lower bound lists and opens the days from there on only, so its cost
follows its horizon and not the age of the log. Retention has two steps, so that readers go on: days before
the bound are hidden from new readers at once, and their files go with a later call, when the bound is older than
`keep` and whoever read them before has ended. Neither step reads data.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.settings import positive_duration
from evertally.sources.folders import BatchLog, file_stream

DAY = timedelta(days=1)
#: Bounds of earlier calls are files here, named by the first day that stays.
BOUNDS = "_retention"
#: Batches that are published in full.
DONE = "_published"


def utc_day(at: str | Column) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / F.lit(DAY // timedelta(microseconds=1))).cast("int"))


def day_of(at: datetime) -> date:
    """The same on the driver; naive values are UTC, as sessions here are."""
    return at.date()


class DatedLog(BatchLog):
    """A batch log whose rows lie under the UTC day of their timestamp `at`, which must not be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str, keep: timedelta = timedelta(hours=1)):
        super().__init__(spark, path, schema)
        self.schema = f"{self.schema}, day DATE"
        self.at = at
        self.keep = keep

    def append(self, rows: DataFrame, batch_id: int, partition_by: tuple[str, ...] = (), run: str = "direct") -> bool:
        """False when this batch of this run is there already.

        A batch of several days appears day by day. After a crash in between, its repetition adds the days that
        are missing: as a micro-batch gives the same rows again, none is lost or twice.
        """
        batch = f"run={run}/batch_id={batch_id}"
        if self.folder.has(f"{DONE}/{batch}"):
            return False
        self.folder.publish_parts(rows.withColumn("day", utc_day(self.at)), "day", batch, partition_by)
        self.folder.write_text(f"{DONE}/{batch}", "")
        return True

    def days(self) -> list[date]:
        """The days that readers see."""
        first = max(self._bounds(), default=date.min)
        found = (name[4:] for name in self.folder.names() if name.startswith("day="))
        return [day for day in sorted(date.fromisoformat(name) for name in found) if day >= first]

    def _bounds(self) -> list[date]:
        return [date.fromisoformat(name) for name in self.folder.names(BOUNDS)]

    def read(self, since: date | None = None) -> DataFrame:
        """All rows, or those of the days from `since` on."""
        days = [day for day in self.days() if since is None or day >= since]
        if not days:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.folder.path)
        rows = reader.parquet(*[f"{self.folder.path}/day={day}" for day in days])
        return rows if since is None else rows.filter(F.col("day") >= F.lit(since))

    def apart_from(self, run: str, batch_id: int, since: date | None = None) -> DataFrame:
        return self.read(since).filter((F.col("run") != run) | (F.col("batch_id") < batch_id))

    def stream(self, max_files: int | None = None) -> DataFrame:
        """The log as a stream, from the first day that is left."""
        self.folder.create()
        return file_stream(self.spark, self.folder.path, self.schema, max_files)

    def expire_days(self, as_of: datetime, retention: timedelta = fixed.TOPIC_RETENTION) -> list[date]:
        """Hide the days that lie whole before `as_of` less the retention; returns the days whose files were removed.

        Removed is what an earlier call has hidden at least `keep` ago. A bound never goes back.
        """
        first = day_of(as_of - positive_duration("retention", retention))
        if first > max(self._bounds(), default=date.min):
            self.folder.write_text(f"{BOUNDS}/{first}", "")
        settled = [bound for bound in self._bounds() if self.folder.age(f"{BOUNDS}/{bound}") >= self.keep]
        last = max(settled, default=date.min)
        names = [name for name in self.folder.names() if name.startswith("day=")]
        gone = sorted(day for day in (date.fromisoformat(name[4:]) for name in names) if day < last)
        for day in gone:
            self.folder.remove(f"day={day}")
        for bound in settled:
            if bound < last:
                self.folder.remove(f"{BOUNDS}/{bound}")
        return gone
