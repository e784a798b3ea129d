"""Counters that only the running queries know: observed rows and failures."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from evertally.streaming.counters import Counters

# Failure counters by query name (fixed values)
FAILURE_COUNTERS = {
    "accept-requests": "view_event_publish_failures_total",
    "persist-totals": "counter_sink_failure_total",
    "video-totals": "counter_sink_failure_total",
    "project-changes": "counter_cdc_failures",
}


def observed(rows: DataFrame, name: str) -> DataFrame:
    """Count the rows that flow through, reported with each micro-batch as `name`."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


class CounterListener(StreamingQueryListener):
    """Adds up observed rows and failed queries; register with `spark.streams.addListener`.

    With `durable`, failures are kept there too, each under the run that failed.
    """

    def __init__(self, durable: Counters | None = None) -> None:
        self.counters: Counter[str] = Counter()
        self.durable = durable
        self._names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.counters[name] += row["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            name = self._names.get(str(event.runId))
            metric = FAILURE_COUNTERS.get(name, f"{name}_failures")
            self.counters[metric] += 1
            if self.durable is not None:
                self.durable.add("failures", str(event.runId), 0, {metric: 1})
