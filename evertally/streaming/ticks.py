"""Snapshots emitted by timers: one per changed key and tick, over however many micro-batches the tick is spread.

Changes wait in keyed state under the end of their tick. When the watermark of arrival times has passed it, a timer
adds them to the key's count and emits the count, so a key that changed in ten micro-batches of a tick is emitted once and
one that did not change is not emitted. Ticks follow the arrivals, not the clock of the processing task: a replay emits
the same snapshots, those of `counts.snapshots_per_tick`. A change that is delivered after its tick was emitted adds one more
snapshot of that tick with the new count; no row is dropped for being late. Ticks that the watermark has not passed
yet wait, also over a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from evertally import fixed_values as fixed
from evertally.operators import counts
from evertally.settings import micros, positive_duration
from evertally.sources.folders import BatchLog
from evertally.streaming.counting import append_whole, batches

#: How far behind the newest arrival a delivery may be and still be in the snapshot of its tick.
LATENESS = timedelta(seconds=10)
TICK = "tick_ms"  # stateful operators rename columns that start with an underscore
MILLISECOND = timedelta(milliseconds=1)


class TickEmitter(StatefulProcessor):
    """The count of a key, and its changes by the tick in which they are due."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n BIGINT")
        self.due = handle.getMapState("due", "tick BIGINT", "n BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ticks = pd.concat([batch[TICK] for batch in rows]).value_counts()
        for tick, changes in sorted(ticks.items()):
            tick = int(tick)
            waiting = self.due.getValue((tick,))[0] if self.due.containsKey((tick,)) else 0
            if not waiting:
                self.handle.registerTimer(tick)
            self.due.updateValue((tick,), (waiting + int(changes),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        tick = expiredTimerInfo.getExpiryTimeInMs()
        total = self.total.get()[0] if self.total.exists() else 0
        total += self.due.getValue((tick,))[0]
        self.due.removeKey((tick,))
        self.total.update((total,))
        yield pd.DataFrame([(*key, total, tick)], columns=[*self.keys, "count", TICK])

    def close(self) -> None:
        pass


def snapshots_per_tick_stream(
    counted: DataFrame,
    keys: tuple[str, ...] = counts.SHARD,
    interval: timedelta = fixed.SNAPSHOT_INTERVAL,
    lateness: timedelta = LATENESS,
) -> DataFrame:
    """(keys, count, version, emitted_at) of a stream of counted events."""
    if positive_duration("interval", interval) % MILLISECOND:
        raise ValueError("interval must be whole milliseconds")
    delay = f"{micros(positive_duration('lateness', lateness))} microseconds"
    tick = F.unix_millis(counts.tick_end(F.col("counted_at"), interval)).alias(TICK)
    timed = counted.select(*keys, F.col("counted_at").alias("clock"), tick).withWatermark("clock", delay)
    changes = timed.select(*keys, TICK)  # without the clock, no row is late for the operator
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.select(*keys).schema)
    emitted = changes.groupBy(*keys).transformWithStateInPandas(
        TickEmitter(list(keys)),
        outputStructType=f"{fields}, count BIGINT, {TICK} BIGINT",
        outputMode="update",
        timeMode="eventTime",
    )
    at = F.timestamp_millis(TICK)
    return counts.as_snapshot(emitted.select(*keys, "count", at.alias("at")), "count", F.col("at")).drop("at")


def emit_ticks(
    counted: DataFrame,
    snapshots: BatchLog,
    checkpoint: str,
    interval: timedelta = fixed.SNAPSHOT_INTERVAL,
    lateness: timedelta = LATENESS,
) -> DataStreamWriter:
    """Shard snapshots, once per tick, to a log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_whole(snapshots, batch, batch, batch_id, checkpoint)

    rows = snapshots_per_tick_stream(counted, interval=interval, lateness=lateness)
    return batches(rows, write, checkpoint, "shard-snapshots").outputMode("update")
