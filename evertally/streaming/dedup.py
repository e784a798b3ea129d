"""Horizon deduplication as a stateful stream operator: a `last counted` value per event id, until it expires.

An id's value is of no more use once nothing within its horizon can be delivered any more. Arrival time tells when
that is: the watermark is the newest arrival less `lateness`, and when it passes the end of the horizon a timer drops the
value. So the state holds the ids of the last horizon and lateness, however long the query runs. No row is dropped for
being late: the watermark is kept on a column that ends before the operator. An arrival that is delivered
with more than `lateness` delay behind the newest one is judged without what has expired by then.

Spark calls the processor once for each group and micro-batch, and each call costs milliseconds. So ids are grouped by a
hash: a micro-batch makes at most one call for each of `BUCKETS` buckets (and one for a bucket's timer), whatever its
number of ids. The state of a bucket is its ids and their values in full; ids that share a bucket are still told apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evertally import fixed_values as fixed
from evertally.operators.dedup import EVENT_KEYS
from evertally.settings import micros, positive_count, positive_duration

#: How far behind the newest arrival a delivery may be and still be judged with all that was counted.
LATENESS = timedelta(days=1)
ARRIVAL = "arrived_us"  # stateful operators rename columns that start with an underscore
#: Groups of ids. Part of the state: with another number, start with a new checkpoint.
BUCKETS = 1 << 13
BUCKET, ID = "id_bucket", "id"
NEVER = -(1 << 62)


class HorizonDedup(StatefulProcessor):
    """Keeps an arrival of an id more than one horizon after its last kept one; duplicates leave no trace.

    The values of a bucket are one state value. One timer per bucket, at the first expiry, ends those that have expired.
    """

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one id a line: JSON has no line breaks; `counted` holds their values, eight bytes each
        self.state = handle.getValueState("last_counted", "due BIGINT, ids STRING, counted BINARY")

    def end_of(self, last: np.ndarray) -> np.ndarray:
        """The first millisecond at which an arrival would be counted anyway."""
        return (last + self.reach) // 1000 + 1

    def stored(self) -> tuple[int | None, np.ndarray, np.ndarray]:
        """(time of the timer, ids, their last counted arrivals)."""
        if not self.state.exists():
            return None, np.empty(0, dtype=object), np.empty(0, dtype=np.int64)
        due, ids, counted = self.state.get()
        return due, np.array(ids.split("\n"), dtype=object), np.frombuffer(bytes(counted), dtype=np.int64)

    def store(self, due: int | None, ids: np.ndarray, last: np.ndarray, expired: int) -> None:
        """Puts in what has not expired by this millisecond, and sets the timer; `due` is the one that is set."""
        ends = self.end_of(last)
        ahead = ends > expired
        first = int(ends[ahead].min()) if ahead.any() else None
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is None:
            self.state.clear()
            return
        if due != first:
            self.handle.registerTimer(first)
        self.state.update((first, "\n".join(ids[ahead]), last[ahead].tobytes()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        arrivals = pd.concat(list(rows))
        due, known, before = self.stored()
        codes, ids = pd.factorize(np.concatenate([known, arrivals[ID].to_numpy(dtype=object)]))
        last = np.full(len(ids), NEVER)
        last[: len(known)] = before
        code, at = codes[len(known) :], arrivals[ARRIVAL].to_numpy(dtype=np.int64)
        order = np.lexsort((at, code))
        code, at = self._ahead(code[order], at[order], last)
        if not len(code):
            return
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        kept = [(code[starts], at[starts])]
        last[code[starts]] = at[starts]
        code, at = self._ahead(code, at, last)  # few ids are counted again within a micro-batch
        bounds = [*np.flatnonzero(np.diff(code, prepend=-1)), len(code)]
        for low, high in zip(bounds, bounds[1:], strict=False):
            again = []
            while low < high:
                again.append(low)
                low += int(np.searchsorted(at[low:high], at[low] + self.reach, side="right"))
            kept.append((code[again], at[again]))
            last[code[again[-1]]] = at[again[-1]]
        # what the watermark has passed would end with a timer after these rows
        self.store(due, ids, last, timer_values.getCurrentWatermarkInMs() - 1)
        codes, times = map(np.concatenate, zip(*kept, strict=True))
        yield pd.DataFrame({ID: ids[codes], ARRIVAL: times})

    def _ahead(self, code: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead = at > last[code] + self.reach
        return code[ahead], at[ahead]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due, ids, last = self.stored()
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        # the timer that has fired is gone
        self.store(None if due == expiry else due, ids, last, max(expiry, timerValues.getCurrentWatermarkInMs() - 1))
        yield from ()

    def close(self) -> None:
        pass


def collapse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeats of the same (id, arrival) inside each batch before anything is shuffled."""
    for part in parts:
        distinct = pa.Table.from_batches([part]).group_by([BUCKET, ID, ARRIVAL]).aggregate([])
        yield from distinct.select([BUCKET, ID, ARRIVAL]).to_batches()


def packed(keys: Sequence[str]) -> Column:
    """The key columns as one string, nulls included."""
    return F.to_json(F.array(*[F.col(key).cast("string") for key in keys]))


def horizon_dedup_stream(
    events: DataFrame,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    keys: Sequence[str] = EVENT_KEYS,
    at: str = "accepted_at",
    lateness: timedelta = LATENESS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Counted events of a stream: the key columns and `counted_at`.

    Time is the arrival column, never the processing clock, and no row is dropped by a watermark, so late events
    count and a replay gives the same result. The rows of a bucket in one micro-batch are bounded by the source's
    admission (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`).
    """
    reach = micros(positive_duration("horizon", horizon))
    delay = f"{micros(positive_duration('lateness', lateness))} microseconds"
    bucket = F.pmod(F.xxhash64(ID), F.lit(positive_count("buckets", buckets)))
    timed = events.select(packed(keys).alias(ID), F.col(at).alias("clock"), F.unix_micros(at).alias(ARRIVAL))
    arrivals = timed.withWatermark("clock", delay).select(bucket.alias(BUCKET), ID, ARRIVAL)
    arrivals = arrivals.mapInArrow(collapse, arrivals.schema)
    counted = arrivals.groupBy(BUCKET).transformWithStateInPandas(
        HorizonDedup(reach), outputStructType=f"{ID} STRING, {ARRIVAL} BIGINT", outputMode="update", timeMode="eventTime"
    )
    values = counted.select(F.from_json(ID, "ARRAY<STRING>").alias("values"), ARRIVAL)
    typed = [F.get("values", F.lit(i)).cast(events.schema[key].dataType).alias(key) for i, key in enumerate(keys)]
    return values.select(*typed, F.timestamp_micros(ARRIVAL).alias("counted_at"))
