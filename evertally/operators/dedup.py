"""Horizon deduplication: count an id again only when its last *counted* arrival is out of reach.

Kept arrivals of one id form a greedy chain: the first arrival, then the first arrival more than
one horizon after the last kept one, and so on. A dropped duplicate never moves the chain.

The source is read once: its distinct (id, arrival) pairs, cut into time cells, are shuffled and written aside, and all
that follows works on them. An id's rows are never gathered: they are summarized per (id, cell) with partial
aggregation, so a hot id shrinks to a few numbers per cell, and the chain is walked over the cells. A cell is no wider
than the horizon, so it holds at most one kept arrival, and its minimum and maximum nearly always tell which. Where they
do not (four or more arrivals around the exact expiry), the one missing value is looked up among the pairs of
that cell, again as a partial aggregate, and the walk goes on. A chain needs at most one lookup per horizon it spans.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally import fixed_values as fixed
from evertally.session import enable_checkpoints
from evertally.settings import micros, positive_count, positive_duration, slice_start

EVENT_KEYS = ("event_id", "video_id", "counter_shard_id")


def horizon_dedup(
    events: DataFrame,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    keys: Sequence[str] = EVENT_KEYS,
    at: str = "accepted_at",
    cells_per_horizon: int = 4096,
    already_counted: DataFrame | None = None,
) -> DataFrame:
    """One row per counted event: the key columns and `counted_at` (arrival, a timestamp).

    `at` is a column of the rows, so the result does not depend on row order or on when the job runs.
    Keys and arrival must not be null, which the event contract guarantees. `already_counted` (an
    earlier result) continues its chains: `events` then holds only later arrivals.
    """
    arrivals = distinct_arrivals(events, horizon, keys, at, cells_per_horizon)
    return dedup_arrivals(arrivals, horizon, keys, cells_per_horizon, already_counted)


def distinct_arrivals(
    events: DataFrame,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    keys: Sequence[str] = EVENT_KEYS,
    at: str = "accepted_at",
    cells_per_horizon: int = 4096,
) -> DataFrame:
    """The distinct arrivals of each id, and how often they came; written once, in the only reading of the source."""
    enable_checkpoints(events.sparkSession)
    return _arrivals(events, list(keys), at, _width(horizon, cells_per_horizon)).checkpoint()


def _width(horizon: timedelta, cells_per_horizon: int) -> int:
    reach = micros(positive_duration("horizon", horizon))
    return max(1, reach // positive_count("cells per horizon", cells_per_horizon))


def dedup_arrivals(
    arrivals: DataFrame,
    horizon: timedelta = fixed.DEDUP_HORIZON,
    keys: Sequence[str] = EVENT_KEYS,
    cells_per_horizon: int = 4096,
    already_counted: DataFrame | None = None,
) -> DataFrame:
    """`horizon_dedup` of events whose `distinct_arrivals`, of the same horizon and cells, are written."""
    reach, width = micros(positive_duration("horizon", horizon)), _width(horizon, cells_per_horizon)
    keys = list(keys)
    ids = _cells_per_id(arrivals, keys)
    if already_counted is not None:
        last = already_counted.groupBy(*keys).agg(F.max(F.unix_micros("counted_at")).alias("_last"))
        ids = ids.join(last, keys, "left")
    else:
        ids = ids.withColumn("_last", F.lit(None).cast("bigint"))
    # the last counted arrival is the head of the chain; it is not counted again
    chains = _walk(ids.withColumn("_kept", F.array_compact(F.array("_last"))), reach).checkpoint()
    finished = _finished(chains, keys)
    while not (stuck := chains.filter("_stuck is not null")).isEmpty():
        chains = _resolve(arrivals, stuck, keys, reach, width).checkpoint()
        finished = finished.unionByName(_finished(chains, keys))
    fresh = F.filter("_kept", lambda t: F.col("_last").isNull() | (t > F.col("_last")))
    return finished.select(*keys, F.explode(fresh).alias("_t")).select(
        *keys, F.timestamp_micros("_t").alias("counted_at")
    )


def _finished(chains: DataFrame, keys: list[str]) -> DataFrame:
    return chains.filter("_stuck is null").select(*keys, "_last", "_kept")


def _arrivals(events: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """The distinct arrivals `_t` of each id, their numbers `_n` and cells. A hot id is spread over its arrivals."""
    arrivals = events.select(*keys, F.unix_micros(at).alias("_t")).groupBy(*keys, "_t").agg(F.count("*").alias("_n"))
    return arrivals.withColumn("_cell", slice_start(F.col("_t"), width))


def _cells_per_id(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    cells = arrivals.groupBy(*keys, "_cell").agg(
        F.min("_t").alias("lo"),
        F.max("_t").alias("hi"),
        F.count("*").alias("n"),
        F.try_sum(F.col("_t") - F.col("_cell")).alias("_offsets"),
    )
    # of three arrivals the middle one is what the sum leaves
    middle = F.when(F.col("n") == 3, F.col("_offsets") + 3 * F.col("_cell") - F.col("lo") - F.col("hi"))
    cell = F.struct("lo", "hi", "n", middle.alias("mid"))
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))


def _walk(ids: DataFrame, reach: int) -> DataFrame:
    """Walk each chain on from `_kept` over its sorted cells, up to the first cell that needs a lookup."""
    none = F.lit(None).cast("bigint")
    start = F.struct(F.col("_kept").alias("kept"), none.alias("stuck"))

    def step(chain: Column, cell: Column) -> Column:
        kept_so_far = chain["kept"]
        expiry = F.get(kept_so_far, F.size(kept_so_far) - 1) + F.lit(reach)

        def keep(value: Column) -> Column:
            return F.struct(F.concat(kept_so_far, F.array(value)).alias("kept"), none.alias("stuck"))

        return (
            F.when(chain["stuck"].isNotNull(), chain)
            .when(expiry.isNull() | (cell["lo"] > expiry), keep(cell["lo"]))
            .when(cell["hi"] <= expiry, chain)
            .when(cell["n"] == 2, keep(cell["hi"]))
            .when(cell["n"] == 3, keep(F.when(cell["mid"] > expiry, cell["mid"]).otherwise(cell["hi"])))
            .otherwise(F.struct(kept_so_far.alias("kept"), cell["lo"].alias("stuck")))
        )

    # most ids need no walk: all their arrivals fall within one horizon
    head = F.get("_kept", F.size("_kept") - 1)
    first, latest = F.get("_cells", F.lit(0))["lo"], F.get("_cells", F.size("_cells") - 1)["hi"]
    one = F.struct(F.array(first).alias("kept"), none.alias("stuck"))
    chain = (
        F.when(head.isNull() & (latest <= first + F.lit(reach)), one)
        .when(latest <= head + F.lit(reach), start)
        .otherwise(F.aggregate("_cells", start, step))
    )
    walked = ids.withColumn("_chain", chain)
    stuck = F.col("_chain.stuck")
    return walked.select(
        *[c for c in ids.columns if c not in ("_cells", "_kept")],
        F.col("_chain.kept").alias("_kept"),
        stuck.alias("_stuck"),
        # cells still ahead, kept only where the walk has to go on
        F.when(stuck.isNotNull(), F.filter("_cells", lambda c: c["lo"] >= stuck)).alias("_cells"),
    )


def _resolve(arrivals: DataFrame, stuck: DataFrame, keys: list[str], reach: int, width: int) -> DataFrame:
    """Look up the first arrival past the expiry inside the stuck cell, then walk on.

    Joining on the cell as well spreads a hot id over its cells when the join has to shuffle.
    """
    wanted = stuck.withColumns(
        {"_expiry": F.element_at("_kept", -1) + F.lit(reach), "_cell": slice_start(F.col("_stuck"), width)}
    )
    candidates = arrivals.join(wanted.select(*keys, "_cell", "_expiry"), [*keys, "_cell"])
    found = candidates.filter("_t > _expiry").groupBy(*keys).agg(F.min("_t").alias("_next"))
    ahead = wanted.join(found, keys).select(
        *keys,
        "_last",
        F.concat("_kept", F.array("_next")).alias("_kept"),
        F.filter("_cells", lambda c: c["lo"] > F.col("_stuck")).alias("_cells"),
    )
    return _walk(ahead, reach)
