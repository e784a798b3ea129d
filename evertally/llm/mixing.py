"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, repeated up to `max_repeats` times. A copy finishes at
the words of its source up to and including it, divided by the source's target; copies are taken in the global
order of their finish times until the budget is spent, so every source comes near its target.

Running sums never gather a source: documents are summed per slice of the shuffle order first, slices are summed
per source, and rows are ordered only inside a slice. The global cut is found the same way over slices of finish
times.

Defined results: a null or empty text has size 0, is never taken and returns with `taken` 0; a null source is a
source, the last one; a null id is shuffled by its text; repeated rows are separate copies, ordered by size where
ids tie; empty tables give empty results. `mixed` keeps extra columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Rows that are ordered together, and slices at most.
SLICE_ROWS, MAX_SLICES = 2000, 100_000


def size_in_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """source, source_size, n_rows, target of (source, size) rows.

    Sources in code point order, null last, take the weights in turn. Sources whose share is above `max_repeats`
    times their size stop there, and the excess is shared again by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    weighed = weighed.withColumn("most", (max_repeats * F.col("source_size")).cast("double"))
    weighed = weighed.withColumn("budget", share * F.sum("source_size").over(everything))
    # sources by the level at which they stop; one stops if the level without all earlier ones reaches it
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    stops = F.col("most") * rest <= F.col("weight") * (F.col("budget") - spent)
    weighed = weighed.withColumn("stops", stops)
    capped = F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    share_of = F.col("weight") * (F.col("budget") - capped) / open_weight
    return weighed.select(
        "source", "source_size", "n_rows", F.when(F.col("stops"), F.col("most")).otherwise(share_of).alias("target")
    )


def _slices(rows: int) -> int:
    return max(1, min(MAX_SLICES, rows // SLICE_ROWS))


def _slice_of(order: str, slices: int) -> Column:
    """Slice of a hexadecimal digest; its first eight digits spread evenly over the slices, in order."""
    return F.shiftright(F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") * slices, 32).cast("int")


class Mix:
    """The plan of a mix: targets, words per slice of each source, and where the budget ends.

    Making one runs the jobs that find these; `copies` and `mixed` are lazy.
    """

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
    ):
        self.columns = doc_id, text, source
        self.seed = seed
        self.max_repeats = max_repeats
        self.sized = written(docs.select(self.key().alias("key")), "sized")
        sizes = self.sized.select("key.source", "key.size")
        self.targets = written(source_targets(sizes, weights, share, max_repeats), "targets")
        largest, rows, words = self.targets.agg(F.max("n_rows"), F.sum("n_rows"), F.sum("source_size")).first()
        self.slices = _slices(largest or 0)
        sums = self.sized.withColumn("slice", _slice_of("key.order", self.slices))
        sums = sums.groupBy("key.source", "slice").agg(F.sum("key.size").alias("words"))
        before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier")
        self.offsets = written(sums.select("source", "slice", earlier), "offsets")
        self.time_slices = _slices(max_repeats * (rows or 0))
        self.end = self._end(share * (words or 0))

    def key(self) -> Column:
        """What places a document: its source, its size, and its position in the shuffle."""
        doc_id, text, source = self.columns
        named = F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit(""))
        return F.struct(
            F.col(source).alias("source"),
            F.md5(F.concat(F.lit(f"{self.seed}:"), named)).alias("order"),
            size_in_words(text).alias("size"),
        )

    def timed(self, rows: DataFrame) -> DataFrame:
        """Rows with a `key`, with their source's figures and `finishes`, the finish time of each copy."""
        rows = rows.withColumn("slice", _slice_of("key.order", self.slices))
        inside = Window.partitionBy("key.source", "slice").orderBy("key.order", "key.size")
        inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("within", F.sum("key.size").over(inside))
        offsets = self.offsets.withColumnsRenamed({"source": "of", "slice": "part"})
        targets = self.targets.select(F.col("source").alias("owner"), "source_size", "target")
        same = F.col("key.source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("part"))
        rows = rows.join(offsets, same, "left").join(targets, F.col("key.source").eqNullSafe(F.col("owner")), "left")
        words = F.col("earlier") + F.col("within")
        finishes = [
            (words + n * F.col("source_size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))
            for n in range(self.max_repeats)
        ]
        return rows.withColumn("finishes", F.when(F.col("key.size") > 0, F.array(*finishes)))

    def _time_slice(self, at: Column) -> Column:
        return F.floor(at * self.time_slices)

    def _end(self, budget: float):
        """(slice, time, order) of the last copy that fits; copies at the same place are taken together."""
        copies = self.timed(self.sized).select(F.explode("finishes").alias("at"), "key.order", "key.size")
        copies = written(copies.withColumn("slice", self._time_slice(F.col("at"))), "copies")
        running = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = copies.groupBy("slice").agg(F.sum("size").alias("words"))
        border = sums.withColumn("running", F.sum("words").over(running)).filter(F.col("running") > budget)
        border = border.orderBy("slice").first()
        if border is None:  # everything fits
            return None
        inside = Window.orderBy("at", "order")  # up to and including all copies of the same place
        last = copies.filter(F.col("slice") == border["slice"])
        last = last.withColumn("running", border["running"] - border["words"] + F.sum("size").over(inside))
        last = last.filter(F.col("running") <= budget).orderBy(F.desc("at"), F.desc("order")).first()
        return border["slice"], last and last["at"], last and last["order"]

    def fits(self, at: Column, order: Column) -> Column:
        if self.end is None:
            return F.lit(True)
        slice_, last_at, last_order = self.end
        before = self._time_slice(at) < slice_
        if last_at is None:
            return before
        inside = (at < last_at) | ((at == F.lit(last_at)) & (order <= F.lit(last_order)))
        return before | ((self._time_slice(at) == slice_) & inside)


def mix_report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, and the words that the mix takes."""
    mix = Mix(docs, doc_id, **options)
    rows = mix.timed(docs.select(F.col(doc_id).alias("doc_id"), mix.key().alias("key")))
    copies = F.size(F.filter("finishes", lambda at: mix.fits(at, F.col("key.order"))))
    return rows.select(
        "doc_id", "key.source", "key.size", "source_size", "target",
        (F.coalesce(F.greatest(copies, F.lit(0)), F.lit(0)) * F.col("key.size")).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The copies of the documents that the mix takes, all columns, globally sorted by finish time."""
    mix = Mix(docs, doc_id, **options)
    rows = mix.timed(docs.select(F.struct("*").alias("document"), mix.key().alias("key")))
    rows = rows.select("document", "key", F.explode("finishes").alias("at"))
    rows = rows.filter(mix.fits(F.col("at"), F.col("key.order")))
    return rows.orderBy("at", "key.order").select("document.*")
