"""Language-model scores by context-tree weighting over bytes, and by a plain word model beside it.

A byte is eight binary decisions, so it is a walk down a binary tree of 255 nodes. Each of these nodes has its own
tree of contexts: the up to `DEPTH` bytes before the predicted one, the latest first. A context node counts the zeros
and ones decided after it in the training texts; its Krichevsky-Trofimov estimate competes with the product of its
children, half and half, which gives it a weight to stop at that depth. A decision is predicted by the mixture of the
estimates along its context with these weights; contexts never seen leave their weight to the longest one seen.
Texts are lower-cased (A-Z), preceded by `DEPTH` bytes 0xFF and ended by one, which no UTF-8 text holds. The score is
the log10 probability of the bytes and the end; `bits_per_byte` is the code length over their number.

How it runs: tasks count byte strings of length `DEPTH` + 1 and words of their texts, a slice at a time; Spark sums
the counts of all documents. The counts of strings that only held-out texts hold are 0 but they stay in the table, so
that it has the probability of every string that is to be scored. Trees are split after `HEAD` bytes of context: the
deeper part of a context is computed in chunks that hold it whole (at most 256^(DEPTH - HEAD + 1) strings), the upper
part per node of the binary tree (at most 256^HEAD rows). Both bounds come from the alphabet, not from the corpus.
To score, the probabilities of the `FREQUENT` most frequent strings and words are broadcast, which is a bounded size; what
is not among them is left in the document's row and joined with the whole table. Nothing is dropped or approximated.

Defined results: a null text is empty; an empty text has one token, the end, and the probability of ending at once; a
null id counts as the empty text for the fold; repeated rows are scored and counted each; very long texts are taken in
slices to their end; without training texts every decision has probability one half; empty tables give empty results;
other columns are ignored. Words are told apart by 64 bits of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evertally.llm.tables import written
from evertally.llm.words import ASCII_LOWER, NOT_SPACE, SLICE_BYTES, find_words, lean, member, text_slices

DEPTH, HEAD = 5, 3
#: Entries of each kind that are broadcast (16 bytes each), entries that a task merges before it emits, strings of a chunk.
FREQUENT, MERGE_ENTRIES, CHUNK = 1 << 20, 1 << 21, 1 << 18
#: Text that a task scores at once, unless one text is longer; what the broadcast tables lack is held for as much.
PIECE_BYTES = 4 << 20
WORD, STRING = 0, 1
END_WORD = np.int64(-(1 << 63))  # key of the end among the words
EDGE = 0xFF

U64 = np.uint64


# Counting


def byte_strings(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, string) for every byte of the rows and for their ends, in pieces; a string is its context, latest byte
    first, then the byte."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), lengths)
    padded = np.full(len(data) + rows * (DEPTH + 1), EDGE, dtype=np.uint8)
    padded[np.arange(len(data)) + row_of * (DEPTH + 1) + DEPTH] = ASCII_LOWER[data]
    starts = offsets[:-1] + np.arange(rows) * (DEPTH + 1)
    for low in range(DEPTH, len(padded), SLICE_BYTES):
        high = min(low + SLICE_BYTES, len(padded))
        keys = np.zeros(high - low, dtype=U64)
        for back in [*range(1, DEPTH + 1), 0]:
            keys <<= U64(8)
            keys |= padded[low - back : high - back]
        at = np.arange(low, high)
        row = np.searchsorted(starts, at, side="right") - 1
        predicted = at - starts[row] >= DEPTH
        yield row[predicted], keys[predicted].view(np.int64)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with their sums."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[order], first) for c in counts)


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, times in training rows, times in all)."""
    parts = []
    for flag in (True, False):
        found, times = np.unique(keys[training == flag], return_counts=True)
        parts.append((found, times if flag else np.zeros_like(times), times))
    return summed(*map(np.concatenate, zip(*parts, strict=True)))


COUNTS = "kind tinyint, key bigint, train bigint, total bigint"


@lean
def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, train, total) of rows (text, training), partly summed."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {WORD: [], STRING: []}

    def merged(kind: int) -> None:
        if held[kind]:
            columns = list(map(np.concatenate, zip(*held[kind], strict=True)))
            held[kind].clear()  # the parts are not needed beside their copies
            held[kind].append(summed(*columns))

    def emitted(kind: int) -> Iterator[pa.RecordBatch]:
        for keys, train, total in held[kind]:
            for at in range(0, len(keys), CHUNK):
                part = slice(at, at + CHUNK)
                kinds = np.full(len(keys[part]), kind, dtype=np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, keys[part], train[part], total[part])], ["kind", "key", "train", "total"])
        held[kind] = []

    for batch in batches:
        training = batch.column("training").to_numpy(zero_copy_only=False)
        ends = np.array([training.sum()]), np.array([len(training)])
        held[WORD].append((np.array([END_WORD]), *(e.astype(np.int64) for e in ends)))
        for row, data, offsets in text_slices(batch.column("text")):
            words = find_words(data, offsets, NOT_SPACE, ASCII_LOWER)
            held[WORD].append(_counted(words.hashes.view(np.int64), training[row + words.row_of_word()]))
            for rows, strings in byte_strings(data, offsets):
                held[STRING].append(_counted(strings, training[row + rows]))
            for kind in held:
                if sum(len(part[0]) for part in held[kind]) > MERGE_ENTRIES:
                    merged(kind)
                    if len(held[kind][0][0]) > MERGE_ENTRIES // 2:
                        yield from emitted(kind)
    for kind in held:
        merged(kind)
        yield from emitted(kind)


def corpus_counts(docs: DataFrame, training: Column, text: str) -> DataFrame:
    """How often each word and byte string occurs in the training texts and in all."""
    rows = docs.select(F.col(text).alias("text"), training.alias("training"))
    counted = rows.mapInArrow(_count_batches, COUNTS)
    return counted.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


# Trees


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    rising = x.copy()
    for step in range(1, 8):
        rising *= x + step
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(rising)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth for one binary decision: `of` is the node of each entry, `first` an entry of each node."""

    def __init__(self, order: np.ndarray, sorted_nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        new = np.concatenate([[True], sorted_nodes[1:] != sorted_nodes[:-1]])
        first = np.flatnonzero(new)
        self.of = np.empty(len(order), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[first]
        self.zeros, self.ones = np.add.reduceat(zeros[order], first), np.add.reduceat(ones[order], first)
        self.seen = self.zeros + self.ones > 0
        self.estimate = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        self.log = log_estimate(self.zeros, self.ones)
        self.stop = np.ones(len(first))

    def over(self, child: Level) -> None:
        """Mixes the node's own estimate with the product of its children, half and half."""
        below = np.bincount(self.of[child.first], child.log, len(self.first))
        self.stop = 1 / (1 + np.exp(np.clip(below - self.log, -700, 700)))
        self.log = np.logaddexp(self.log, below) - math.log(2)


class Mixture:
    """Prediction of a decision down its context: what is settled, what weight is left, the last estimate seen."""

    def __init__(self, settled: np.ndarray, left: np.ndarray, last: np.ndarray, seen: np.ndarray):
        self.settled, self.left, self.last, self.seen = settled, left, last, seen

    def take(self, level: Level) -> None:
        at = level.of
        self.seen = self.seen & level.seen[at]
        estimate, stop = level.estimate[at], level.stop[at]
        self.settled = self.settled + np.where(self.seen, self.left * stop * estimate, 0.0)
        self.last = np.where(self.seen, estimate, self.last)
        self.left = np.where(self.seen, self.left * (1 - stop), self.left)

    def probability_of_one(self) -> np.ndarray:
        return self.settled + self.left * self.last


def deep_levels(strings: np.ndarray, train: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[Level]]]:
    """Per bit of the byte: (node of the binary tree, the bit, levels from HEAD to DEPTH, weighed)."""
    contexts, symbols = strings >> 8, strings & 255
    orders = []
    for depth in range(HEAD, DEPTH + 1):
        keys = (contexts >> 8 * (DEPTH - depth) << 8) | symbols
        order = np.argsort(keys, kind="stable")
        orders.append((order, keys[order]))
    for bit in range(8):
        node = (1 << bit) | (symbols >> (8 - bit))
        one = (symbols >> (7 - bit)) & 1
        counts = np.where(one == 0, train, 0.0), np.where(one == 1, train, 0.0)
        levels = [Level(order, keys >> (8 - bit), *counts) for order, keys in orders]
        for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
            upper.over(lower)
        yield node, one, levels


def _whole_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about CHUNK rows that cut between heads; rows come sorted by `head`."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            table = pa.Table.from_batches(held)
            heads = table.column("head").to_numpy()
            cut = int(np.searchsorted(heads, heads[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


HEADS = "head bigint, node int, zeros double, ones double, log double"


@lean
def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes at depth HEAD of rows (head, string, train)."""
    for table in _whole_heads(batches):
        strings, train = table.column("string").to_numpy(), table.column("train").to_numpy().astype(float)
        for node, _, levels in deep_levels(strings, train):
            top = levels[0]
            heads = strings[top.first] >> 8 * (DEPTH - HEAD + 1)
            columns = [heads, node[top.first].astype(np.int32), top.zeros, top.ones, top.log]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["head", "node", "zeros", "ones", "log"])


UPPER = "head bigint, node int, settled double, left double, last double"


def _upper_mixture(table: pa.Table) -> pa.Table:
    """For one node of the binary tree: the mixture over the depths above HEAD, for each head."""
    heads, zeros, ones, log = (table.column(c).to_numpy() for c in ("head", "zeros", "ones", "log"))
    order = np.argsort(heads, kind="stable")
    levels = [Level(order, heads[order] >> 8 * (HEAD - depth), zeros, ones) for depth in range(HEAD + 1)]
    levels[HEAD].log = log[levels[HEAD].first]
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        upper.over(lower)
    size = len(heads)
    mixture = Mixture(np.zeros(size), np.ones(size), np.full(size, 0.5), np.ones(size, dtype=bool))
    for level in levels[:HEAD]:
        mixture.take(level)
    columns = [pa.array(heads), table.column("node"), *map(pa.array, (mixture.settled, mixture.left, mixture.last))]
    return pa.table(columns, ["head", "node", "settled", "left", "last"])


VALUES = "key bigint, total bigint, value double"


@lean
def _string_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 probability of each string, from rows of the strings and of the upper mixtures of their heads."""
    for table in _whole_heads(batches):
        upper = table.filter(pc.is_valid(table.column("node")))
        table = table.filter(pc.is_valid(table.column("string")))
        strings, train = table.column("string").to_numpy(), table.column("train").to_numpy().astype(float)
        known = (upper.column("head").to_numpy() << 8) | upper.column("node").to_numpy()
        order = np.argsort(known, kind="stable")
        known = known[order]
        settled, left, last = (upper.column(c).to_numpy()[order] for c in ("settled", "left", "last"))
        value = np.zeros(len(strings))
        for node, one, levels in deep_levels(strings, train):
            at = np.searchsorted(known, (strings >> 8 * (DEPTH - HEAD + 1) << 8) | node)
            mixture = Mixture(settled[at], left[at], last[at], np.ones(len(at), dtype=bool))
            for level in levels:
                mixture.take(level)
            probability = mixture.probability_of_one()
            value += np.log10(np.where(one == 1, probability, 1 - probability))
        yield pa.RecordBatch.from_arrays(
            [table.column("string").combine_chunks(), table.column("total").combine_chunks(), pa.array(value)], ["key", "total", "value"]
        )


def string_values(counts: DataFrame) -> DataFrame:
    """(key, total, value): the log10 probability of each counted byte string after its context."""
    head = F.shiftright(F.col("key"), 8 * (DEPTH - HEAD + 1))
    strings = counts.filter(F.col("kind") == STRING)
    strings = strings.select(head.alias("head"), F.col("key").alias("string"), "train", "total")
    by_head = strings.repartition("head").sortWithinPartitions("head")
    heads = by_head.select("head", "string", "train").mapInArrow(_deep_nodes, HEADS)
    upper = written(heads.groupBy("node").applyInArrow(_upper_mixture, UPPER), "upper_mixtures")
    both = strings.unionByName(upper, allowMissingColumns=True)
    return both.repartition("head").sortWithinPartitions("head").mapInArrow(_string_values, VALUES)


# Scoring


def frequent_from(values: DataFrame, most: int) -> int:
    """The least `total` at which at most `most` entries have that many or more. Counts above 1,024 go by powers of 2."""
    total = F.col("total")
    power = F.pow(F.lit(2.0), F.floor(F.log2(total))).cast("bigint")
    steps = values.groupBy(F.when(total <= 1024, total).otherwise(power).alias("step")).count()
    taken, least = 0, 1 << 62
    for step, entries in sorted(steps.collect(), reverse=True):  # at most 1,024 + 53 rows
        taken += entries
        if taken > most:
            break
        least = step
    return least


def _sorted_pair(values: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    table = values.filter(F.col("total") >= least).select("key", "value").toArrow()
    keys, found = table.column("key").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], found[order]


PARTIAL = """row bigint, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double,
 rare array<struct<kind:tinyint,key:bigint,times:bigint>>"""


def _looked_up(rows: np.ndarray, keys: np.ndarray, table: tuple[np.ndarray, np.ndarray], size: int):
    """(sum of values per row, entries found per row with value, and (row, key, times) of what the table does not hold)."""
    distinct, at = np.unique(keys, return_inverse=True)
    known, where = member(distinct, table[0])
    value = np.where(known, table[1][where], 0.0) if len(table[0]) else np.zeros(len(distinct))
    rare = ~known[at]
    order = np.lexsort((keys[rare], rows[rare]))
    row, key = rows[rare][order], keys[rare][order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.empty(0, int)
    return value[at], known[at], (row[new], key[new], np.diff(np.append(new, len(row))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in batches of about PIECE_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def _scorer(words, strings, columns: list[str], total: int):
    """A function for mapInArrow; `words` and `strings` are broadcast (keys, values); a word's value is its training count."""

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        done = 0
        for batch in _pieces(batches):
            size = batch.num_rows
            tokens, known, base, log = (np.zeros(size) for _ in range(4))
            n_bytes = np.zeros(size, dtype=np.int64)
            rare = []

            def words_of(rows, keys):
                count, found, (row, key, times) = _looked_up(rows, keys, words.value, size)
                tokens[:] += np.bincount(rows, minlength=size)
                known[:] += np.bincount(rows[found & (count > 0)], minlength=size)
                base[:] += np.bincount(rows[found], np.log10((count[found] + 1) / total), size)
                rare.append((row, key, times, np.full(len(row), WORD)))

            words_of(np.arange(size), np.full(size, END_WORD))
            for start, data, offsets in text_slices(batch.column("text")):
                n_bytes[start : start + len(offsets) - 1] = np.diff(offsets)
                found = find_words(data, offsets, NOT_SPACE, ASCII_LOWER)
                words_of(start + found.row_of_word(), found.hashes.view(np.int64))
                for rows, keys in byte_strings(data, offsets):
                    rows = start + rows
                    value, _, (row, key, times) = _looked_up(rows, keys, strings.value, size)
                    log += np.bincount(rows, value, size)
                    rare.append((row, key, times, np.full(len(row), STRING)))
            row, key, times, kind = map(np.concatenate, zip(*rare, strict=True))
            order = np.argsort(row, kind="stable")
            entries = pa.StructArray.from_arrays(
                [pa.array(kind[order].astype(np.int8)), pa.array(key[order]), pa.array(times[order])], ["kind", "key", "times"]
            )
            bounds = np.searchsorted(row[order], np.arange(size + 1)).astype(np.int32)
            made = [np.arange(size) + task + done, n_bytes, tokens.astype(np.int64), known.astype(np.int64), base, log]
            arrays = [batch.column(name) for name in columns] + [pa.array(m) for m in made]
            names = ["row", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rare"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(bounds), entries)], [*columns, *names])
            done += size

    return score


def lm_scores(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, learned (whether it is a training row), n_bytes, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), training.alias("learned"), F.col(text).alias("text"))
    counts = written(corpus_counts(rows, F.col("learned"), "text"), "corpus_counts")
    words = counts.filter(F.col("kind") == WORD)
    train_tokens, distinct = words.agg(
        F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))
    ).first()
    words = words.select("key", "total", F.col("train").cast("double").alias("value"))
    strings = written(string_values(counts), "string_values")
    least = {WORD: frequent_from(words, FREQUENT), STRING: frequent_from(strings, FREQUENT)}
    sent = [spark.sparkContext.broadcast(_sorted_pair(v, least[k])) for k, v in ((WORD, words), (STRING, strings))]

    kept = rows.select("doc_id", "learned").schema
    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    total = train_tokens + distinct + 1
    partial = written(rows.mapInArrow(_scorer(*sent, kept.names, total), f"{shown}, {PARTIAL}"), "partial_scores")
    for table in sent:
        table.unpersist()

    rare = [
        values.filter(F.col("total") < least[kind]).select(F.lit(kind).cast("tinyint").alias("kind"), "key", "value")
        for kind, values in ((WORD, words), (STRING, strings))
    ]
    used = partial.select("row", F.inline("rare")).join(rare[0].unionByName(rare[1]), ["kind", "key"])
    is_word = F.col("kind") == WORD
    base = F.col("times") * F.log10((F.col("value") + 1) / F.lit(float(total)))
    rest = used.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(is_word & (F.col("value") > 0), F.col("times"))).alias("_known"),
        F.sum(F.when(is_word, base)).alias("_base"),
        F.sum(F.when(~is_word, F.col("times") * F.col("value"))).alias("_score"),
    )
    whole = partial.drop("rare").join(rest, F.col("row") == F.col("_row"), "left")

    def with_rest(name: str, other: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(other), F.lit(0))).alias(name)

    whole = whole.select(
        "doc_id", "learned", "n_bytes", "n_tokens", with_rest("n_known", "_known"),
        F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
        with_rest("base_score", "_base"), with_rest("score", "_score"),
    )
    return whole.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1))
