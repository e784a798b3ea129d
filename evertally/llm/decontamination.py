"""Benchmark decontamination with generalised suffix automata of the normalised test items.

The items become sequences of word numbers; an automaton of them, of bounded size, is broadcast, and every
document streams its words through it and keeps the longest matching length at each word. A word is hit if it
lies in an occurrence of `window` consecutive item words, or of a whole item that has fewer. Only stretches
whose neighbouring words are also neighbours in some item can hold an occurrence, so only these are streamed.

Defined results: a null or empty text has no words and no hits; items without words match nothing; items
without an id take part in hits but are not listed; repeated items count once; rows are judged one by one, so
repeated rows and ties need no rule; empty tables give empty results. Extra columns of the documents are kept
by `decontaminated` and never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evertally.llm import words as w
from evertally.llm.suffix_automaton import SuffixAutomaton
from evertally.llm.tables import fresh_name, written

WINDOW = 10
#: A document of which more than this part is hit goes as a whole.
MAX_COVERAGE = 0.5
#: Item text per automaton, and automata that one pass over the documents holds.
SHARD_BYTES = 500_000
SHARDS_PER_PASS = 4


def normalised(column: pa.Array) -> Iterator[tuple[int, w.Words]]:
    """Words: runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case."""
    return w.words_by_slice(column, w.ALPHANUMERIC, w.ASCII_LOWER)


@dataclass
class ItemIndex:
    """One shard of items, as an automaton over word numbers."""

    window: int
    vocabulary: np.ndarray
    neighbours: np.ndarray
    automaton: SuffixAutomaton
    window_state: list[int]
    shortest: int
    names: list[str | None]
    items: dict[int, set[int]] = field(default_factory=dict)
    whole: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    holds_whole: list[bool] = field(default_factory=list)

    @classmethod
    def build(cls, names: list[str | None], texts: list[str | None], window: int) -> ItemIndex:
        found = list(normalised(pa.array(texts, type=pa.large_string())))
        hashes = [part.hashes for _, part in found]
        vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, dtype=np.uint64)
        sequences = [
            np.searchsorted(vocabulary, part.hashes[part.first[r] : part.first[r + 1]])
            for _, part in found
            for r in range(part.rows)
        ]
        pairs = [s[:-1] * len(vocabulary) + s[1:] for s in sequences if len(s) > 1]
        neighbours = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
        automaton = SuffixAutomaton()
        for sequence in sequences:
            automaton.add(sequence.tolist())
        lengths = [len(s) for s in sequences if len(s)]
        index = cls(
            window, vocabulary, neighbours, automaton, automaton.at_length(window),
            min([window, *lengths]), names,
        )
        for item, sequence in enumerate(sequences):
            index._register(item, sequence.tolist())
        index._mark_holders()
        return index

    def _register(self, item: int, sequence: list[int]) -> None:
        for state, matched in self.automaton.stream(sequence):
            if matched >= self.window:
                self.items.setdefault(self.window_state[state], set()).add(item)
        if 0 < len(sequence) < self.window:
            self.whole.setdefault(state, []).append((len(sequence), item))

    def _mark_holders(self) -> None:
        """States of which a suffix is a whole short item."""
        automaton = self.automaton
        self.holds_whole = [False] * len(automaton)
        for state in sorted(range(1, len(automaton)), key=automaton.length.__getitem__):
            self.holds_whole[state] = state in self.whole or self.holds_whole[automaton.link[state]]

    def occurrences(self, symbols: list[int]) -> Iterator[tuple[int, int, Iterable[int]]]:
        """(start, end, items) of each occurrence in a stretch of word numbers."""
        for at, (state, matched) in enumerate(self.automaton.stream(symbols), start=1):
            if matched >= self.window:
                yield at - self.window, at, self.items[self.window_state[state]]
            if self.holds_whole[state]:
                while state > 0:
                    for length, item in self.whole.get(state, ()):
                        if length <= matched:
                            yield at - length, at, (item,)
                    state = self.automaton.link[state]

    def stretches(self, part: w.Words) -> Iterator[tuple[int, int, list[int]]]:
        """(row, first word, word numbers) of the stretches that can hold an occurrence."""
        known, number = w.member(part.hashes, self.vocabulary)
        if not known.any():
            return
        joined = np.zeros(len(part) + 1, dtype=bool)  # joined[i]: words i - 1 and i may follow each other
        joined[1:-1] = known[:-1] & known[1:]
        joined[part.first[:-1][part.counts() > 0]] = False
        both = np.flatnonzero(joined)
        joined[both] = w.member(number[both - 1] * len(self.vocabulary) + number[both], self.neighbours)[0]
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long_enough = ends - starts >= self.shortest
        starts, ends = starts[long_enough], ends[long_enough]
        rows = np.searchsorted(part.first, starts, side="right") - 1
        for row, start, end in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield row, start, number[start:end].tolist()


def item_shards(benchmark: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, int]:
    """(shard, index) of all items, as a written table, and the number of shards; each holds about SHARD_BYTES of text.

    Every index is built by a task from its items. The driver sees none of the items.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    items = items.filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).cast("bigint")).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))

    def build(shard: pa.Table) -> pa.Table:
        index = ItemIndex.build(shard.column("item").to_pylist(), shard.column("text").to_pylist(), window)
        return pa.table({"shard": shard.column("shard").slice(0, 1), "index": w.binary_column([pickle.dumps(index)])})

    items = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(count)))
    return written(items.groupBy("shard").applyInArrow(build, "shard bigint, index binary"), "item_indexes"), count


def merged_spans(hit: np.ndarray) -> list[int]:
    """Start, end, start, end ... of the runs that are hit."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def _without(part: w.Words, row: int, data: bytes, base: int, spans: list[int]) -> str:
    """The text of a row without the words in the spans and what parts them from the next word."""
    kept, at = [], 0
    first, count = int(part.first[row]), int(part.first[row + 1] - part.first[row])
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(data[at : int(part.starts[first + start]) - base])
        at = int(part.starts[first + end] if end < count else part.ends[first + end - 1]) - base
    return b"".join([*kept, data[at:]]).decode()


def marked(
    docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, clean: bool = False,
) -> tuple[DataFrame, dict[str, str]]:
    """`carry` columns of each document with its number of words, hit spans (start, end, ... in words) and items.

    With `clean`, the text among the carried columns is without the hit words. The names of the added columns,
    fresh ones if the documents have such columns, come second.
    """
    names = {added: fresh_name(docs.columns, added) for added in ("n_words", "spans", "items")}
    added = T.StructType(
        [
            T.StructField(names["n_words"], T.LongType()),
            T.StructField(names["spans"], T.ArrayType(T.IntegerType())),
            T.StructField(names["items"], T.ArrayType(T.StringType())),
        ]
    )
    shards, count = item_shards(benchmark, item_id, item_text, window)
    rows = docs.select(*dict.fromkeys([*carry, text]))
    for first in range(0, count, SHARDS_PER_PASS):
        last = first + SHARDS_PER_PASS >= count
        # the indexes of one pass at a time go through the driver, packed, as a broadcast does
        group = shards.filter(F.col("shard").between(first, first + SHARDS_PER_PASS - 1)).orderBy("shard").collect()
        group = docs.sparkSession.sparkContext.broadcast([bytes(row["index"]) for row in group])
        kept = carry if last else rows.columns[: len(dict.fromkeys([*carry, text]))]
        schema = T.StructType([rows.schema[column] for column in kept] + added.fields)
        rows = rows.mapInArrow(_scanner(group, kept, text, names, clean and last), schema)
        if not last:
            rows = written(rows, "marked")
            group.unpersist()
    return rows, names


def _scanner(shards, kept: list[str], text: str, names: dict[str, str], clean: bool):
    @w.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [pickle.loads(index) for index in shards.value]
        for batch in batches:
            texts = batch.column(text)
            earlier = None
            if names["spans"] in batch.schema.names:
                earlier = batch.column(names["spans"]).to_pylist(), batch.column(names["items"]).to_pylist()
            counts, spans, items, cleaned = [], [], [], {}
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) if clean else None
            for base, part in normalised(texts):
                hit = np.zeros(len(part), dtype=bool)
                named: dict[int, set[str]] = {}
                for index in indexes:
                    for row, start, symbols in index.stretches(part):
                        for begin, end, found in index.occurrences(symbols):
                            hit[start + begin : start + end] = True
                            named.setdefault(row, set()).update(
                                index.names[i] for i in found if index.names[i] is not None
                            )
                touched = set((np.searchsorted(part.first, np.flatnonzero(hit), side="right") - 1).tolist())
                if earlier:
                    touched |= {r for r in range(part.rows) if earlier[0][base + r]}
                counts.append(part.counts())
                for row in range(part.rows):
                    if row not in touched:
                        spans.append([])
                        items.append([])
                        continue
                    own = hit[part.first[row] : part.first[row + 1]]
                    if earlier:
                        for start, end in zip(earlier[0][base + row][::2], earlier[0][base + row][1::2], strict=True):
                            own[start:end] = True
                        named.setdefault(row, set()).update(earlier[1][base + row])
                    spans.append(merged_spans(own))
                    items.append(sorted(named.get(row, ())))
                    if clean:
                        data = texts[base + row].as_py().encode()
                        offset = int(ends[base + row] - len(data) - (ends[base - 1] if base else 0))
                        cleaned[base + row] = _without(part, row, data, offset, spans[-1])
            columns = []
            for name in kept:
                column = batch.column(name)
                if clean and name == text and cleaned:
                    changed = np.zeros(len(column), dtype=bool)
                    changed[list(cleaned)] = True
                    texts_left = pa.array([cleaned[row] for row in sorted(cleaned)], type=column.type)
                    column = pc.replace_with_mask(column, pa.array(changed), texts_left)
                columns.append(column)
            total = np.concatenate(counts) if counts else np.empty(0, dtype=np.int64)
            columns += [
                pa.array(total, type=pa.int64()),
                pa.array(spans, type=pa.list_(pa.int32())),
                pa.array(items, type=pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names.values()])

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans."""
    rows, names = marked(docs, benchmark, [doc_id], **options)
    spans, items = F.col(names["spans"]), F.col(names["items"])
    # ends minus starts
    n_hit = F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return rows.select(
        F.col(doc_id),
        F.col(names["n_words"]).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
        spans.alias("hit_spans"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE, **options
) -> DataFrame:
    """The documents without the hit words; a document of which more than `max_coverage` is hit goes."""
    rows, names = marked(docs, benchmark, docs.columns, text=text, clean=True, **options)
    n_hit = F.aggregate(
        F.transform(names["spans"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return rows.filter(n_hit <= max_coverage * F.col(names["n_words"])).select(*docs.columns)
