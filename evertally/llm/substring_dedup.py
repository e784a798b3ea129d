"""Removal of long passages that also occur in an earlier document, with suffix automata of reference shards.

A window is `window` consecutive words of one text. The corpus is its own reference, so its automata cannot be sent to
every task: each document streams only the pieces that can match, against the automaton of the shard that holds all
of their possible matches.

1. Of equal texts, only the one with the smallest id takes part; the others are removed as a whole at the end.
2. The anchor of a window is its smallest hashed group of ANCHOR_WORDS words, so equal windows have equal anchors.
   Anchors of one document only are dropped (a partial aggregate and a semi-join, so a hot anchor is never gathered).
3. The windows of one anchor, as one short sequence of words, are a piece. Equal pieces of a batch of documents are one
   before they go to the shard of their anchor; there, windows that are in one piece only are settled at once, and an
   automaton of the rest is annotated with the smallest id per window and matched with all pieces.
4. Pieces return to their documents, and every word covered by a window with an earlier start is removed.

Ids are integers. Defined results: a null or empty text has no words; a null id comes after all others, and null ids are
ordered by a hash of their texts; rows with the same id never remove words of each other; a text shorter than a window
stays whole; empty tables give empty results; extra columns are kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evertally.llm import words as w
from evertally.llm.suffix_automaton import SuffixAutomaton
from evertally.llm.tables import fresh_name, small_side, written

WINDOW = 13
ANCHOR_WORDS = 4
#: Bytes of a word's hash that stand for it inside a piece.
SYMBOL_BYTES = 5
#: Pieces per shard, about.
SHARD_PIECES = 20_000


def identity(doc_id: str, text: str) -> Column:
    """The id; a null one is above all real ones."""
    unnamed = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text), F.lit(1 << 40))
    return F.coalesce(F.col(doc_id).cast("bigint"), unnamed)


def row_key(doc_id: str, text: str) -> Column:
    """Stands for one id with one text."""
    return F.xxhash64(doc_id, text)


def anchors_of(part: w.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, the word at which each one's anchor starts); both ascend."""
    starts = part.windows(window)
    if not len(starts):
        return starts, starts
    length = min(ANCHOR_WORDS, window)
    groups = part.window_hashes(np.arange(len(part) - length + 1), length)
    least, anchor = groups[starts], starts.copy()
    for offset in range(1, window - length + 1):
        other = groups[starts + offset]
        smaller = other < least
        least[smaller] = other[smaller]
        anchor[smaller] = starts[smaller] + offset
    return starts, anchor


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(anchor, ident, row, at): every anchor of every document with its word position."""
    for batch in batches:
        ids, keys = batch.column("ident").to_numpy(), batch.column("row").to_numpy()
        for base, part in w.words_by_slice(batch.column("text"), w.NOT_SPACE):
            at = np.unique(anchors_of(part, window)[1])
            rows = np.searchsorted(part.first, at, side="right") - 1
            hashes = part.window_hashes(at, min(ANCHOR_WORDS, window)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes), pa.array(ids[base + rows]), pa.array(keys[base + rows]),
                    pa.array((at - part.first[rows]).astype(np.int32)),
                ],
                names=["anchor", "ident", "row", "at"],
            )


def _pieces(part: w.Words, flagged: np.ndarray, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, first word, anchor hash, symbols) of the windows of each flagged anchor."""
    starts, anchor = anchors_of(part, window)
    wanted = w.member(anchor, flagged)[0]
    starts, anchor = starts[wanted], anchor[wanted]
    if not len(starts):
        return
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1] + window
    rows = np.searchsorted(part.first, first, side="right") - 1
    hashes = part.window_hashes(anchor[new], min(ANCHOR_WORDS, window)).view(np.int64)
    symbols = np.ascontiguousarray(part.hashes.view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES]).tobytes()
    for row, a, b, anchor_hash in zip(rows.tolist(), first.tolist(), last.tolist(), hashes.tolist(), strict=True):
        yield row, a - int(part.first[row]), anchor_hash, symbols[a * SYMBOL_BYTES : b * SYMBOL_BYTES]


def _flagged_pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Pieces of a batch with columns text and at (the flagged anchor positions)."""
    positions = batch.column("at")
    for base, part in w.words_by_slice(batch.column("text"), w.NOT_SPACE):
        own = positions.slice(base, part.rows)
        counts = np.diff(own.offsets.to_numpy())
        flagged = own.flatten().to_numpy(zero_copy_only=False) + np.repeat(part.first[:-1], counts)
        for row, start, anchor, symbols in _pieces(part, np.unique(flagged), window):
            yield base + row, start, anchor, symbols


def piece_key(symbols: bytes) -> bytes:
    return hashlib.blake2b(symbols, digest_size=16).digest()


def _distinct_pieces(batches: Iterator[pa.RecordBatch], window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, symbols, least, most): pieces of a batch once each, with the smallest and largest id that has them."""
    for batch in batches:
        ids = batch.column("ident").to_pylist()
        found: dict[tuple[int, bytes], tuple[int, int]] = {}
        for row, _, anchor, symbols in _flagged_pieces(batch, window):
            key, ident = (anchor % shards, symbols), ids[row]
            least, most = found.get(key, (ident, ident))
            found[key] = min(least, ident), max(most, ident)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard for shard, _ in found], type=pa.int32()),
                pa.array([symbols for _, symbols in found], type=pa.binary()),
                pa.array([least for least, _ in found.values()], type=pa.int64()),
                pa.array([most for _, most in found.values()], type=pa.int64()),
            ],
            names=["shard", "symbols", "least", "most"],
        )


def _occurrences(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(piece, ident, row, start): where the pieces are."""
    for batch in batches:
        ids, row_keys = batch.column("ident").to_numpy(), batch.column("row").to_numpy()
        rows, starts, keys = [], [], []
        for row, start, _, symbols in _flagged_pieces(batch, window):
            rows.append(row)
            starts.append(start)
            keys.append(piece_key(symbols))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, type=pa.binary()), pa.array(ids[rows], type=pa.int64()),
                pa.array(row_keys[rows], type=pa.int64()), pa.array(starts, type=pa.int32()),
            ],
            names=["piece", "ident", "row", "start"],
        )


def first_ids(pieces: list[bytes], least: list[int], window: int) -> list[list[int]]:
    """For each window of each piece (all distinct), the smallest id of the pieces that hold it."""
    packed = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, SYMBOL_BYTES)
    padded = np.zeros((len(packed), 8), dtype=np.uint8)
    padded[:, :SYMBOL_BYTES] = packed
    joined = padded.view("<u8")[:, 0]
    sizes = np.array([len(p) // SYMBOL_BYTES for p in pieces])
    begin = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = np.zeros(len(owner), dtype=w.U64)
    for j in range(window):
        hashes = hashes * w.U64(0x9E3779B97F4A7C15) + w.mixed(joined[begin[owner] + offset + j])
    order = np.lexsort((owner, hashes))
    same = hashes[order][1:] == hashes[order][:-1]
    contested = np.zeros(len(owner), dtype=bool)  # windows that may be in more than one piece
    contested[order[1:][same]] = contested[order[:-1][same]] = True
    firsts = [[i] * int(c) for i, c in zip(least, counts, strict=True)]
    if not contested.any():
        return firsts
    # runs of contested windows; equal runs are one sequence
    at = np.flatnonzero(contested)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1]))))
    runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
        piece, start, end = int(owner[at[a]]), int(offset[at[a]]), int(offset[at[b - 1]]) + window
        run = joined[begin[piece] + start : begin[piece] + end]
        runs.setdefault(tuple(run.tolist()), []).append((piece, start))
    automaton = SuffixAutomaton()
    for run in runs:
        automaton.add(run)
    state_of = automaton.at_length(window)
    smallest: dict[int, int] = {}
    for run, places in runs.items():
        ident = min(least[piece] for piece, _ in places)
        for state, matched in automaton.stream(run):
            if matched >= window:
                key = state_of[state]
                smallest[key] = min(smallest.get(key, ident), ident)
    for run, places in runs.items():
        found = [smallest[state_of[s]] for s, matched in automaton.stream(run) if matched >= window]
        for piece, start in places:
            firsts[piece][start : start + len(found)] = found
    return firsts


def _match_shard(shard: pa.Table, window: int) -> pa.Table:
    """(piece, firsts) of the pieces that hold a window of an earlier document for some of their documents."""
    merged: dict[bytes, tuple[int, int]] = {}
    for symbols, a, b in zip(*(shard.column(c).to_pylist() for c in ("symbols", "least", "most")), strict=True):
        least, most = merged.get(symbols, (a, b))
        merged[symbols] = min(least, a), max(most, b)
    least = [a for a, _ in merged.values()]
    firsts = first_ids(list(merged), least, window)
    useful = [
        (piece_key(symbols), found)
        for (symbols, (_, most)), found in zip(merged.items(), firsts, strict=True)
        if min(found) < most
    ]
    return pa.table(
        [pa.array([k for k, _ in useful], type=pa.binary()), pa.array([f for _, f in useful], type=pa.list_(pa.int64()))],
        names=["piece", "firsts"],
    )


def _remains(batches: Iterator[pa.RecordBatch], window: int, keep: list[str], text: str, names: dict[str, str], digest: bool):
    """Words, removed words, and what is left of each row: its digest, or the text in place of the old one."""
    for batch in batches:
        copy = batch.column(names["copy"]).to_numpy(zero_copy_only=False)
        starts_of = batch.column(names["starts"])
        totals, gone, left = [], [], []
        for base, part in w.words_by_slice(batch.column(text), w.NOT_SPACE):
            counts = part.counts()
            own = starts_of.slice(base, part.rows)
            lengths = np.diff(own.offsets.to_numpy())
            marks = np.zeros(len(part) + 1, dtype=np.int32)
            first = own.flatten().to_numpy(zero_copy_only=False) + np.repeat(part.first[:-1], lengths)
            first = np.unique(first)
            marks[first] += 1
            np.subtract.at(marks, first + window, 1)
            removed = np.cumsum(marks[:-1]) > 0
            removed |= np.repeat(copy[base : base + part.rows] & (counts >= window), counts)
            kept = ~removed
            totals.append(counts)
            sums = np.concatenate(([0], np.cumsum(removed)))
            gone.append(sums[part.first[1:]] - sums[part.first[:-1]])
            # bytes of kept words, and one space after each but the last of a row
            edges = np.zeros(len(part.data) + 2, dtype=np.int8)
            edges[part.starts[kept]] += 1
            np.subtract.at(edges, part.ends[kept], 1)
            inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
            words_kept = np.flatnonzero(kept)
            rows = np.searchsorted(part.first, words_kept, side="right") - 1
            after = part.ends[words_kept[:-1][rows[:-1] == rows[1:]]]
            data = np.append(part.data, np.uint8(0))
            data[after] = 0x20
            inside[after] = True
            out = data[inside]
            sizes = np.concatenate(([0], np.cumsum(inside)))
            # a row's bytes: up to the start of the first word of the next row that has one
            bounds = np.append(part.starts, len(part.data))[part.first]
            ends = sizes[bounds]
            for row in range(part.rows):
                left.append(out[ends[row] : ends[row + 1]].tobytes())
        if digest:
            result = pa.array([hashlib.sha256(x).hexdigest() for x in left], type=pa.string())
        else:
            old = batch.column(text).to_pylist()
            removed_of = np.concatenate(gone) if gone else []
            result = pa.array([x.decode() if n else o for x, n, o in zip(left, removed_of, old, strict=True)], type=pa.string())
        columns = [result if c == text and not digest else batch.column(c) for c in keep]
        figures = [pa.array(np.concatenate(x) if x else [], type=pa.int64()) for x in (totals, gone)]
        columns += figures + ([result] if digest else [])
        labels = [*keep, names["n_words"], names["n_removed"]] + ([names["kept_sha256"]] if digest else [])
        yield pa.RecordBatch.from_arrays(columns, names=labels)


class Repeats:
    """Which texts are copies of earlier ones, and at which words of the others a repeated window starts."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW):
        self.doc_id, self.text, self.window = doc_id, text, window
        base = docs.select(identity(doc_id, text).alias("ident"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
        base = base.filter("text is not null")
        copies = base.groupBy(F.md5("text").alias("digest")).agg(F.min("ident").alias("first"), F.max("ident").alias("last"))
        self.copies = written(copies.filter("first < last").select("digest", "first"), "copies")
        self.n_copies = self.copies.count()
        own = base.withColumn("digest", F.md5("text")).join(small_side(self.copies, self.n_copies), "digest", "left")
        self.own = own.filter("first is null or first = ident").select("ident", "row", "text")
        self.flags = self._flags()
        self.n_flags = self.flags.agg(F.sum(F.size("at"))).first()[0] or 0
        self.starts = self._starts()

    def _flags(self) -> DataFrame:
        """(row, at): positions of anchors that other documents have too."""
        anchors = self.own.mapInArrow(partial(_anchors, window=self.window), "anchor bigint, ident bigint, row bigint, at int")
        shared = anchors.groupBy("anchor").agg(F.min("ident").alias("a"), F.max("ident").alias("b")).filter("a < b")
        flags = anchors.join(shared.select("anchor"), "anchor", "left_semi")
        return written(flags.groupBy("row").agg(F.collect_set("at").alias("at")), "flags")

    def _starts(self) -> DataFrame:
        """(row, starts): starts of the windows that a document with a smaller id has too."""
        candidates = self.own.join(self.flags, "row")
        shards = max(1, self.n_flags // SHARD_PIECES)
        pieces = candidates.mapInArrow(
            partial(_distinct_pieces, window=self.window, shards=shards), "shard int, symbols binary, least bigint, most bigint"
        )
        window = self.window
        matched = pieces.groupBy("shard").applyInArrow(
            lambda shard: _match_shard(shard, window), "piece binary, firsts array<bigint>"
        )
        places = candidates.mapInArrow(partial(_occurrences, window=self.window), "piece binary, ident bigint, row bigint, start int")
        found = places.join(written(matched, "matched"), "piece")
        at = F.transform("firsts", lambda first, j: F.when(first < F.col("ident"), F.col("start") + j))
        found = found.select("row", F.filter(at, lambda x: x.isNotNull()).alias("starts")).filter(F.size("starts") > 0)
        return written(found.groupBy("row").agg(F.flatten(F.collect_list("starts")).alias("starts")), "starts")

    def marked(self, docs: DataFrame, names: dict[str, str]) -> DataFrame:
        """The rows with `copy` and `starts`, under these names."""
        digest, ident, first, owner, row = (names[c] for c in ("digest", "ident", "first", "owner", "row"))
        added = {digest: F.md5(F.col(self.text)), ident: identity(self.doc_id, self.text), row: row_key(self.doc_id, self.text)}
        rows = docs.withColumns(added)
        copies = small_side(self.copies.select(F.col("digest").alias(owner), F.col("first").alias(first)), self.n_copies)
        rows = rows.join(copies, F.col(digest) == F.col(owner), "left").drop(digest, owner)
        rows = rows.withColumn(names["copy"], F.coalesce(F.col(first) < F.col(ident), F.lit(False)))
        starts = self.starts.select(F.col("row").alias(owner), F.col("starts").alias(names["starts"]))
        rows = rows.join(starts, F.col(row) == F.col(owner), "left")
        known = F.coalesce(F.col(names["starts"]), F.array().cast("array<int>"))
        return rows.withColumn(names["starts"], known).drop(ident, first, owner, row)


_ADDED = ("digest", "ident", "first", "owner", "row", "copy", "starts", "n_words", "n_removed", "kept_sha256")


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = {c: c for c in _ADDED}
    rows = Repeats(narrow, window=window).marked(narrow, names)
    remains = partial(_remains, window=window, keep=["doc_id"], text="text", names=names, digest=True)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(remains, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without the repeated words; a text that loses words keeps the others, one space apart."""
    names = {c: fresh_name(docs.columns, c) for c in _ADDED}
    rows = Repeats(docs, doc_id, text, window).marked(docs, names)
    remains = partial(_remains, window=window, keep=docs.columns, text=text, names=names, digest=False)
    figures = [T.StructField(names[c], T.LongType()) for c in ("n_words", "n_removed")]
    schema = T.StructType(docs.schema.fields + figures)
    return rows.mapInArrow(remains, schema).select(docs.columns)
