"""Words of Arrow text columns, found and hashed with numpy, a slice of the batch at a time.

A word is a maximal run of bytes of one class. All classes used here hold either every byte of a
non-ASCII character or none, so runs of UTF-8 bytes are runs of characters. Texts are always read to their
end; a null text has no words. Memory is a fixed multiple of a slice, or of the longest text if that is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

# Character classes (fixed values): what is not ASCII white space; digits, letters and non-ASCII characters
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

AS_IS = np.arange(256, dtype=np.uint8)
ASCII_LOWER = AS_IS.copy()
ASCII_LOWER[0x41:0x5B] += 32

_FACTOR = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    values = values ^ (values >> U64(30))
    values = values * U64(0xBF58476D1CE4E5B9)
    values ^= values >> U64(27)
    values *= U64(0x94D049BB133111EB)
    values ^= values >> U64(31)
    return values


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(length: int) -> list[np.ndarray]:
    if len(_powers[0]) < length:
        if length > 2 * SLICE_BYTES:  # for one very long text: not kept
            return [_power_table(factor, length) for factor in (_FACTOR, _INVERSE)]
        _powers[:] = [_power_table(factor, 2 * SLICE_BYTES) for factor in (_FACTOR, _INVERSE)]
    return _powers


def _power_table(factor: np.uint64, length: int) -> np.ndarray:
    table = np.full(length, factor, dtype=U64)
    table[0] = 1
    return np.multiply.accumulate(table)


@dataclass
class Words:
    """Words of some consecutive rows. `first[r]:first[r + 1]` are those of row r; starts and ends index `data`."""

    data: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def text(self, word: int) -> str:
        return self.data[self.starts[word] : self.ends[word]].tobytes().decode()

    def windows(self, length: int) -> np.ndarray:
        """Positions at which `length` consecutive words of one row start."""
        if len(self) < length:
            return np.empty(0, dtype=np.int64)
        last = np.repeat(self.first[1:], self.counts()) - length
        at = np.arange(len(self))
        return at[at <= last]

    def window_hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of `length` consecutive words from each position."""
        total = np.zeros(len(at), dtype=U64)
        for j in range(length):
            total = (total + self.hashes[at + j]) * _FACTOR
        return mixed(total)


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about SLICE_BYTES together; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray = AS_IS) -> Words:
    """Words of one slice, hashed after folding each byte."""
    size = len(data)
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    cut = np.zeros(size + 1, dtype=bool)  # rows meet here
    cut[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~here))
    powers, inverses = _power_tables(size + 1)
    sums = np.zeros(size + 1, dtype=U64)
    np.cumsum(_BYTE_VALUES[fold][data] * powers[:size], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverses[starts])
    return Words(data, np.searchsorted(starts, offsets), starts, ends, hashes)


def words_by_slice(
    column: pa.Array | pa.ChunkedArray, word_bytes: np.ndarray, fold: np.ndarray = AS_IS
) -> Iterator[tuple[int, Words]]:
    """(first row, words) for every slice of the column."""
    for row, data, offsets in text_slices(column):
        yield row, find_words(data, offsets, word_bytes, fold)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns what this worker has freed to the system; allocators keep it otherwise for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc only
        _LIBC.malloc_trim(0)


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task over batches that gives its memory back at its end: Spark keeps workers for later stages."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches, **options)
        finally:
            give_back()

    return run


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is in the sorted table, its index there)."""
    if not len(table):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values, at


def binary_column(rows: list[bytes] | list[bytes | None]) -> pa.Array:
    return pa.array(rows, type=pa.binary())
