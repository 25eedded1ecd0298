"""Words of Arrow string batches as numpy arrays, without a Python object per word.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; those
bytes never occur inside a longer UTF-8 sequence, so byte positions are safe.
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# texts handled at once; temporary arrays take some 60 times as many bytes
SLICE_BYTES = 1 << 19

_random = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        known = _powers[base] = (both[0], both[1])
    return known[0][:n], known[1][:n]


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of document d."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        rolling = Rolling(BYTE_VALUE[self.data], BASES[0])
        return mix(rolling.of(self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    return words_of(LOWER[data] if lower else data, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), empty, empty, data)
    inside = ~SEPARATOR[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= cut[1:n] | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= cut[1:n] | ~inside[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(np.searchsorted(start, offsets), start, end, data)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text
    is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
