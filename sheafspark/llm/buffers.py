"""Words of whole Arrow columns at once: boundaries, hashes and windows as numpy arrays.

A text column arrives as one UTF-8 buffer with row offsets. All separators
used here are ASCII, so words are found on the bytes without decoding, and
every step is a handful of vector operations instead of a loop over words.
Memory is a small multiple of ``SLICE_BYTES`` or of the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 * 1024 * 1024
_BLOCK = 1 << 20

# An odd multiplier, and the constants of a 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def _byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACES = (0x20, *range(0x09, 0x0E))
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = ~_byte_class(SPACES)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z.
ALNUM = _byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of runs of a-z and of anything that is not ASCII.
LETTERS = _byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])


def lowered(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 0x41) & (data <= 0x5A)).view(np.uint8) << np.uint8(5))


@dataclass
class Text:
    """Rows of a column: all bytes, and the offset of each row (and the end)."""

    data: np.ndarray
    offsets: np.ndarray

    def lowered(self) -> Text:
        """A-Z become a-z; no other byte changes."""
        return Text(lowered(self.data), self.offsets)


@dataclass
class Words:
    """Words of some rows: byte ranges, and the first word of each row (and the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def text_of(column: pa.Array) -> Text:
    """The bytes of a string column; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    spans = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(spans):
        spans = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Text(raw[spans[0] : spans[-1]], spans - spans[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts take about ``limit`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def find_words(text: Text, member: np.ndarray) -> Words:
    """Maximal runs of member bytes inside each row."""
    inside = member[text.data]
    left, right = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        left[0], left[1:] = False, inside[:-1]
        right[-1], right[:-1] = False, inside[1:]
        borders = text.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(inside))]
        left[borders] = False
        right[borders - 1] = False
    start = np.flatnonzero(inside & ~left)
    end = np.flatnonzero(inside & ~right) + 1
    return Words(start, end, np.searchsorted(start, text.offsets))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX1
    h = (h ^ (h >> _SHIFT)) * _MIX2
    return h ^ (h >> _SHIFT)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            ones = np.full(n, _BASE, np.uint64)
            inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(ones)])
            cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(inverse)])
        return cls.up, cls.down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; ``span_hash`` turns two of them into the hash of a span."""
    up, _ = _Powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes, wherever they are."""
    _, down = _Powers.upto(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def hash_words(text: Text, words: Words) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(words.start), np.uint64)
    begin = 0
    while begin < len(out):
        base = words.start[begin]
        stop = max(begin + 1, int(np.searchsorted(words.end, base + _BLOCK, side="right")))
        sums = prefix_sums(text.data[base : words.end[stop - 1]])
        out[begin:stop] = span_hash(sums, words.start[begin:stop] - base, words.end[begin:stop] - base)
        begin = stop
    return out


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` neighbouring hashes (row borders are the caller's)."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : k + n]
    return mix(out)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, rows given by their first value (and the end)."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
