"""Words and their 64-bit hashes for whole Arrow batches of texts, without a Python loop over words.

A word is a run of bytes other than space and tab to carriage return. Hashes are polynomials over the
bytes modulo 2**64, taken from running sums, so that a batch costs a few numpy passes whatever its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_ROLL = 0xD6E8FEB86659FD93 | 1
_WORD = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, kept up to a bounded length."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        up, down = self._series(self.base, n), self._series(self.inverse, n)
        if n <= 2 * _SEGMENT:
            self.up, self.down = up, down
        return up, down

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out, have, step = np.ones(n, np.uint64), 1, base
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(step)
            have, step = have + more, step * step & _WORD
        return out


_bytes, _rolls = _Powers(_BASE), _Powers(_ROLL)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    bounds: np.ndarray  # first word of each text, and the number of words


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each starts; a null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `size` bytes of text, or one row.

    Arrow's pool keeps what batches took; it is given back after each, else every idle worker holds it beside the others' tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
        del batch
        pa.default_memory_pool().release_unused()


def split(data: np.ndarray, at: np.ndarray) -> Words:
    """Words of each text; none spans two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def hashes(words: Words, lower: bool) -> np.ndarray:
    """A hash of each word's bytes, with A-Z lower-cased if `lower`."""
    codes = _CODES[LOWER] if lower else _CODES
    out = np.empty(len(words.starts), np.uint64)
    i = 0
    while i < len(out):
        begin = int(words.starts[i])
        j = max(i + 1, int(np.searchsorted(words.ends, begin + _SEGMENT, "right")))
        up, down = _bytes.get(int(words.ends[j - 1]) - begin)
        total = np.zeros(len(up) + 1, np.uint64)
        np.cumsum(codes[words.data[begin : begin + len(up)]] * up, out=total[1:])
        start, end = words.starts[i:j] - begin, words.ends[i:j] - begin
        out[i:j] = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        i = j
    return mix(out)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of `width` values, by its first value."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), _SEGMENT
    for i in range(0, n, step):
        part = values[i : min(i + step, n) + width - 1]
        up, down = _rolls.get(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=total[1:])
        out[i : i + step] = (total[width:] - total[:-width]) * down[: len(part) - width + 1]
    return mix(out)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word, the text that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def whole(bounds: np.ndarray, width: int) -> np.ndarray:
    """Starts of the runs of `width` words that stay in one text."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    skip = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(skip - bounds[:-1], counts)
