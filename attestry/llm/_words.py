"""Vectorised word splitting and hashing of Arrow string columns (numpy, no per-word Python).

A batch's UTF-8 bytes are scanned once. Word hashes are 64-bit polynomial hashes finished with a bit mixer; hashes of word
runs combine word hashes the same way. All hashes depend on content only, so they agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = U64(0xD6E8FEB86659FD93)

#: 0x20 and 0x09-0x0D separate words
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: everything in ASCII but digits and letters separates words
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _P) | U64(1)
_pow = np.ones(1, U64), np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) <= n:
        size = max(n + 1, 1 << 16)
        a = np.full(size, _P, U64)
        b = np.full(size, _PINV, U64)
        a[0] = b[0] = 1
        _pow = np.cumprod(a), np.cumprod(b)
    return _pow


class Words:
    """The words of several texts: ``starts``/``ends`` byte places, ``doc`` first word of each text (one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        base = int(offsets[0])
        self.bytes = data[base : int(offsets[-1])]
        self.offsets = offsets.astype(np.int64) - base
        if lower:
            self.bytes = _LOWER[self.bytes]
        n = len(self.bytes)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[self.bytes]
        begin = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        if len(cut):
            begin[cut] |= inside[cut + 1]
            end[cut - 1] |= inside[cut]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        power, inverse = _powers(n)
        run = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.bytes] * power[:n], out=run[1:])
        return mix((run[self.ends] - run[self.starts]) * inverse[self.starts])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (len(words) - k + 1 values; runs across texts are the caller's to drop)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _Q
        h += words[j : j + n]
    return mix(h)


def window_min_places(h: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: the distinct places of the leftmost minimum of every ``w`` consecutive values (one place if there are fewer)."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= w:
        return np.array([int(np.argmin(h))])
    best = h[: n - w + 1].copy()
    place = np.arange(n - w + 1)
    for j in range(1, w):
        other = h[j : j + n - w + 1]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + j
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    return place[keep]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(buffers[2], np.uint8), offsets.astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about ``limit`` bytes of text each, so that numpy's temporaries stay small."""
    data, offsets = text_arrays(batch.column(batch.schema.get_field_index(column)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(rows, max(to, at + 1))
        yield at, to, data, offsets[at : to + 1]
        at = to
