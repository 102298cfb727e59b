"""Vectorised words, lines and hashes over the UTF-8 bytes of a batch of texts.

A word is a run of bytes outside 0x20 and 0x09-0x0D. All six separators are
ASCII, so byte runs and code point runs agree. Hashes are 64-bit: a polynomial
over a fixed random byte table, then a finaliser. They do not depend on the
process, the batch or the position in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240917)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes, one row at least: first row, end row, bytes, bounds from 0."""
    data, bounds = raw(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in order."""
    inside = ~SPACE[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cut = bounds[1:-1]
    first, last = cut[cut < len(buf)], cut[cut > 0] - 1
    begin[first], stop[last] = inside[first], inside[last]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(bounds, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the given spans; spans are in order and do not overlap, empty ones hash alike."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return mix(out)
    size, start = size[full], start[full]
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
    text = buf[place + np.repeat(start, size)]
    out[full] = np.add.reduceat(BYTE[text] * powers(int(size.max()))[place], at)
    return mix(out)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of every n words of one document."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * BASE + hashes[at + k]
    return mix(total), at
