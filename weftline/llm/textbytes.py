"""Texts of an Arrow column as one byte array, cut into words with numpy.

Words are found and hashed without a Python object for each. A batch is worked
through in pieces of whole texts of about ``PIECE`` bytes, and within a long text
in steps of ``STEP`` bytes, so temporary memory is a small multiple of the longest text
at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 512 << 10
STEP = 1 << 20

# Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

WORD = np.ones(256, bool)
WORD[list(SPACES)] = False

# Letters of any case, digits and all bytes of other scripts.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

BASE = np.uint64(0x9E3779B97F4A7C13)  # odd, and 3 modulo 8
LETTERS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8) if ends else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first and last row, bytes and offsets of each run."""
    data, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = WORD) -> tuple[np.ndarray, ...]:
    """Start and end of every word, and the number of the text that it is in."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = letters[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2] | edge[1:]
    start = np.flatnonzero(begins)
    ends = inside[:-1].copy()
    ends[:-1] &= ~inside[1:-1] | edge[1:]
    end = np.flatnonzero(ends) + 1
    counts = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    return start, end, np.repeat(np.arange(len(offsets) - 1), counts)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans are in order and do not overlap."""
    out = np.empty(len(start), np.uint64)
    table = LETTERS[LOWER] if lower else LETTERS
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + STEP, side="right")))
        first = start[at]
        lengths = end[at:to] - start[at:to]
        begin = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        within = np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)
        letters = data[np.repeat(start[at:to], lengths) + within]
        powers = np.cumprod(np.full(int(lengths.max()) + 1, BASE, np.uint64))
        out[at:to] = np.add.reduceat(table[letters] * powers[within], begin)
        at = to
    return mix(out)


def windows(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` neighbouring values of one owner, and where each begins."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    factors = np.cumprod(np.full(width, BASE, np.uint64))
    for k in range(width):
        total += values[k : k + n] * factors[k]
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(total[first]), first
