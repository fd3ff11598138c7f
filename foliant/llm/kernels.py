"""Byte-level text kernels in numpy: whole Arrow batches at once, no loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the hashes (from the golden ratio and well-known mixers).
BASE, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Text bytes that a kernel works on at once; a longer text is a piece of its own.
PIECE = 1 << 19
#: Spans of more bytes are hashed by a digest each.
SHORT = 32
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE^0 .. BASE^(n-1) modulo 2^64, or of its inverse."""
    key = "inverse" if inverse else "plain"
    if (had := _powers.get(key)) is None or len(had) < n:
        base = int(BASE)
        out = np.full(max(n, PIECE + 1), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        out[0] = 1
        had = _powers[key] = np.multiply.accumulate(out)
    return had[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes, and where each row starts (one more entry for the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: first row, last row + 1, bytes, offsets."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't ``apart``), and where each row's words begin among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the data."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: 8 bytes at a time, each followed by a bijection of all that was read; a digest for long spans."""
    sizes, view = ends - starts, eights(data)
    h = mixed(sizes.astype(np.uint64) * M2 + BASE)
    for k in range(0, SHORT, 8):
        some = np.flatnonzero(sizes > k) if k else slice(None)
        left = np.minimum(sizes[some] - k, 8)
        h[some] = mixed(h[some] ^ (view[starts[some] + k] & LOW_BYTES[left])) + M1
        if k and not len(some):
            break
    for i in np.flatnonzero(sizes > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and where each row's begin."""
    low = LOWER[data]
    starts, ends, rows = spans(low, offsets, apart)
    return span_hashes(low, starts, ends), rows


def shingles(words: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in each row, with repeats, and where each row's begin.

    A row with fewer words has one shingle, of all its words; a row without words has none.
    """
    n = len(words)
    counts = np.diff(rows)
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(many)])
    if not n:
        return np.zeros(0, np.uint64), out_rows
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        part = np.zeros(n, dtype=np.uint64)
        part[: max(n - k, 0)] = words[k:]
        h = h * BASE + part
    h = mixed(h)
    first = np.repeat(rows[:-1] - out_rows[:-1], many) + np.arange(out_rows[-1])
    out = h[first]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        x = int(counts[i])
        for w in words[rows[i] : rows[i + 1]].tolist():
            x = (x * int(M1) + w) % (1 << 64)
        out[out_rows[i]] = mixed(np.array([x ^ int(M2)], dtype=np.uint64))[0]
    return out, out_rows


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each run, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
