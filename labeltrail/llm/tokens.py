"""Vectorised words and shingles of many texts at once, on the bytes of an Arrow string column.

All hashes are 64-bit.  A word's hash is a polynomial in its bytes, taken from prefix sums, so the cost per byte is a
few array passes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
CHUNK_BYTES = 2_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the word definition `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators when words are runs of letters and digits; bytes of longer characters belong to words.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i below n, kept by the worker at the size of its largest chunk."""
    if "p" not in _powers or len(_powers["p"]) < n:
        for key, base in (("p", BASE), ("q", BASE_INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[:1] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about CHUNK_BYTES of text; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(row of the chunk, hash) of each word in order; A-Z count as a-z, words never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~separators[data]
    cuts = np.zeros(n + 1, dtype=bool)
    cuts[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | cuts))
    ends = np.flatnonzero(before & (~inside | cuts))
    p, q = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, hashes


def shingles(rows: np.ndarray, hashes: np.ndarray, size: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `size` words; a row with fewer words gives its whole sequence as one shingle."""
    n = len(hashes)
    if not n:
        return rows, hashes
    turn = [np.uint64(pow(int(BASE), i, 2**64)) for i in range(size)]
    m = max(n - size + 1, 0)
    value = np.zeros(m, dtype=np.uint64)
    for i in range(size):
        value += hashes[i:m + i] * turn[i]
    whole = rows[:m] == rows[size - 1:size - 1 + m]
    out_rows, out = rows[:m][whole], mix(value[whole])
    if whole_if_short:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        length = np.diff(np.r_[first, n])
        extra_rows, extra = [], []
        for at, k in zip(first[length < size].tolist(), length[length < size].tolist()):
            v = np.uint64(k)
            with np.errstate(over="ignore"):
                for i in range(k):
                    v = v + hashes[at + i] * turn[i]
            extra_rows.append(rows[at])
            extra.append(v)
        if extra:
            out_rows = np.r_[out_rows, np.array(extra_rows, dtype=rows.dtype)]
            out = np.r_[out, mix(np.array(extra, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
    return out_rows, out


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), ordered by row and hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])]
        rows, hashes = rows[new], hashes[new]
    return rows, hashes
