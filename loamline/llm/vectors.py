"""Words, shingles and n-grams of Arrow string columns as 64-bit hashes, computed with numpy on whole batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed random numbers: multipliers for the places of an n-gram, and a start for words.
_RNG = np.random.Generator(np.random.PCG64(20240229))
_START = np.uint64(int(_RNG.integers(1, 2**63)) * 2 + 1)
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]  # A-Z hash as a-z
#: Masks of the first 0 to 8 bytes of a block, and the bytes from which a word is hashed by hashlib.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 64
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE_BYTES, one row at least."""
    _, offsets = string_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to
        at = to


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the end); A-Z count as a-z.

    A word is a run of bytes other than space and tab to carriage return, which
    in UTF-8 is a run of such characters. Its hash goes through it in blocks of
    eight bytes, each mixed with what went before; that of a long word is
    cryptographic.
    """
    raw, offsets = string_bytes(column)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.empty(n, dtype=bool)  # a word may not run on from one row into the next
    edge[0], edge[1:] = True, ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    edge[begins] = True
    starts = np.flatnonzero(inside & edge)
    stop = np.empty(n, dtype=bool)
    stop[-1], stop[:-1] = True, ~inside[1:]
    stop[begins[begins > 0] - 1] = True
    length = np.flatnonzero(inside & stop) + 1 - starts
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    blocks = np.lib.stride_tricks.sliding_window_view(low, 8)
    hashed = mix(length.astype(np.uint64) + _START)
    short = np.flatnonzero(length <= LONG)
    for k in range(0, LONG, 8):
        short = short[length[short] > k]
        if not len(short):
            break
        block = blocks[starts[short] + k].view(np.uint64).ravel() & _MASK[np.minimum(length[short] - k, 8)]
        hashed[short] = mix((hashed[short] ^ block) + _START)
    for i in np.flatnonzero(length > LONG):
        word = low[starts[i] : starts[i] + length[i]].tobytes()
        hashed[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashed, np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within each row, first of every row and the end).

    A row with fewer words than ``size`` has its whole sequence as one shingle, a row without words none.
    """
    n = np.diff(firsts)
    per_row = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), per_row)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + firsts[:-1][row]
    total, long_enough = np.zeros(len(row), np.uint64), n[row] >= size
    for k in range(size):
        has = long_enough | (k < n[row])
        total[has] += hashed[at[has] + k] * _PLACE[k]
    total = mix(total + np.minimum(n[row], size).astype(np.uint64))
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    row, total = row[new], total[new]
    return total, np.searchsorted(row, np.arange(len(n) + 1))


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum (wrapping) of the values of every row."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[firsts[1:]] - sums[firsts[:-1]]
