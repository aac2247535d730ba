"""Words of many texts at once, as 64-bit hashes over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

# A word byte maps to its lower-case form, any other byte to 0: digits, letters and all of non-ASCII are word bytes.
ALPHANUMERIC = np.zeros(256, dtype=np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    ALPHANUMERIC[_b] = _b
for _b in range(0x41, 0x5B):
    ALPHANUMERIC[_b] = _b + 32


@dataclass
class Words:
    """Words of consecutive texts: byte range, hash, and for each text its first word (with one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of a single longer row, and of at most ``rows`` rows."""
    row, n = 0, len(at) - 1
    while row < n:
        stop = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), n, row + rows if rows else n)
        yield row, stop
        row = stop


def words_of(data: np.ndarray, at: np.ndarray, table: np.ndarray = ALPHANUMERIC) -> Words:
    """All words of the texts ``data[at[i]:at[i + 1]]``; byte positions count from ``at[0]``."""
    base, n = at[0], int(at[-1] - at[0])
    low = np.zeros(n + 8, dtype=np.uint8)
    low[:n] = table[data[base : base + n]]
    inside = low[:n] != 0
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = ~inside[:-1]
    edge[(at - base)[:-1]] = True
    start = np.flatnonzero(inside & edge[:n])
    stop = np.ones(n, dtype=bool)
    stop[: n - 1] = ~inside[1:]
    cuts = (at - base)[1:-1] - 1
    stop[cuts[cuts >= 0]] = True
    end = np.flatnonzero(inside & stop) + 1
    size = end - start
    view = np.ndarray((n + 1,), dtype="<u8", buffer=low, strides=(1,))
    h = size.astype(np.uint64) * MULTIPLIER
    left = np.arange(len(start))
    k = 0
    while len(left):
        rest = size[left] - k
        part = view[start[left] + k] & _MASKS[np.minimum(rest, 8)]
        mixed = (h[left] ^ part) * MULTIPLIER
        h[left] = mixed ^ (mixed >> np.uint64(29))
        k += 8
        left = left[rest > 8]
    first = np.searchsorted(start, at - base)
    return Words(start, end, h, first)
