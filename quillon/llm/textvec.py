"""Vectorised text work on Arrow batches.

Words are found and hashed with NumPy over the raw UTF-8 bytes of many texts at once, so
that no Python statement runs per word. Work is cut into pieces of about ``CHUNK`` bytes
(a single longer text is one piece), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))

#: Byte tables: True for a byte that separates words.
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_b = np.arange(256)
NOT_WORD = ~(((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | ((_b >= 65) & (_b <= 90)) | (_b >= 128))
NOT_LETTER = NOT_WORD | ((_b >= 48) & (_b <= 57))
_LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


@cache
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """The words of one piece: starts, ends, row of each, and (lazily) hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~separators[data]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | border[:n]))
        self.ends = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self._sums: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        n = len(self.data)
        up, down = _powers(max(1, n).bit_length())
        with np.errstate(over="ignore"):
            if self._sums is None:
                self._sums = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[self.data] * up[:n], out=self._sums[1:])
            return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def windows(row: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of, hash of) each k-word window; a text with fewer words is one window."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        if n >= k:
            total = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                total = total * _A + mix(hashes[i : n - k + 1 + i], i + 1)
            whole = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
            out = mix(total[whole], k)
        else:
            out = np.zeros(0, np.uint64)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, n])
        short = first[size < k]
        if len(short):
            total = np.full(len(short), _B)
            for i in range(k - 1):
                at = short + i
                live = i < size[size < k]
                total[live] = total[live] * _C + mix(hashes[np.minimum(at, n - 1)][live], i + 1)
            whole, out = np.r_[whole, short], np.r_[out, mix(total, 99)]
            order = np.argsort(whole, kind="stable")
            whole, out = whole[order], out[order]
    return whole, out


def distinct_by_row(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values without repeats, sorted by both."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[keep], values[keep]
