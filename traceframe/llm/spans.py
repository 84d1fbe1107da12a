"""Words, lines and n-grams of many texts at once, as numpy arrays over their joined UTF-8 bytes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
All of these are ASCII, so words never cut a character. Hashes are 64-bit polynomials over the bytes, mixed at the
end; equal strings have equal hashes, and different ones meet with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one numpy pass holds; a longer text is a pass of its own.
PASS_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 (public domain): every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, PASS_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[k:] = [table]
    return _powers[0], _powers[1]


class Texts:
    """Some texts side by side: ``data`` are their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``; null counts as empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds.astype(np.int64)
        self.n = len(bounds) - 1
        self._total: np.ndarray | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each word, and the number of its text."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[self.data]
        return self.runs(inside)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of equal non-zero class; ``inside`` has a zero before and after the bytes. Runs end with their text."""
        edge = inside[1:] != inside[:-1]
        edge[self.bounds] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        full = inside[starts + 1] != 0
        starts, ends = starts[full], ends[full]
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = _power_tables(len(self.data))
        if self._total is None:
            self._total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + _U(1)) * power[: len(self.data)], out=self._total[1:])
        total = self._total
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def passes(column: pa.Array, lower: bool = False, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of a string column, cut into passes of about ``limit`` bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, Texts(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row], lower)
        row = end


def windows(hashes: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one text, and the index of each window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _U(0xD1342543DE82EF95) + hashes[k : k + n]
    first = np.flatnonzero(of[:n] == of[width - 1 :])
    return mix(total[first] + _U(width)), first


def starts_of(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of n texts begins in a sorted array of text numbers; n + 1 values."""
    return np.searchsorted(of, np.arange(n + 1))
