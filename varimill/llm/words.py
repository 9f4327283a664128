"""Words and shingles of many texts at once, as numpy arrays over Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. All of these are ASCII,
so words can be cut in UTF-8 without decoding it. Hashes have 64 bits; equality
of words and shingles is taken as equality of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # of text worked on at once; a longer text is one chunk

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything that is no letter or digit; bytes of other scripts count as letters.
PUNCTUATION = ~np.isin(np.arange(256), [*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as longer chunks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(n, np.uint64)
            ones[1:] = _BASE
            self.up = np.cumprod(ones, dtype=np.uint64)
            ones[1:] = _INVERSE
            self.down = np.cumprod(ones, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(offsets) else data
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a column of about ``size`` bytes."""
    if not len(column):
        return
    data, offsets = texts(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """The words of the texts of one chunk.

    ``start``/``end``: byte places; ``row``: which text; ``first``: index of each
    text's first word, with the number of all words at the end.
    """

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE
    ) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~between[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        up, down = _POWERS.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:], dtype=np.uint64)
        plain = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(plain + (self.end - self.start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``width`` words within one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        total = hashes[:n].copy()
        for i in range(1, width):
            total *= _STEP
            total += hashes[i : i + n]
        return at, mix(total[at] + np.uint64(width))

    def shingles(self, hashes: np.ndarray, width: int) -> list[np.ndarray]:
        """For each text its distinct runs of ``width`` words, sorted.

        A text with fewer words has its whole sequence as its only one; without
        words it has none.
        """
        at, hashed = self.windows(hashes, width)
        bounds = np.searchsorted(at, self.first)
        found = []
        for i, n in enumerate(self.counts()):
            if n >= width:
                found.append(np.unique(hashed[bounds[i] : bounds[i + 1]]))
            elif n:
                whole = np.uint64(0)
                with np.errstate(over="ignore"):
                    for h in hashes[self.first[i] : self.first[i + 1]]:
                        whole = whole * _STEP + h
                found.append(mix(np.array([whole + np.uint64(n)])))
            else:
                found.append(np.zeros(0, np.uint64))
        return found
