"""Words and word shingles of many texts at once, in numpy.

A word is a run of bytes other than space and tab to carriage return; A-Z are lower-cased. Words and
shingles are 64-bit hashes that depend on content alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled at once; one longer text is handled alone.
CHUNK = 2_000_000
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWERED_VALUES = BYTE_VALUES[LOWER]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Hasher:
    """Hashes of byte ranges of one chunk after another; keeps the powers it needs."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of the row it is in), in order."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.up) < n + 1:
            self.up, self.down = powers(n + 1, BASE), powers(n + 1, BASE_INVERSE)
        solid = ~BLANK[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        row_starts = offsets[:-1][np.diff(offsets) > 0]
        before[row_starts] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = solid[1:]
        after[row_starts[1:] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LOWERED_VALUES[data] * self.up[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(BASE))
        return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mixed(total) + words[i : i + n] if i else total + words[:n]
    return mixed(total)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingles; of fewer words the whole sequence as one, of none nothing."""
    hasher = Hasher()
    for _, data, offsets in chunks(texts):
        hashes, rows = hasher.words(data, offsets)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        every = shingles(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                found = np.sort(every[a : b - width + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield shingles(hashes[a:b], b - a) if b > a else hashes[:0]
