"""Words of whole texts as flat numpy arrays: boundaries, hashes, shingle hashes.

All work is on the UTF-8 bytes of an Arrow column, many texts at once. A word's hash is
a polynomial over its bytes modulo 2**64, made by prefix sums, then mixed with its length;
it does not depend on where the word stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: has an inverse and a long period modulo 2**64
SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)

_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
#: Which bytes belong to words, by kind of word.
KINDS = {"space": ~_space, "alnum": np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept for the next call."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of n texts: text i has the words [at[i], at[i+1])."""

    data: np.ndarray  # bytes of all texts, lower-cased if asked for
    raw: np.ndarray  # bytes as they were
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mixed(h ^ ((self.ends - self.starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))

    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(array: pa.Array, kind: str = "space", lower: bool = False) -> Words:
    raw, offsets = buffers(array)
    data = LOWER[raw] if lower else raw
    inside = KINDS[kind][data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Words(data, raw, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def window_starts(at: np.ndarray, width: int) -> np.ndarray:
    """The first word's index of every width consecutive words of one text."""
    n = int(at[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    steps = np.zeros(n + 1, np.int64)
    size = np.diff(at)
    use = size >= width
    np.add.at(steps, at[:-1][use], 1)
    np.add.at(steps, at[:-1][use] + size[use] - width + 1, -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def windows(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling polynomial hashes of width consecutive words of one text: the first word's index, and the hash."""
    first = window_starts(at, width)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    w = hashes[:n].copy()
    for j in range(1, width):
        w *= SHINGLE_BASE
        w += hashes[j : j + n]
    return first, mixed(w[first])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive numbers."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def covered(n: int, first: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n words some window covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + width, -1)
    return np.cumsum(steps[:-1]) > 0
