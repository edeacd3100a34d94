"""Vectorised text kernels over Arrow string columns (numpy, no per-word Python).

A block is the raw UTF-8 bytes of several texts laid end to end plus their offsets. Words,
lines and hashes of all texts of a block are found together; blocks are cut by bytes, so memory
is bounded by BLOCK_BYTES or by the longest single text.

A hash of a range of bytes chains a 64-bit mixer over its words of eight bytes, beginning with its
length and a seed: no sum or power of a base is involved, so ranges that differ in any regular way
have unrelated hashes, and hashes of different seeds have nothing in common. Ranges of more than
LONG_BYTES go through BLAKE2 one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer text makes a block of its own), and bytes
#: of a range from which on it is hashed on its own.
BLOCK_BYTES, LONG_BYTES = 500_000, 2048

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: Masks of the first 0 to 8 bytes of a word of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = np.asarray(x, _U) + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte ranges. `data` has eight more bytes at its end than any range."""
    size = ends - starts
    out = mix(size.astype(_U) + mix(np.array([seed], _U))[0])
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))  # the eight bytes from each place on
    left, at, place = size, starts, None
    short = size <= LONG_BYTES
    if not short.all():
        for i in np.flatnonzero(~short):
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        place = np.flatnonzero(short)
        left, at = left[place], at[place]
    some = left > 0
    place = np.flatnonzero(some) if place is None else place[some]
    left, at = left[some], at[some]
    while len(place):
        out[place] = mix(out[place] ^ (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        place, left, at = place[more], left[more] - 8, at[more] + 8
    return out


def hash_runs(items: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of runs of hashes, chained alike."""
    out = mix((end - begin).astype(_U) + mix(np.array([seed], _U))[0])
    place = np.flatnonzero(end > begin)
    at, till = begin[place], end[place]
    while len(place):
        out[place] = mix(out[place] ^ items[at])
        more = at + 1 < till
        place, at, till = place[more], at[more] + 1, till[more]
    return out


class Block:
    """Bytes of several texts and where each begins; `first` is the index of the first text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that don't cross texts: starts, ends, text index."""
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z, z
        at = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        till = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[at], end[till] = inside[at], inside[till]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than 0x20 and 0x09-0x0D."""
        return self.spans(~_SPACE[self.data])

    def hasher(self, seed: int = 1, lower: bool = False):
        """A function (starts, ends) -> 64-bit hashes of those byte ranges."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        return lambda starts, ends: hash_ranges(data, starts, ends, seed)

    def count(self, marked: np.ndarray) -> np.ndarray:
        """The number of marked bytes of each text."""
        at = np.flatnonzero(marked)
        return np.diff(np.searchsorted(at, self.offsets))


def blocks(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> Iterator[Block]:
    """Blocks of an Arrow string column; null counts as empty."""
    size = size or BLOCK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield Block(raw[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` consecutive items of one owner, and the run's first index."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(n, _U)
    for k in range(width):
        out = out * _U(_BASE) + hashes[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(out[at]), at


def counts_of(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Per owner: the number of items, or the sum of whole-number weights."""
    out = np.bincount(owner, weights, n) if weights is not None else np.bincount(owner, minlength=n)
    return out.astype(np.int64)


def repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with an owner and a key: how often the pair occurs in all, and whether it occurred before."""
    order = np.lexsort((key, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (key[order][1:] != key[order][:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    times, earlier = np.empty(len(order), np.int64), np.empty(len(order), bool)
    times[order], earlier[order] = size[group], ~new  # lexsort is stable: the first of a group comes first
    return times, earlier
