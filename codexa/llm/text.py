"""Vectorised text primitives over whole Arrow batches.

A batch's texts are one flat array of bytes or code points plus offsets; words are found and
hashed by numpy passes over that array, so cost per character does not include a Python call.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(U, copy=True)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a fixed seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed)) | U(1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def code_points(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts as code points and offsets in code points."""
    heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets]


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each part have ``budget`` bytes at most, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + budget, "right")))
            yield batch.slice(at, to - at)
            at = to


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            self.up, self.down = np.full(size, BASE, U), np.full(size, BASE_INVERSE, U)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


POWERS = Powers()


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[start:end] for every span; equal content gives equal hashes."""
    up, down = POWERS.to(len(units) + 1)
    sums = np.zeros(len(units) + 1, U)
    np.cumsum((units.astype(U) + U(1)) * U(0xA24BAED4963EE407) * up[: len(units)], out=sums[1:], dtype=U)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all len(units)-k+1 windows of k units."""
    starts = np.arange(len(units) - k + 1)
    return span_hashes(units, starts, starts + k)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs of true values that stay in one text."""
    n = len(inside)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(start)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    for at in range(0x110000):
        kind = unicodedata.category(chr(at))[0]
        if kind == "L":
            out[at] = LETTER
        elif kind == "N":
            out[at] = NUMBER
    out[WHITE] = SPACE
    return out


class HashIndex:
    """Open-addressing map from mixed 64-bit hashes to 0, 1, 2, ..., looked up by whole arrays."""

    def __init__(self, size: int = 1 << 16) -> None:
        self.n = 0
        self._make(size)

    def _make(self, size: int) -> None:
        self.keys, self.vals, self.mask = np.zeros(size, U), np.full(size, -1, np.int32), U(size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where absent."""
        slot = h & self.mask
        out = self.vals[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        slot = slot[left]
        while left.size:
            slot = (slot + U(1)) & self.mask
            got = self.vals[slot]
            out[left] = got
            more = (self.keys[slot] != h[left]) & (got >= 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Give distinct, absent hashes the next numbers."""
        if 2 * (self.n + len(h)) > len(self.keys):
            taken = self.vals >= 0
            old, numbers = self.keys[taken], self.vals[taken]
            self._make(1 << int(4 * (self.n + len(h))).bit_length())
            self._put(old, numbers)
        numbers = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._put(h, numbers)
        self.n += len(h)
        return numbers

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        slot = h & self.mask
        while h.size:
            free = self.vals[slot] < 0
            self.vals[slot[free]] = numbers[free]
            won = free & (self.vals[slot] == numbers)
            self.keys[slot[won]] = h[won]
            h, numbers, slot = h[~won], numbers[~won], (slot[~won] + U(1)) & self.mask

    def number(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all hashes, adding absent ones; and the position of each one added."""
        out = self.find(h)
        absent = np.flatnonzero(out < 0)
        if not absent.size:
            return out, absent
        new, where, back = np.unique(h[absent], return_index=True, return_inverse=True)
        out[absent] = self.add(new)[back]
        return out, absent[where]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start, start+1, ... of the given lengths."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(starts - (total - lengths), lengths)
