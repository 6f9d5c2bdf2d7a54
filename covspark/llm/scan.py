"""Vectorised scans of Arrow string columns: words, their hashes, windows.

Nothing here makes a Python object per word. A word's hash is the sum of a random
value for each of its bytes at its place in the word, so prefix sums give it by one
subtraction; a window's is made from those of its halves by a bijection that is not
linear, so no pattern of words cancels out. Either comes in independent versions of
64 bits: two make 128.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes hashed at once; the power tables are this long
CHUNK = 1 << 21  # bytes of text handled at once by the operators

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


SPOTS = 64  # places in a word that have values of their own in a table, 2**6; those beyond are mixed from them


@cache
def byte_values(fold: bool, version: int) -> np.ndarray:
    """A random 64-bit value per place and byte, flat; with fold, A-Z have the values of a-z."""
    values = mix(mix(np.arange(1, 256 * SPOTS + 1, dtype=np.uint64) * _BASE) + np.uint64(version)).reshape(SPOTS, 256)
    if fold:
        values[:, 65:91] = values[:, 97:123]
    return values.ravel()


def white_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def plain_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text whose A-Z became a-z."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x41:0x5B] = inside[0x80:] = True
    return inside


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, a row at least."""
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, len(batch)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Words of some texts: those of text i are rows at[i]:at[i + 1]. check is a second hash, if asked for."""

    data: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    check: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def words(column: pa.Array, inside: np.ndarray, fold: bool = False, versions: int = 1) -> Words:
    """All words of every text, hashed once, in two versions or not at all; a word ends with its text."""
    data, at = utf8(column)
    begins, ends, hashes = [], [], [[] for _ in range(versions)]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:  # cut where no word goes on
            cut = np.flatnonzero(~inside[data[a:b]] | fresh[a + 1 : b + 1])
            if len(cut):
                b = a + int(cut[-1]) + 1
            else:
                b += 1
                while b < n and inside[data[b - 1]] and not fresh[b]:
                    step = np.flatnonzero(~inside[data[b : b + BLOCK]] | fresh[b + 1 : min(n, b + BLOCK) + 1])
                    b = b + int(step[0]) + 1 if len(step) else min(n, b + BLOCK)
        part = data[a:b]
        own, new = inside[part], fresh[a : b + 1]
        begin = own.copy()
        begin[1:] &= ~own[:-1] | new[1:-1]
        end = own.copy()
        end[:-1] &= ~own[1:] | new[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if versions:
            size = e - s
            place = np.arange(b - a, dtype=np.int32) - np.repeat(np.concatenate([[0], s]).astype(np.int32), np.diff(np.concatenate([[0], s, [b - a]])))
            spot = ((place & (SPOTS - 1)) << 8) | part
            far = np.flatnonzero((place >= SPOTS) & own) if len(size) and size.max() > SPOTS else None
            for version, found in enumerate(hashes):
                values = byte_values(fold, version)[spot]
                if far is not None:
                    values[far] = mix(values[far] + (place[far] >> 6).astype(np.uint64) * _BASE)
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum(values, out=sums[1:])
                found.append(mix(sums[e] - sums[s] + size.astype(np.uint64)))
        begins.append(s + a)
        ends.append(e + a)
        a = b
    begin, end, *hashed = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((begins, np.int64), (ends, np.int64), *((x, np.uint64) for x in hashes)))
    none = np.zeros(0, np.uint64)
    return Words(data, np.searchsorted(begin, at), begin, end, hashed[0] if versions else none, hashed[-1] if versions > 1 else none)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(left * _BASE + right)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many consecutive values; len(hashes) - length + 1 of them.

    Runs of 1, 2, 4, ... values are hashed from their halves, and those that
    length is the sum of are joined.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    n = len(hashes) - length + 1
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):  # by blocks: what is in hand stays in cache
        m = min(BLOCK, n - a)
        level, size, whole, done = hashes[a : a + m + length - 1], 1, None, 0
        while True:
            if length & size:
                part = level[done : done + m]
                whole, done = part if whole is None else joined(whole, part), done + size
            if done == length:
                break
            level, size = joined(level[:-size], level[size:]), 2 * size
        out[a : a + m] = mix(whole)
    return out


def starts(at: np.ndarray, length: int) -> np.ndarray:
    """Rows at which a run of so many values lies within one text."""
    room = np.maximum(np.diff(at) - length + 1, 0)
    return ranges(at[:-1], room)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.arange(total) + np.repeat(begin - before, count)


def trim() -> None:
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no trim
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker hands its memory back when a partition ends: Spark reuses workers for other operators."""

    def inner(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            trim()

    return inner


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
