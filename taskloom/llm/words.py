"""Words of many texts at once, in numpy: a word is a run of bytes that are not ASCII white space."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Fixed random factors for the hash of a word: one for each byte value, and an odd base for its place.
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that is free again to the operating system: Spark keeps Python workers for later stages, and what
    the allocators hold back in an idle one is missing there."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_slices(col: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) over a column of texts, in slices of about
    `most` bytes; a longer text is a slice of its own. Null is empty."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and len(col.buffers()[2]) else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(col))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_places(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, its bytes, offsets of the rows among the words). gap: which bytes are in no word."""
    return runs(~gap[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_places() of bytes of which it is known whether they are in a word."""
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return starts, size, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, size: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each of the spans, none of them empty. lower: A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _BYTE.copy()
    if lower:
        table[65:91] = table[97:123]
    power, out = powers(_BASE, int(size.max())), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 16):  # what is made for each byte is many times the text
        s, n = starts[i : i + (1 << 16)], size[i : i + (1 << 16)]
        place = ragged(n)
        out[i : i + len(n)] = np.add.reduceat(table[data[np.repeat(s, n) + place]] * power[place], np.cumsum(n) - n)
    return mix(out + size.astype(np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word in order, offsets of the rows among the words). lower: A-Z count as a-z."""
    starts, size, rows = word_places(data, offsets)
    return hash_spans(data, starts, size, lower), rows


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of binary values of the given sizes, laid end to end in data."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
