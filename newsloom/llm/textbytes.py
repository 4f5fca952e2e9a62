"""Vectorised word handling over Arrow string batches, shared by the text operators.

A batch of texts is viewed as one byte buffer. Words are maximal runs of "word bytes" of a byte class; every byte of a
multi-byte UTF-8 character is >= 0x80, so byte classes that treat those alike never cut a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_HASH_WINDOW = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256 flags; the ranges (both ends inside) hold the bytes that are NOT part of a word."""
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Words between white space: [^\x20\x09-\x0D]+
SPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of letters, digits and everything outside ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
PLAIN_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), applied to fresh arrays in place."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have = 1
    while have < n:  # doubling
        step = out[have - 1] * base
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        with np.errstate(over="ignore"):
            _CACHE["up"], _CACHE["down"] = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _CACHE["up"], _CACHE["down"]


def text_hash(text: str) -> int:
    """The hash that word_hashes() gives to this one (already lower-cased) word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each word: polynomial prefix sums, shifted back by the inverse power."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            a = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, a + _HASH_WINDOW, "right")))
            b = int(end[j - 1])
            up, down = _power_tables(max(_HASH_WINDOW, b - a) + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


@dataclass
class Words:
    """Words of a run of documents. Word w is data[start[w]:end[w]]; document d owns words first[d]:first[d + 1]."""

    rows: slice
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, rows: slice, lower: bool = True) -> Words:
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    data = LOWER[data] if lower else data
    cut = offsets - base
    inside = table[data]
    edge = np.zeros(len(data) + 1, np.int8)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1].view(bool)) if len(data) > 1 else None
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    edges = np.flatnonzero(edge)
    start, end = edges[0::2], edges[1::2]
    # a document border inside a run cuts it
    border = np.unique(cut[(cut > 0) & (cut < len(data))])
    border = border[inside[border] & inside[border - 1]] if len(border) else border
    if len(border):
        start, end = np.sort(np.concatenate([start, border])), np.sort(np.concatenate([end, border]))
    return Words(rows, data, start, end, np.searchsorted(start, cut))


def word_runs(column: pa.Array, table: np.ndarray, run_bytes: int = 1 << 21, lower: bool = True) -> Iterator[Words]:
    """Words of all rows of a column, in runs of about run_bytes (a longer text is a run of its own)."""
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, "right")) - 1))
        yield split_words(data, offsets[i : j + 1], table, slice(i, j), lower)
        i = j
