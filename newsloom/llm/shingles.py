"""Five-word shingle sets and their MinHash signatures, per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from newsloom.llm.textbytes import SPACE_WORDS, mix, word_runs


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (of all words, document borders are the caller's business); none of fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out *= np.uint64(0x9FB21C651E98DF25)
            out += words[i : len(words) - n + 1 + i]
            out ^= out >> np.uint64(29)
        return mix(out)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, hashes, first): the sorted distinct shingle hashes of row r are hashes[first[r]:first[r + 1]].

    A text of fewer words than size has its whole word sequence as the one shingle; no words, no shingles.
    """
    for run in word_runs(column, SPACE_WORDS):
        words, count = run.hashes(), run.count
        full = np.flatnonzero(count >= size)
        shingles = combine(words, size)
        width = count[full] - size + 1
        begin = np.cumsum(width) - width
        index = np.repeat(run.first[:-1][full] - begin, width) + np.arange(int(width.sum()))
        hashes, owner = shingles[index], np.repeat(full, width)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            hashes = np.concatenate([hashes, np.array([combine(words[run.first[d] : run.first[d + 1]], int(count[d]))[0] for d in short], np.uint64)])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
        edge = np.searchsorted(owner, np.arange(len(count) + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            hashes[a:b].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[keep], owner[keep]
        yield run.rows, hashes, np.searchsorted(owner, np.arange(len(count) + 1))


class MinHash:
    """Minima of multiplicative hashes. The first bands * rows of them are hashed to 64-bit band keys; all samples are folded to an odd sketch."""

    def __init__(self, bands: int = 32, rows: int = 4, samples: int = 256, sketch_bits: int = 512, seed: int = 20240131):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.samples, self.sketch_bits = bands, rows, max(samples, bands * rows), sketch_bits
        self.factor = rng.integers(0, 1 << 31, self.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offset = rng.integers(0, 1 << 32, self.samples, dtype=np.uint32)

    def minima(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(sets, samples) minima; empty sets must have been left out."""
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(first) - 1, self.samples), np.uint32)
        value, tmp = np.empty_like(low), np.empty_like(low)
        starts = first[:-1]
        for i in range(self.samples):
            np.bitwise_xor(low, self.offset[i], out=value)
            np.multiply(value, self.factor[i], out=value)
            np.right_shift(value, 15, out=tmp)
            np.bitwise_xor(value, tmp, out=value)
            out[:, i] = np.minimum.reduceat(value, starts)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(minima), self.bands)).copy()
            for r in range(self.rows):
                key = mix(key + minima[:, r : self.bands * self.rows : self.rows].astype(np.uint64) + np.uint64(r))
        return key

    def odd_sketches(self, minima: np.ndarray) -> np.ndarray:
        """(sets, sketch_bits / 64) words: each sample toggles one bit, so equal samples cancel in the XOR of two sketches."""
        with np.errstate(over="ignore"):
            spot = mix(minima.astype(np.uint64) + (np.arange(1, minima.shape[1] + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(self.sketch_bits)
        out = np.zeros((len(minima), self.sketch_bits // 64), np.uint64)
        rows = np.arange(len(minima))
        for i in range(minima.shape[1]):
            s = spot[:, i]
            out[rows, (s >> np.uint64(6)).astype(np.intp)] ^= np.uint64(1) << (s & np.uint64(63))
        return out
