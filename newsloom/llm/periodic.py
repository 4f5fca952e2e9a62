"""Runs of periodic words in every text, by block convolution at dyadic scales.

A run of period d has at least 4 d words, so for the power of two with scale <= d < 2 scale it holds aligned blocks of scale words that
occur again d words later. At each scale every block is held against the window that follows it: with words mapped to numbers x and
y the sum of squared differences at a distance is sum x^2 + sum y^2 - 2 sum x y; the last sum is a correlation, computed for all
distances of the scale at once by a number-theoretic transform, which is exact in integers modulo a prime. A block occurs where the
sum is zero: true occurrences always give zero, and the few sums that are zero by the modulus alone fall when a hit is extended.

Hits of consecutive blocks at one distance are one seed. Seeds inside a run that a smaller scale has found are powers of its period
and go (Fine and Wilf); the others are extended word by word to both sides. A stretch found is a run when it is long enough; its
smallest period is the distance, as a smaller one would have been found before. Equal words are equal 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import lean, workers_import
from newsloom.llm.textbytes import SPACE_WORDS, word_runs

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Numbers transformed together (8 bytes each, a few arrays of them); bytes of kept words joined together.
SLICE, JOINED_BYTES = 1 << 17, 1 << 20


class Fermat:
    """Arithmetic modulo 2**16 + 1, where 2**16 is -1: a number is folded to its low half less its high one, kept signed and lazy."""

    prime, generator, longest, kind = 65537, 3, 1 << 16, np.int64

    @staticmethod
    def fold(x: np.ndarray) -> np.ndarray:
        high = x >> 16
        x = x & 0xFFFF
        x -= high
        return x

    def constant(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.int64)
        return np.where(x > self.prime // 2, x - self.prime, x)

    add, sub = staticmethod(np.add), staticmethod(np.subtract)

    def zero(self, x: np.ndarray) -> np.ndarray:
        x = self.fold(self.fold(self.fold(x)))  # now from -3 to the prime
        return (x == 0) | (x == self.prime)


class Proth:
    """Arithmetic modulo 3 * 2**30 + 1, for transforms that are too long for Fermat; products fit 64 bits."""

    prime, generator, longest, kind = 3 * (1 << 30) + 1, 5, 1 << 30, np.uint64

    def fold(self, x: np.ndarray) -> np.ndarray:
        return x % np.uint64(self.prime)

    def constant(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, np.uint64)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) % np.uint64(self.prime)

    def sub(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + (np.uint64(self.prime) - b)) % np.uint64(self.prime)

    def zero(self, x: np.ndarray) -> np.ndarray:
        return self.fold(x) == 0


class Transform:
    """Number-theoretic transforms of 2 * half numbers along the first axis; frequencies stand in bit-reversed order."""

    def __init__(self, half: int):
        size = 2 * half
        self.half, self.field = half, Fermat() if size <= Fermat.longest else Proth()
        p = self.field.prime
        root = pow(self.field.generator, (p - 1) // size, p)
        self.down, self.up = self._powers(root, half), self._powers(pow(root, -1, p), half)
        self.scale = self.field.constant(np.array((-2 * pow(size, -1, p)) % p))  # of the inverse, times the -2 of a squared difference
        place = np.zeros(1, np.int64)
        while len(place) < size:  # place[k]: where frequency k stands
            place = np.concatenate([2 * place, 2 * place + 1])
        at = np.argsort(place)
        self.mirrored = place[(-at) % size]

    def _powers(self, root: int, n: int) -> np.ndarray:
        p, out, power = self.field.prime, np.ones(1, np.uint64), root
        while len(out) < n:  # doubled; power is root ** len(out)
            out = np.concatenate([out, out * np.uint64(power) % np.uint64(p)])
            power = power * power % p
        return self.field.constant(out[:n].astype(np.int64))

    def forward(self, blocks: np.ndarray) -> np.ndarray:
        """(half, n) numbers, followed by as many zeros, to (2 * half, n) frequencies."""
        f, h, n = self.field, self.half, blocks.shape[1]
        v = np.empty((2 * h, n), f.kind)
        v[:h] = blocks
        v[h:] = f.fold(blocks * self.down[:, None])
        width = h // 2
        while width:
            w = v.reshape(-1, 2, width, n)
            twist = self.down[:: h // width][:, None]
            a, b = f.add(w[:, 0], w[:, 1]), f.fold(f.sub(w[:, 0], w[:, 1]) * twist)
            w[:, 0], w[:, 1] = a, b
            width //= 2
        return f.fold(v)

    def correlation(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-2 * sum over i of x[i] y[i + d] for d from 0 to half - 1, from the frequencies of x and y."""
        f, h, n = self.field, self.half, x.shape[1]
        v = f.fold(x[self.mirrored] * y)
        width = 1
        while width < h:
            w = v.reshape(-1, 2, width, n)
            t = f.fold(w[:, 1] * self.up[:: h // width][:, None])
            a, b = f.add(w[:, 0], t), f.sub(w[:, 0], t)
            w[:, 0], w[:, 1] = a, b
            width *= 2
        return f.fold(f.add(v[:h], f.fold(v[h:] * self.up[:, None])) * self.scale)


_TRANSFORMS: dict[int, Transform] = {}


def _transform(half: int) -> Transform:
    if half > 1 << 14:  # as rare as large
        return Transform(half)
    if half not in _TRANSFORMS:
        _TRANSFORMS[half] = Transform(half)
    return _TRANSFORMS[half]


def occurrences(numbers: np.ndarray, scale: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, block) where blocks of scale numbers occur again, for distances from scale to 2 * scale - 1, in order.

    numbers are whole blocks, valid marks those to be looked for (two blocks must follow each)."""
    t = _transform(scale)
    f, n = t.field, len(valid)
    squares = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers.astype(np.uint64) ** np.uint64(2), out=squares[1:])  # differences are exact: below 2**64 for 2**32 numbers
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, SLICE // (2 * scale))
    for b in range(0, n - 2, step):
        e = min(n - 2, b + step)
        if not valid[b:e].any():
            continue
        p = t.forward(numbers[b * scale : (e + 2) * scale].reshape(-1, scale).T.astype(f.kind))
        k = e - b
        y = np.empty((2 * scale, k), f.kind)  # a window is two blocks; a shift by half a transform turns the sign of odd frequencies
        y[:scale] = f.add(p[:scale, 1 : k + 1], p[:scale, 2 : k + 2])
        y[scale:] = f.sub(p[scale:, 1 : k + 1], p[scale:, 2 : k + 2])
        cross = t.correlation(p[:, :k], f.fold(y))
        edge = np.arange(b, e) * scale
        own = squares[edge + scale] - squares[edge]
        at = edge[None, :] + scale + np.arange(scale)[:, None]
        both = squares[at + scale]
        both -= squares[at]
        both += own[None, :]
        total = f.add(f.fold(both.astype(f.kind)), cross)
        d, j = np.nonzero(f.zero(total) & valid[None, b:e])
        found.append((d + scale, j + b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, d))
    return d[order], j[order]


def equal_stretch(h: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int = 1) -> np.ndarray:
    """How many of h[a], h[a + step], ... equal h[b], h[b + step], ... before the first difference; limit at most."""
    out, active, width = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0), 8
    while len(active):
        w = max(1, min(width, (1 << 20) // len(active)))
        k = np.arange(w)
        inside = out[active][:, None] + k < limit[active][:, None]
        move = step * np.where(inside, out[active][:, None] + k, 0)
        same = (h[a[active][:, None] + move] == h[b[active][:, None] + move]) & inside
        run = np.where(same.all(1), w, np.argmin(same, 1))
        out[active] += run
        active = active[(run == w) & (out[active] < limit[active])]
        width *= 2
    return out


class Runs:
    """Runs found so far, in the order of their starts: start, end (behind the last word) and period."""

    def __init__(self) -> None:
        self.start = self.end = self.period = self.reach = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        each = np.unique(np.stack([np.concatenate(x) for x in ((self.start, start), (self.period, period), (self.end, end))], 1), axis=0)
        self.start, self.period, self.end = each.T
        self.reach = np.maximum.accumulate(self.end)

    def cover(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a run holds all of [start, end)."""
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.reach[at] >= end)


def find_runs(h: np.ndarray, first: np.ndarray) -> Runs:
    """All runs in documents of words h[first[i]:first[i + 1]] (64-bit hashes); starts and ends count in h."""
    runs, size = Runs(), np.diff(first)
    # random numbers below 2**16, one for each word
    residue = (h >> np.uint64(48)).astype(np.int64)
    scale = 1
    while len(size) and LEAST_PERIODS * scale <= size.max():
        docs = np.flatnonzero(size >= max(LEAST_WORDS, LEAST_PERIODS * scale))
        if len(docs):
            _find_at(scale, docs, h, residue, first, size, runs)
        scale *= 2
    return runs


def _find_at(scale: int, docs: np.ndarray, h: np.ndarray, residue: np.ndarray, first: np.ndarray, size: np.ndarray, runs: Runs) -> None:
    n, begin = size[docs], first[docs]
    blocks = n // scale + 1  # the last one is filled up
    edge = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    numbers = np.random.default_rng(scale).integers(0, 1 << 16, total * scale)
    where = np.repeat(edge * scale - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    numbers[where] = residue[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    of = np.repeat(np.arange(len(docs)), blocks)
    local = np.arange(total) - edge[of]
    distance, block = occurrences(numbers, scale, local < blocks[of] - 2)
    if not len(block):
        return
    new = np.ones(len(block), bool)
    new[1:] = (np.diff(block) != 1) | (np.diff(distance) != 0)  # a document's last two blocks never occur, so none goes on in the next
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(block)))
    d, block = distance[lead], block[lead]
    shortest = np.maximum(LEAST_WORDS, LEAST_PERIODS * d)  # of a run; its words that come again are d less, and hold so many whole blocks
    enough = count >= np.maximum(1, (shortest - d - scale + 1) // scale)
    d, block, count, shortest = d[enough], block[enough], count[enough], shortest[enough]
    doc = of[block]
    start = begin[doc] + local[block] * scale
    stop = begin[doc] + n[doc]
    end = np.minimum(start + count * scale, stop - d)  # only the modulus can make a hit with the filling behind a document
    keep = (start < end) & ~runs.cover(start, end + d)
    found: list[tuple[np.ndarray, ...]] = []
    while keep.any():
        d, start, end, stop, doc, shortest = (x[keep] for x in (d, start, end, stop, doc, shortest))
        right = equal_stretch(h, start, start + d, stop - start - d)
        left = equal_stretch(h, start - 1, start - 1 + d, start - begin[doc], -1)
        good = left + right + d >= shortest
        found.append(((start - left)[good], (start + right + d)[good], d[good]))
        start = start + right + 1  # behind a difference that the modulus hid; nothing is left of a seed without one
        keep = start < end
    if found:
        a, b, period = (np.concatenate(x) for x in zip(*found, strict=True))
        fresh = ~runs.cover(a, b)
        runs.add(a[fresh], b[fresh], period[fresh])


def made_periodic(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """Which word stands in each place when texts are edited by their ids: of one in ten, the words from some place on repeat."""
    out = np.arange(int(first[-1]))
    for k, name in enumerate(ids):
        n, start = int(first[k + 1] - first[k]), int(first[k])
        if name is None or not n:
            continue
        h = zlib.crc32(str(name).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[start + a : start + n] = start + a + np.arange(n - a) % p
    return out


def _joined_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, docs: int) -> list[str]:
    """SHA-256 of each document's words, joined by one space."""
    digests: list = [None] * docs
    size = end - start + 1  # with the space before it
    total = np.cumsum(size)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + JOINED_BYTES, "right")))
        width = size[i:j]
        edge = np.cumsum(width) - width
        out = np.full(int(width.sum()), 32, np.uint8)
        inner = np.ones(len(out), bool)
        inner[edge] = False
        out[inner] = data[np.repeat(start[i:j] - edge - 1, width)[inner] + np.flatnonzero(inner)]
        here, at = np.unique(of[i:j], return_index=True)
        for d, a, b in zip(here.tolist(), edge[at].tolist(), [*edge[at[1:]].tolist(), len(out)], strict=True):
            if digests[d] is None:
                digests[d] = hashlib.sha256()
                a += 1  # noqa: PLW2901  no space before the first word
            digests[d].update(out[a:b])
        i = j
    none = hashlib.sha256()
    return [(x or none).hexdigest() for x in digests]


_SCHEMA = "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start long, length long, period long>>, collapsed_words long, collapsed_sha256 string"


def _periodic(edited: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(batch.column(1), SPACE_WORDS, lower=False):
                n = len(words.count)
                ids = batch.column(0).slice(words.rows.start, n)
                h, start, end, of = words.hashes(), words.start, words.end, words.document()
                if edited:
                    source = made_periodic(ids.to_pylist(), words.first)
                    h, start, end = h[source], start[source], end[source]
                yield _summary(ids, words.data, h, start, end, words.first, of)

    return run


def _summary(ids: pa.Array, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    n, runs = len(first) - 1, find_runs(h, first)
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.end, -1)
    kept = np.cumsum(change)[:-1] == 0
    owner = of[runs.start]
    count = np.bincount(owner, minlength=n)
    length, local = runs.end - runs.start, runs.start - first[owner]
    order = np.lexsort((runs.period, local, -length, owner))
    best = order[np.cumsum(count)[count > 0] - count[count > 0]]
    top = np.full((3, n), -1)
    top[:, count > 0] = local[best], length[best], runs.period[best]
    none = count == 0
    listed = pa.StructArray.from_arrays([pa.array(x) for x in (local, length, runs.period)], names=["start", "length", "period"])
    edges = np.append(0, np.cumsum(count)).astype(np.int32)
    columns = [pa.array(np.diff(first)), pa.array(count), *(pa.array(x, mask=none) for x in (*top, 1000 * top[1] // np.maximum(1, top[2])))]
    digests = _joined_digests(data, start[kept], end[kept], of[kept], n)
    left = np.bincount(of[kept], minlength=n)
    return pa.RecordBatch.from_arrays(
        [ids, *columns, pa.ListArray.from_arrays(pa.array(edges), listed), pa.array(left), pa.array(digests)],
        names=["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_words", "collapsed_sha256"],
    )


def periodic_runs(docs: DataFrame, edited: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_runs; start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; null without one); runs (array of start, length, period, by start and period); collapsed_words and
    collapsed_sha256: how many words are left when each run keeps its first period only, and their digest, joined by one space.

    Words are runs of non-white space as they are written. edited: the texts of one id in ten are made periodic first. A null or
    empty text has no words, no runs and the digest of the empty text. Rows with a null id are not edited; repeated rows are judged
    each; texts of any length are read whole, each within its task. An empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lean(_periodic(edited)), _SCHEMA).withColumnRenamed("id", id_column)
