"""Token-id files: one wavelet matrix per shard.

A shard holds documents that follow one another by id. Plane by plane, from the highest bit of the largest token id, the tokens are
parted stably into those with bit 0 and those with bit 1; a plane keeps the bits in the order before its parting. Its directories
count the ones before every block of bits and name the block of every so many-th one and zero. From these any token can be read,
its occurrences before a position counted, and its k-th occurrence found, in a time that does not grow with the shard. The bits of
a plane are compressed by zstd in sections of their own, and only the sections that are touched are opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import broadcast_if_small, lean, workers_import
from newsloom.llm.word_ids import encoded_runs

MAGIC, VERSION = b"NLWM", 2
#: Tokens that close a shard; bits of a plane between two stored counts; ones (or zeros) between two stored places.
SHARD_TOKENS, BLOCK_BITS, SAMPLE = 4_000_000, 512, 4096
#: Words of 64 bits in a compressed section of a plane.
SECTION = 8192
BROADCAST_SHARDS = 200_000


class Plane:
    """A row of bits with rank and select. Sections of the bits are opened when they are first read."""

    def __init__(self, n: int, words: np.ndarray, counts: np.ndarray, samples: list[np.ndarray], packed: list[bytes] | None = None):
        """counts: ones before every block and in all; samples: the blocks of every SAMPLE-th zero, and of every SAMPLE-th one."""
        self.n, self.words, self.counts, self.samples, self.packed = n, words, counts, samples, packed
        self.shut = np.ones(len(packed), bool) if packed is not None else np.zeros(0, bool)

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        per = BLOCK_BITS // 64
        data = np.packbits(bits, bitorder="little")
        words = np.pad(data, (0, -len(data) % (BLOCK_BITS // 8))).view("<u8")
        ones = np.bitwise_count(words).reshape(-1, per).sum(1, dtype=np.int64)
        counts = np.concatenate([[0], np.cumsum(ones)])
        size = np.minimum(BLOCK_BITS, len(bits) - BLOCK_BITS * np.arange(len(ones)))
        samples = [np.searchsorted(c[1:], np.arange(0, int(c[-1]), SAMPLE), "right") for c in (np.concatenate([[0], np.cumsum(size - ones)]), counts)]
        return cls(len(bits), words, counts, samples)

    def opened(self, words: np.ndarray | None = None) -> np.ndarray:
        """The words, with those at the given places (all, if none are given) read from the file."""
        if self.packed is not None and self.shut.any():
            wanted = np.flatnonzero(self.shut) if words is None else np.unique(words // SECTION)
            for k in wanted[self.shut[wanted]].tolist():
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed[k]), "<u8")
                self.words[k * SECTION : k * SECTION + len(part)] = part
                self.shut[k] = False
        return self.words

    def bit(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return ((self.opened(word)[word] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to n)."""
        per, block = BLOCK_BITS // 64, at // BLOCK_BITS
        out = self.counts[block].astype(np.int64)
        rest, word = at % BLOCK_BITS, block * per
        words = self.opened(np.minimum(word, max(0, len(self.words) - 1)))
        for k in range(per):  # the words of the block that lie before the position, the last one in part
            bits = np.clip(rest - 64 * k, 0, 64)
            some = np.flatnonzero(bits)
            part = words[word[some] + k]
            cut = bits[some]
            out[some] += np.bitwise_count(np.where(cut == 64, part, part & ((np.uint64(1) << (cut % 64).astype(np.uint64)) - np.uint64(1))))
        return out

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th ones (value 1) or zeros (value 0), from 0; there must be that many."""
        per, sample = BLOCK_BITS // 64, self.samples[value]
        low = sample[k // SAMPLE]
        high = np.append(sample, len(self.counts) - 2)[k // SAMPLE + 1]
        before = lambda b: self.counts[b] if value else b * BLOCK_BITS - self.counts[b]  # noqa: E731  in full blocks
        while (low < high).any():  # the last block with at most k before it
            middle = (low + high + 1) >> 1
            right = before(middle) <= k
            low, high = np.where(right, middle, low), np.where(right, high, middle - 1)
        left, word = k - before(low), low * per
        words = self.opened(word)
        done = np.zeros(len(k), bool)
        for _ in range(per - 1):  # to the word
            inside = np.bitwise_count(words[word] if value else ~words[word]).astype(np.int64)
            done |= left < inside
            left, word = np.where(done, left, left - inside), np.where(done, word, word + 1)
        value_bits = words[word] if value else ~words[word]
        bits = np.unpackbits(value_bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(bits, 1) <= left[:, None]).sum(1)
        return word * 64 + inside

    def all(self) -> np.ndarray:
        return np.unpackbits(self.opened().view(np.uint8), bitorder="little", count=self.n).view(bool)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        """planes: the highest bit first; zeros: tokens with bit 0 in each plane."""
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        row = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (row & (1 << b)) != 0
            planes.append(Plane.of(bit))
            low = row[~bit]
            zeros.append(len(low))
            row = np.concatenate([low, row[bit]])
        return cls(len(tokens), planes, zeros)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at these positions."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit, ones = plane.bit(at), plane.ones(at)
            value = value << 1 | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return value.astype(np.uint32)

    def rank(self, token: int, at: int) -> int:
        """Occurrences of token before position at."""
        return self.count(token, 0, at)

    def count(self, token: int, start: int, end: int) -> int:
        low, high = self._range(token, start, end)
        return high - low

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the token's occurrences from low to high stand after the last parting."""
        if token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            a, b = plane.ones(np.array([low, high])).tolist()
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (len(self.planes) - 1 - k) & 1 else (low - a, high - b)
        return low, high

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the occurrences number first to last - 1 (all from first, if last is not given), ascending."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low + first, high if last is None else min(high, low + last))
        for p in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - p) & 1
            at = self.planes[p].select(one, at - self.zeros[p] if one else at) if len(at) else at
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), -1 if there are fewer."""
        found = self.occurrences(token, k, k + 1)
        return int(found[0]) if len(found) else -1

    def tokens(self) -> np.ndarray:
        """All tokens in their order, faster than access to all of them: the partings undone, lowest bit first."""
        row = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = self.planes[k].all()
            before = np.empty_like(row)
            before[~bit] = row[: self.zeros[k]]
            before[bit] = row[self.zeros[k] :] | row.dtype.type(1 << (len(self.planes) - 1 - k))
            row = before
        return row.astype(np.uint32)


def pack_shard(ids: np.ndarray, ends: np.ndarray, tokens: np.ndarray, end_id: int, missing: np.ndarray | None = None) -> bytes:
    """A shard's file: header, sizes of sections, sections. Every document's last token is end_id; ids and `missing` (no id) are
    the documents'. Which of end_id's occurrences end no document is kept beside them; for a special token that is none."""
    matrix = WaveletMatrix.build(tokens)
    press = zstandard.ZstdCompressor(level=1).compress
    missing = np.zeros(len(ids), bool) if missing is None else missing
    inner = np.flatnonzero(~np.isin(np.flatnonzero(tokens == end_id) + 1, ends))
    sections = [press(x.tobytes()) for x in (ids.astype("<i8"), np.packbits(missing), np.array(matrix.zeros, "<i8"), inner.astype("<i8"))]
    for p in matrix.planes:
        sections += [press(x.tobytes()) for x in (p.counts.astype("<u4"), p.samples[0].astype("<u4"), p.samples[1].astype("<u4"))]
        sections += [press(p.words[i : i + SECTION].tobytes()) for i in range(0, len(p.words), SECTION)]
    head = MAGIC + struct.pack("<HHqqqq", VERSION, len(matrix.planes), end_id, len(ids), len(tokens), len(sections))
    return head + struct.pack(f"<{len(sections)}q", *map(len, sections)) + b"".join(sections)


@dataclass
class Shard:
    ids: np.ndarray
    missing: np.ndarray
    end_id: int
    inner: np.ndarray
    matrix: WaveletMatrix

    def ends(self) -> np.ndarray:
        """Where documents end. The places of end ids come by select and are confirmed by access."""
        places = np.delete(self.matrix.occurrences(self.end_id), self.inner)
        if len(places) != len(self.ids) or (self.matrix.access(places) != self.end_id).any():
            raise ValueError("a token shard is damaged")
        return places + 1


def open_shard(payload: bytes) -> Shard:
    """The shard in a file; the bits of its planes stay compressed until they are read."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token shard")
    version, planes, end_id, n_docs, n_tokens, n_sections = struct.unpack_from("<HHqqqq", payload, 4)
    if version != VERSION:
        raise ValueError(f"token shard of version {version}")
    sizes = struct.unpack_from(f"<{n_sections}q", payload, 40)
    edge = np.cumsum([40 + 8 * n_sections, *sizes]).tolist()
    sections = [payload[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    open_ = zstandard.ZstdDecompressor().decompress
    ids, missing, zeros, inner = (np.frombuffer(open_(x), kind) for x, kind in zip(sections[:4], ("<i8", np.uint8, "<i8", "<i8"), strict=True))
    n_words = -(-n_tokens // BLOCK_BITS) * (BLOCK_BITS // 64)
    per, out = 3 + -(-n_words // SECTION), []
    for k in range(planes):
        part = sections[4 + k * per : 4 + (k + 1) * per]
        counts, *samples = (np.frombuffer(open_(x), "<u4").astype(np.int64) for x in part[:3])
        out.append(Plane(n_tokens, np.zeros(n_words, "<u8"), counts, samples, part[3:]))
    return Shard(ids, np.unpackbits(missing, count=n_docs).view(bool), end_id, inner, WaveletMatrix(n_tokens, out, zeros.tolist()))


def _shards(path: str, end_id: int, shard_tokens: int):
    """Documents in their order to shards: a shard is closed when it holds enough tokens. Part and place number it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            tokens, missing = np.concatenate(rows), np.array([i is None for i in ids], bool)
            payload = pack_shard(np.array([i or 0 for i in ids], np.int64), np.cumsum([len(r) for r in rows]), tokens, end_id, missing)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "place", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for run_rows, tokens, first in encoded_runs(batch.column(1), path):
                names = batch.column(0).slice(run_rows.start, len(first) - 1).to_pylist()
                for name, a, b in zip(names, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ids.append(name)
                    rows.append(np.append(tokens[a:b], np.uint32(end_id)))
                    held += b - a + 1
                    if held >= shard_tokens:
                        yield closed()
                        ids, rows, held, place = [], [], 0, place + 1
        if rows:
            yield closed()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards (part, place, n_docs, n_tokens, payload) of all documents as a Parquet table at path.

    Rows are range-partitioned by id, and by a hash of the text so that no id, and no missing one, is a hot range; (part, place)
    ascends with them. Each document's ids are followed by end_id, so a null or empty text is one token. Rows without an id
    come first and keep a null id. Repeated ids are kept as rows of their own, in the order of the hash. An empty table gives no shards.
    """
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    shards = ordered.mapInArrow(lean(_shards(tokenizer, end_id, shard_tokens), "words"), "part int, place int, n_docs long, n_tokens long, payload binary")
    shards.write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, place, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = open_shard(payload.as_py())
            ids, ends = shard.ids, shard.ends()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            tokens = shard.matrix.tokens().astype("<u4")
            data = memoryview(tokens.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            number = [pa.array(np.full(len(ids), x, np.int32)) for x in (part, place)]
            yield pa.RecordBatch.from_arrays([*number, pa.array(ids, mask=shard.missing), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["part", "place", "id", "inside", "n_tokens", "crc"])


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n, first_part, first_place, first_at) of each token: its occurrences in all shards, and the first of them.

    Each shard answers from its directories; no other token is read. A token that occurs nowhere has n 0 and a null place.
    """
    workers_import(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                matrix = open_shard(payload.as_py()).matrix
                found = [(t, matrix.count(t, 0, matrix.n), part, place, matrix.select(t, 0)) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())[k]) for k in range(5)], names=["token", "n", "part", "place", "at"])

    found = shards.select("part", "place", "payload").mapInArrow(lean(run), "token long, n long, part int, place int, at long")
    first = F.min(F.when(F.col("n") > 0, F.struct("part", "place", "at"))).alias("x")
    asked = shards.sparkSession.createDataFrame([(t,) for t in tokens], "asked long")
    sums = found.groupBy("token").agg(F.sum("n").alias("n"), first)
    return asked.join(sums, F.col("asked") == F.col("token"), "left").select(F.col("asked").alias("token"), F.coalesce("n", F.lit(0)).alias("n"), F.col("x.part").alias("first_part"), F.col("x.place").alias("first_place"), F.col("x.at").alias("first_at"))


def read_documents(shards: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document in the shards: id, start (tokens of all documents before it), n_tokens, ids_crc32.

    The ends of documents are looked up by select on the end id and confirmed by access. No shards give no rows.
    """
    workers_import(shards.sparkSession)
    sizes = shards.select("part", "place", "n_tokens")
    earlier = lambda w, of: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", earlier(Window.orderBy("part"), "all").alias("base"))  # one row a partition of the writer
    before = sizes.withColumn("inner", earlier(Window.partitionBy("part").orderBy("place"), "n_tokens")).join(parts, "part").select("part", "place", (F.col("base") + F.col("inner")).alias("before"))
    rows = shards.select("part", "place", "payload").mapInArrow(lean(_read), "part int, place int, id long, inside long, n_tokens long, crc long")
    rows = rows.join(broadcast_if_small(before, BROADCAST_SHARDS), ["part", "place"])
    return rows.select(F.col("id").alias(id_column), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
