"""Katz backoff language model (bigrams over unigrams) with Good-Turing discounts, trained and evaluated over partitioned tables.

Texts become chunks: a dictionary of word hashes and the documents as codes into it. All exchange is of packed arrays, so that a
shuffle moves a few bytes for each distinct entry of a chunk:

1. chunks ask the vocabulary partitions (ranges of word hashes) for the training count and number of each of their words;
2. chunks ask the bigram partitions (hashes of the history) for the training count of each of their bigrams, and for what the
   backoff weight of each history needs: how many of its bigrams occur once to five times, and the unigram probability of all
   words seen after it. A history with many occurrences is dealt to several partitions by the following word and its figures
   are summed by the asker, so no partition holds a hot word alone;
3. chunks evaluate: log P(w|h) = log(d(c) c / c(h)) for a bigram seen in training, else log alpha(h) + log P(w), and so on down
   to the mass left for unknown words. alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of the P(w) of the seen w), so every
   history's probabilities sum to 1.

Rows between chunks and partitions are no more than a chunk's distinct entries, however many partitions there are.
"""

from __future__ import annotations

import secrets
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import lean, shared_folder, shuffle_partitions, stored, workers_import
from newsloom.llm.textbytes import SPACE_WORDS, mix, word_runs

#: Text bytes of a chunk; tokens for which a partition of the tables is planned.
CHUNK_BYTES, PARTITION_TOKENS = 4 << 20, 1_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
END = np.uint64(0xE17D)  # the hash that stands for the end of a document
BEGIN = 0  # the number that stands for the beginning, as a history


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers (or float64) in the fewest bytes that hold them, byte plane by byte plane, compressed."""
    if values.dtype.kind != "f":
        top = int(values.max()) if len(values) else 0
        values = values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return struct.pack("<cq", values.dtype.char.encode(), len(values)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<cq", data)
    kind = np.dtype(kind.decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:]), np.uint8).reshape(kind.itemsize, n)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return values if kind.kind == "f" else values.astype(np.int64) if kind.itemsize < 8 else values


def discounts(occurring: list[int]) -> np.ndarray:
    """d[0..DISCOUNTED] from how many entries occur once, twice, ... DISCOUNTED + 1 times: Good-Turing, rescaled as by Katz so
    that counts above DISCOUNTED keep their weight. A ratio that the sparse counts make unusable is 1 (no discount)."""
    n = [0, *occurring]
    d = np.ones(DISCOUNTED + 1)
    if not n[1]:
        return d
    common = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
    for r in range(1, DISCOUNTED + 1):
        if n[r] and n[r + 1] and common < 1:
            ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < ratio < 1:
                d[r] = ratio
    return d


class Unigrams:
    """P(w) from counts; a unigram never seen has the mass that the discounts leave."""

    def __init__(self, tokens: int, words: int, occurring: list[int]):
        self.tokens, self.words, self.d = tokens, words, discounts(occurring)
        freed = float(sum((1 - self.d[r]) * r * occurring[r - 1] for r in range(1, DISCOUNTED + 1)))
        self.total = tokens if freed > 0 else tokens + 1
        self.unknown = (self.total - tokens + freed) / self.total

    def probability(self, counts: np.ndarray) -> np.ndarray:
        d = np.where(counts <= DISCOUNTED, self.d[np.minimum(counts, DISCOUNTED)], 1.0)
        return np.where(counts > 0, d * counts / self.total, self.unknown)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held_all = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for words in word_runs(batch.column(2), SPACE_WORDS, CHUNK_BYTES):
            n = words.count
            held = held_all[words.rows]
            known, codes = np.unique(words.hashes(), return_inverse=True)
            trained = np.bincount(codes, np.repeat(~held, n), len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([secrets.randbits(62)], pa.int64()), pa.array([batch.column(0).slice(words.rows.start, len(n)).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())),
                    *(pa.array([x], pa.binary()) for x in (squeeze(n), squeeze(np.diff(known, prepend=np.uint64(0))), squeeze(np.concatenate([[int((~held).sum())], trained])), squeeze(codes + 1))),
                    pa.array([int(n.sum())], pa.int64()),
                ],
                names=["chunk", "ids", "held", "sizes", "hashes", "trained", "codes", "tokens"],
            )


def _unpack_hashes(data: bytes) -> np.ndarray:
    """END, then the chunk's words."""
    return np.concatenate([[END], np.cumsum(expand(data).astype(np.uint64), dtype=np.uint64)]).astype(np.uint64)


def _vocabulary_asks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, trained in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hashes, trained = _unpack_hashes(hashes), expand(trained)
                rows = [(p, hashes[at].tobytes(), squeeze(trained[at])) for p, at in _by_part(_vocabulary_part(hashes, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "chunk", "hashes", "trained"])

    return run


def _by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, places) of the parts that occur; places in their order."""
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, first[1:]), strict=True)) if len(names) else []


def _vocabulary_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_REPLY = "chunk long, part int, a binary, b binary, stats array<long>"


def _reply(chunks: list[int | None], parts: list[int], a: list[bytes | None], b: list[bytes | None], stats: list[int]) -> pa.Table:
    """One row for each asking chunk, and one with the partition's own figures."""
    return pa.table({"chunk": pa.array([*chunks, None], pa.int64()), "part": pa.array([*parts, parts[0]], pa.int32()), "a": pa.array([*a, None], pa.binary()), "b": pa.array([*b, None], pa.binary()), "stats": pa.array([*[None] * len(chunks), stats], pa.list_(pa.int64()))})


def _answer_vocabulary(parts: int):
    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        all_hashes = np.concatenate(asked)
        words, back = np.unique(all_hashes, return_inverse=True)
        counts = np.rint(np.bincount(back, np.concatenate([expand(x.as_py()) for x in group.column("trained")]), len(words))).astype(np.int64)
        number = np.zeros(len(words), np.int64)
        seen = np.flatnonzero(counts)
        number[seen] = 1 + part + parts * np.arange(len(seen))  # numbers from 1, apart for each partition
        edge = np.cumsum([0, *map(len, asked)])
        at = [back[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        stats = [int(counts.sum()), len(seen), *(int((counts == r).sum()) for r in range(1, DISCOUNTED + 2))]
        return _reply(group.column("chunk").to_pylist(), [part] * len(at), [squeeze(number[i]) for i in at], [squeeze(counts[i]) for i in at], stats)

    return run


class _Chunk:
    """A chunk with its words' numbers and counts, and its distinct bigrams of known words."""

    def __init__(self, row: dict, parts: int, known: list[dict]):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        size = expand(row["sizes"]).astype(np.int64)
        hashes = _unpack_hashes(row["hashes"])
        number, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        places = dict(_by_part(_vocabulary_part(hashes, parts)))
        for r in known:
            at = places[r["part"]]
            number[at], count[at] = expand(r["a"]).astype(np.int64), expand(r["b"]).astype(np.int64)
        codes = expand(row["codes"]).astype(np.int64)
        end = np.cumsum(size + 1)
        stream = np.zeros(int(end[-1]) if len(end) else 0, np.int64)  # code 0: END
        inner = np.ones(len(stream), bool)
        inner[end - 1] = False
        stream[inner] = codes
        self.doc = np.repeat(np.arange(len(size)), size + 1)
        self.word, self.count = number[stream], count[stream]
        first = np.zeros(len(stream), bool)
        first[end - size - 1] = True
        self.history = np.where(first, BEGIN, np.roll(self.word, 1))
        before = np.roll(self.count, 1)
        self.history_known = first | (before > 0)
        self.history_count = np.where(first, -1, before)  # -1: how often a text begins is END's count
        self.begins = int(count[0])
        self.history_count[first] = self.begins
        self.history_known &= self.history_count > 0
        asks = np.flatnonzero(self.history_known & (self.count > 0))
        order = np.lexsort((self.word[asks], self.history[asks]))
        asks = asks[order]
        new = np.r_[True, (self.word[asks[1:]] != self.word[asks[:-1]]) | (self.history[asks[1:]] != self.history[asks[:-1]])] if len(asks) else np.zeros(0, bool)
        pair = np.cumsum(new) - 1
        self.pair = np.full(len(stream), -1)
        self.pair[asks] = pair
        lead = asks[new]
        self.h, self.w, self.hc, self.wc = self.history[lead], self.word[lead], self.history_count[lead], self.count[lead]
        self.trained = np.bincount(pair, ~self.held[self.doc[asks]], len(lead)).astype(np.int64)
        # histories that need a backoff weight: all known ones of the chunk
        known_at = np.flatnonzero(self.history_known)
        self.names, at = np.unique(self.history[known_at], return_index=True)
        self.name_count = self.history_count[known_at][at]

    def dealt(self, parts: int, hot: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each partition that is asked: the pairs, by history and word, and the histories (each is asked for itself as well).

        There are no more partitions in it than pairs and histories, however many there are in all.
        """
        shares = np.minimum(parts, -(-self.hc // hot))
        base = mix(self.h.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)
        part = ((base + mix(self.w.astype(np.uint64) ^ np.uint64(0x5BD1E995)) % shares.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.w, self.h))
        share = np.minimum(parts, -(-self.name_count // hot))
        which = np.repeat(np.arange(len(self.names)), share)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(share) - share, share)
        home = ((mix(self.names[which].astype(np.uint64) + np.uint64(1)) % np.uint64(parts) + turn.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(self.names[which], kind="stable")
        none = np.zeros(0, np.int64)
        pairs = {p: order[at] for p, at in _by_part(part[order])}
        return {p: (pairs.get(p, none), which[by[at]]) for p, at in _by_part(home[by])}  # a pair's partition is one of its history's


def _bigram_asks(word_parts: int, parts: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row, word_parts, row["known"])
                out: list[tuple] = []
                for p, (pairs, asked) in c.dealt(parts, hot).items():
                    names = c.names[asked]
                    followers = np.bincount(np.searchsorted(names, c.h[pairs]), minlength=len(names))
                    out.append((p, row["chunk"], squeeze(np.diff(names, prepend=0)), squeeze(followers), squeeze(c.w[pairs]), squeeze(c.trained[pairs]), squeeze(c.wc[pairs])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], (pa.int32(), pa.int64(), *[pa.binary()] * 5)[i]) for i in range(7)], names=["part", "chunk", "names", "followers", "w", "trained", "wc"])

    return run


def _answer_bigrams(unigrams: Unigrams):
    def run(group: pa.Table) -> pa.Table:
        names = [np.cumsum(expand(x.as_py())) for x in group.column("names")]
        h = np.concatenate([np.repeat(n, expand(f.as_py())) for n, f in zip(names, group.column("followers"), strict=True)])
        w, trained, wc = (np.concatenate([expand(x.as_py()) for x in group.column(k)]).astype(np.int64) for k in ("w", "trained", "wc"))
        order = np.lexsort((w, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (w[order[1:]] != w[order[:-1]])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        lead = order[new]
        count = np.rint(np.bincount(pair, trained, len(lead))).astype(np.int64)
        # by history: bigrams seen once to DISCOUNTED times, and the unigram mass of all seen ones
        every, of = np.unique(np.concatenate([*names, h[lead]]), return_inverse=True)
        of = of[len(of) - len(lead) :]
        once = np.stack([np.bincount(of, count == r, len(every)) for r in range(1, DISCOUNTED + 1)]).astype(np.int64)
        mass = np.bincount(of, np.where(count > 0, unigrams.probability(wc[lead]), 0.0), len(every))
        edge = np.cumsum([0, *(int(expand(f.as_py()).sum()) for f in group.column("followers"))])
        a = [squeeze(count[pair[x:y]]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        b = []
        for n in names:
            at = np.searchsorted(every, n)
            packed = [squeeze(x[at]) for x in once] + [squeeze(mass[at])]
            b.append(struct.pack(f"<{len(packed)}q", *map(len, packed)) + b"".join(packed))
        stats = [int(count.sum()), int((count > 0).sum()), *(int((count == r).sum()) for r in range(1, DISCOUNTED + 2))]
        return _reply(group.column("chunk").to_pylist(), group.column("part").to_pylist(), a, b, stats)

    return run


def _evaluate(word_parts: int, parts: int, hot: int, unigrams: Unigrams, d: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row, word_parts, row["known"])
                dealt = c.dealt(parts, hot)
                count = np.zeros(len(c.h), np.int64)
                once, mass = np.zeros((DISCOUNTED, len(c.names))), np.zeros(len(c.names))
                for r in sorted(row["answers"] or [], key=lambda r: r["part"]):
                    pairs, at = dealt[r["part"]]
                    count[pairs] = expand(r["a"])
                    size = struct.unpack_from(f"<{DISCOUNTED + 1}q", r["b"])
                    start = 8 * len(size)
                    for i, n in enumerate(size):
                        values = expand(r["b"][start : start + n])
                        np.add.at(once[i] if i < DISCOUNTED else mass, at, values)
                        start += n
                freed = ((1 - d[1:])[:, None] * np.arange(1, DISCOUNTED + 1)[:, None] * once).sum(0)
                total = np.where(freed > 0, c.name_count, c.name_count + 1)
                alpha = (total - c.name_count + freed) / total / np.maximum(1 - mass, 1e-300)
                name = np.searchsorted(c.names, c.history)
                name = np.where(c.history_known, np.minimum(name, max(0, len(c.names) - 1)), 0)
                seen = np.zeros(len(c.word), np.int64)
                seen[c.pair >= 0] = count[c.pair[c.pair >= 0]]
                lower = unigrams.probability(c.count)
                weight, denominator = (alpha[name], total[name]) if len(c.names) else (1.0, 1.0)
                with np.errstate(divide="ignore"):
                    backed = np.log10(lower) + np.where(c.history_known, np.log10(weight), 0.0)
                    direct = np.log10(np.where(seen <= DISCOUNTED, d[np.minimum(seen, DISCOUNTED)], 1.0) * np.maximum(seen, 1) / denominator)
                n = len(c.ids)
                score = np.bincount(c.doc, np.where(seen > 0, direct, backed), n)
                base = np.bincount(c.doc, np.log10((c.count + 1) / (unigrams.tokens + unigrams.words + 1)), n)
                known = np.bincount(c.doc, c.count > 0, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array(c.held), pa.array(np.bincount(c.doc, minlength=n)), pa.array(known), pa.array(np.full(n, unigrams.tokens)), pa.array(base), pa.array(score)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _figures(replies: DataFrame) -> list[int]:
    """Sums over the partitions' own rows."""
    n = 2 + DISCOUNTED + 1
    row = replies.where("chunk is null").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [int(x or 0) for x in row]


def _gathered(replies: DataFrame, name: str) -> DataFrame:
    """A chunk's answers in one row; together they are as long as what the chunk asked."""
    return replies.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "a", "b")).alias(name))


def score_documents(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Words are runs of non-white space, A-Z lower-cased, then one end, which counts as a token. The model learns from the rows
    where held_out is not true. A null or empty text is just its end. Without any training text every token is unknown with
    probability 1. Repeated rows are learnt and scored each; null ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    workers_import(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_column).alias("text"))
    made = rows.mapInArrow(lean(_chunks), "chunk long, ids array<long>, held array<boolean>, sizes binary, hashes binary, trained binary, codes binary, tokens long")
    # bucketed by chunk, so that the joins with answers move only the answers
    name = f"chunks_{uuid.uuid4().hex}"
    made.write.bucketBy(shuffle_partitions(spark), "chunk").format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder, and chunks reads them; the catalog keeps nothing
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-tokens // PARTITION_TOKENS))
    hot = PARTITION_TOKENS // 4

    asks = chunks.select("chunk", "hashes", "trained").mapInArrow(lean(_vocabulary_asks(parts)), "part int, chunk long, hashes binary, trained binary")
    words = stored(asks.groupBy("part").applyInArrow(_answer_vocabulary(parts), _REPLY))
    trained, distinct, *occurring = _figures(words)
    unigrams = Unigrams(trained, distinct, occurring)

    known = chunks.join(_gathered(words, "known"), "chunk")
    asks = known.mapInArrow(lean(_bigram_asks(parts, parts, hot)), "part int, chunk long, names binary, followers binary, w binary, trained binary, wc binary")
    bigrams = stored(asks.groupBy("part").applyInArrow(_answer_bigrams(unigrams), _REPLY))
    d = discounts(_figures(bigrams)[2:])

    known = known.join(_gathered(bigrams, "answers"), "chunk", "left")
    out = known.mapInArrow(lean(_evaluate(parts, parts, hot, unigrams, d)), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_column)
