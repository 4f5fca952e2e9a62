"""Alignment of two tokenizers' tokens over the same bytes, and how common each link between their tokens is.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Cumulative byte ends of
A's and of B's tokens are the keys of two dictionaries (end to index); the keys in both, as sets, are where both cut, and in their
order they slice both id lists into groups. Links are the pairs of overlapping tokens, expanded within each slice. Many units (below)
stand in a row when they are sliced, as they do in a text.

No rule of either tokenizer crosses a space or line feed that follows other text, so both cut there, and a text's tokens and groups
are the row of its units' ones. A worker aligns each distinct unit once and remembers it; a text without such places is one unit.

How many documents hold a link is counted over the corpus: texts become chunks with their distinct links, and each chunk's links, with
the number of its documents that hold each, are summed by link. Chunks then ask for their links' counts by a join on the link (a
chunk has a row for each distinct link at most), so nothing is as large as the corpus has link occurrences, and no row is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import secrets
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.katz_lm import expand, squeeze
from newsloom.llm.runtime import lean, stored, worker_tables, workers_import
from newsloom.llm.textbytes import string_buffers, word_hashes

#: Text bytes of a chunk; units and bytes of their groups that a worker remembers before it starts anew.
CHUNK_BYTES, MOST_UNITS, MOST_BYTES = 4 << 20, 300_000, 32 << 20
#: Bytes of units that are encoded together; units that are learnt together.
PIECE_BYTES, LEARNT = 2048, 1 << 15


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the rest from 256 on, in their order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: the tokenizers library's byte-level BPE. Special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_alphabet()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(letters[c] for c in token)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class Pieces:
    """B: a sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model, n = self.model, self.model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = model.piece_to_id("▁")
        #: No piece has a space after something else, or a line feed: a text may be cut before these.
        self.cuts = not any(not model.is_byte(i) and ("\n" in p or "▁" in p.lstrip("▁")) for i, p in enumerate(pieces))

    def encode(self, units: list[str]) -> list[list[int]]:
        """Units begin with a space, which the model puts there itself, or with a line feed, where the model's own space goes."""
        found = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids if u[0] != " " and ids[:1] != [self.space] else ids[1:] if u[0] != " " else ids or [self.space] for u, ids in zip(units, found, strict=True)]


def sliced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, of_a, of_b): the ends that two rows of cumulative ends have in common, in order, and how many tokens of each end there
    or before. Both rows end at the same byte."""
    in_a, in_b = (dict(zip(x.tolist(), range(1, len(x) + 1), strict=True)) for x in (a, b))
    common = sorted(in_a.keys() & in_b.keys())
    return np.array(common, np.int64), *(np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (in_a, in_b))


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (of A, of B) of the overlapping tokens of all slices. Inside a slice no ends meet, so its links are one fewer than its
    tokens: from the first pair on, the one of the two that ends first gives way to its next one."""
    first_a, first_b = np.append(0, of_a[:-1]), np.append(0, of_b[:-1])
    size = (of_a - first_a) + (of_b - first_b) - 1
    edge = np.cumsum(size) - size
    # the inner ends of a slice in their order: each moves its own side on
    inner_a, inner_b = np.ones(len(a), bool), np.ones(len(b), bool)
    inner_a[of_a - 1] = inner_b[of_b - 1] = False
    ends = np.concatenate([a[inner_a], b[inner_b]])
    moves_a = np.argsort(ends, kind="stable") < int(inner_a.sum())
    total = int(size.sum())
    start = np.zeros(total, bool)
    start[edge] = True
    step_a = np.zeros(total, np.int64)
    step_b = np.zeros(total, np.int64)
    step_a[~start], step_b[~start] = moves_a, ~moves_a
    step_a[edge[1:]] = step_b[edge[1:]] = 1
    return np.cumsum(step_a), np.cumsum(step_b)


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, left-aligned in as many columns as the longest has, and how many there are."""
    text = [str(i).encode() for i in range(n)]
    width = len(text[-1])
    return np.frombuffer(b"".join(x.ljust(width) for x in text), np.uint8).reshape(n, width), np.array([len(x) for x in text])


class Aligner:
    """Both tokenizers, and the units that a worker has aligned: numbers, groups as text, and links as numbers a * B's size + b."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.width = len(self.b.bytes)
        self.sizes = [np.array([len(x) for x in side.bytes]) for side in (self.a, self.b)]
        self.digits, self.wide = digits(max(len(self.a.bytes), self.width))
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.figures = np.zeros((0, 4), np.int64)  # tokens of A and B (both 0: bytes differ), groups, where the unit's links end
        self.links, self.texts, self.text_bytes = np.zeros(0, np.int64), [], 0
        self.again = np.zeros(0, bool)  # by number: came in a later chunk too

    def _forget(self) -> None:
        """Keeps the units that came again, if they are at most half of the table."""
        keep = np.flatnonzero(self.again[self.number])
        hashes, number = self.hashes[keep], self.number[keep]
        figures, links, texts = self.figures, self.links, self.texts
        self._reset()
        if len(keep) > MOST_UNITS // 2:
            return
        size = (figures[:, 3] - np.append(0, figures[:-1, 3]))[number]
        end = np.cumsum(size)
        self.links = links[np.repeat(figures[number, 3] - end, size) + np.arange(int(end[-1]) if len(end) else 0)]
        self.figures = figures[number]
        self.figures[:, 3] = end
        self.texts = [texts[k] for k in number.tolist()]
        self.text_bytes = sum(map(len, self.texts))
        self.hashes, self.number, self.again = hashes, np.arange(len(hashes)), np.zeros(len(hashes), bool)
        if self.text_bytes > MOST_BYTES // 2:
            self._reset()

    def _encoded(self, pieces: list[bytes]) -> list[tuple[list[int], list[int]] | None]:
        """(A's ids, B's ids) of each piece, None where the bytes of either differ."""
        texts = [x.decode() for x in pieces]
        out = []
        for piece, a, b in zip(pieces, self.a.encode(texts), self.b.encode(texts), strict=True):
            fits = b"".join(map(self.a.bytes.__getitem__, a)) == piece == b"".join(map(self.b.bytes.__getitem__, b))
            out.append((a, b) if fits else None)
        return out

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Adds units that are not in the table. Several are encoded as one piece, where a text with them in a row would be cut."""
        size = end - start
        edge = np.append(0, np.cumsum(size))
        joined = data[np.repeat(start - edge[:-1], size) + np.arange(int(edge[-1]))]
        closed = _after_text(np.concatenate([np.full(2, 32, np.uint8), joined]), edge[1:] + 2)
        opens = (joined[edge[:-1]] == 32) | (joined[edge[:-1]] == 10)
        fresh = np.append(True, ~closed[:-1] | ~opens[1:] | (edge[1:-1] // PIECE_BYTES != edge[:-2] // PIECE_BYTES))
        first = np.flatnonzero(fresh)
        spans = list(zip(first.tolist(), np.append(first[1:], len(size)).tolist(), strict=True))
        text, good, bad = joined.tobytes(), [], []
        while spans:
            found = self._encoded([text[edge[i] : edge[j]] for i, j in spans])
            good += [(i, j, *ids) for (i, j), ids in zip(spans, found, strict=True) if ids is not None]
            again = [s for s, ids in zip(spans, found, strict=True) if ids is None]
            bad += [i for i, j in again if j - i == 1]
            spans = [(k, k + 1) for i, j in again if j - i > 1 for k in range(i, j)]
        figures, links, texts = np.zeros((len(size), 4), np.int64), np.zeros(0, np.int64), [b""] * len(size)
        if good:
            good.sort()
            order = np.concatenate([np.arange(i, j) for i, j, _, _ in good])
            figures[order, :3], n_links, links, made = self._figures(size[order], *(np.fromiter(chain.from_iterable(g[k] for g in good), np.int64) for k in (2, 3)))
            figures[order, 3] = n_links
            for k, x in zip(order.tolist(), made, strict=True):
                texts[k] = x
        figures[:, 3] = len(self.links) + np.cumsum(figures[:, 3])
        self.figures = np.concatenate([self.figures, figures])
        self.links = np.concatenate([self.links, links])
        self.texts += texts
        self.text_bytes += sum(map(len, texts))

    def _figures(self, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of units of these sizes in a row: tokens of A, of B and groups, the number of links, the links, the groups as text."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        common, of_a, of_b = sliced(ends_a, ends_b)
        at_a, at_b = linked(ends_a, ends_b, of_a, of_b)
        links = a[at_a] * self.width + b[at_b]
        last = np.searchsorted(common, np.cumsum(size)) + 1  # groups up to each unit's end, which both have
        upto = np.stack([of_a[last - 1], of_b[last - 1], last], 1)
        figures = np.diff(upto, axis=0, prepend=0)
        # the groups as text: A's tokens of a group, B's tokens of it, each with the sign that follows
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        place_a = np.arange(len(a)) + np.append(0, of_b)[group_a]
        place_b = np.arange(len(b)) + of_a[group_b]
        token, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        token[place_a], token[place_b] = a, b
        sign[place_a[of_a - 1]], sign[place_b[of_b - 1]] = ord("|"), ord(";")
        wide = self.wide[token]
        cells = np.concatenate([self.digits[token], sign[:, None]], 1)
        column = np.arange(cells.shape[1])
        written = (column < wide[:, None]) | (column == cells.shape[1] - 1)
        text = cells[written].tobytes()
        edge = np.append(0, np.append(0, np.cumsum(wide + 1))[upto[:, 0] + upto[:, 1]]).tolist()
        return figures, figures[:, 0] + figures[:, 1] - figures[:, 2], links, [text[x : y - 1] for x, y in zip(edge[:-1], edge[1:], strict=True)]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit data[start:end] in this table."""
        hashes, where, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) and (len(self.hashes) + len(hashes) > MOST_UNITS or self.text_bytes > MOST_BYTES):
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        number = np.full(len(hashes), -1)
        inside = at < len(self.hashes)
        number[inside] = np.where(self.hashes[at[inside]] == hashes[inside], self.number[at[inside]], -1)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            number[new] = np.arange(len(self.texts), len(self.texts) + len(new))
            for k in range(0, len(new), LEARNT):
                some = where[new[k : k + LEARNT]]
                self._learn(data, start[some], end[some])
            self.hashes, self.number = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.number, at[new], number[new])
            self.again = np.append(self.again, np.zeros(len(new), bool))
        return number[back]


def _after_text(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether other than white space stands before each of these places (at least three bytes on)."""
    three, two, one = data[at - 3], data[at - 2], data[at - 1]
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    wide |= (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one >= 0xA8))) | (two == 0x81))  # white space beyond ASCII, and some more
    return (one > 32) & ~wide


def units(column: pa.Array, cuts: bool, run_bytes: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, data, start, end, first): texts with a space before each, cut before a space or line feed that follows other than white
    space; row r has the units from first[r] to first[r + 1], an empty or null text none."""
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, "right")) - 1))
        size = np.diff(offsets[i : j + 1])
        some = (size > 0).astype(np.int64)
        edge = np.append(0, np.cumsum(size + some))
        out = np.full(int(edge[-1]) + 3, 32, np.uint8)  # three more in front, to look back
        lead = np.zeros(len(out), bool)
        lead[:3] = True
        lead[3 + edge[:-1][some > 0]] = True
        out[~lead] = data[offsets[i] : offsets[j]]
        cut = lead[3:].copy()
        if cuts:
            at = np.flatnonzero((out[3:] == 32) | (out[3:] == 10)) + 3
            cut[at[_after_text(out, at)] - 3] = True
        start = np.flatnonzero(cut)
        yield slice(i, j), out[3:], start, np.append(start[1:], len(cut)), np.searchsorted(start, edge)
        i = j


_ALIGNERS: dict[tuple[str, str], Aligner] = worker_tables("alignment")


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _aligned(column: pa.Array, paths: tuple[str, str]) -> Iterator[tuple[slice, Aligner, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, aligner, number, first, fits): the units' numbers, and whether a row has tokens of the right bytes."""
    aligner = _aligner(paths)
    for rows, data, start, end, first in units(column, aligner.b.cuts):
        number = aligner.numbers(data, start, end) if len(start) else np.zeros(0, np.int64)
        bad = np.append(0, np.cumsum(aligner.figures[number, 0] == 0))
        yield rows, aligner, number, first, (np.diff(first) > 0) & (bad[first[1:]] == bad[first[:-1]])


def _group_texts(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, aligner, number, first, fits in _aligned(batch.column(1), paths):
                number, edge = number.tolist(), first.tolist()
                made = [b";".join([aligner.texts[k] for k in number[a:b]]).decode() if ok else "" for a, b, ok in zip(edge[:-1], edge[1:], fits.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(fits)), pa.array(made, pa.string())], names=["id", "groups"])

    return run


_CHUNK = "chunk long, ids array<long>, figures array<array<long>>, digests array<string>, links binary, docs binary, codes binary, times binary, sizes binary"


def _chunks(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, aligner, number, first, fits in _aligned(batch.column(1), paths):
                n = len(fits)
                digests, listed, edge = [], number.tolist(), first.tolist()
                for a, b, ok in zip(edge[:-1], edge[1:], fits.tolist(), strict=True):
                    digests.append(hashlib.sha256(b";".join([aligner.texts[k] for k in listed[a:b]])).hexdigest() if ok else "")
                links_end = aligner.figures[:, 3]
                links_start = np.append(0, links_end[:-1])
                of = np.repeat(np.arange(n), np.diff(first))
                whole = fits[of]
                number, of = number[whole], of[whole]
                size = links_end[number] - links_start[number]
                each = np.stack([np.bincount(of, x, n).astype(np.int64) for x in (*aligner.figures[number, :3].T, size)]) if len(number) else np.zeros((4, n), np.int64)
                edges = np.append(0, np.cumsum(size))
                held = aligner.links[np.repeat(links_start[number] - edges[:-1], size) + np.arange(int(edges[-1]))]
                links, code = np.unique(held, return_inverse=True)
                own, times = np.unique(np.repeat(of, size) * np.int64(len(links)) + code, return_counts=True)
                docs_of, code = np.divmod(own, max(1, len(links)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([secrets.randbits(62)], pa.int64()), pa.array([batch.column(0).slice(rows.start, n).to_pylist()], pa.list_(pa.int64())), pa.array([each.tolist()], pa.list_(pa.list_(pa.int64()))), pa.array([digests], pa.list_(pa.string())),
                        *(pa.array([squeeze(x)], pa.binary()) for x in (np.diff(links, prepend=0), np.bincount(code, minlength=len(links)), code, times, np.bincount(docs_of, minlength=n))),
                    ],
                    names=["chunk", "ids", "figures", "digests", "links", "docs", "codes", "times", "sizes"],
                )

    return run


def _each_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, links, docs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            links, docs = np.cumsum(expand(links.as_py()).astype(np.int64)), expand(docs.as_py()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links), pa.array(np.full(len(links), chunk)), pa.array(np.arange(len(links), dtype=np.int32)), pa.array(docs)], names=["link", "chunk", "place", "docs"])


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ids", "figures", "digests", "codes", "times", "sizes", "answers"]
    for batch in batches:
        for k in range(batch.num_rows):
            ids, figures, digests, codes, times, sizes = (batch.column(i)[k] for i in range(6))
            answers = batch.column(names.index("answers"))[k]
            n = len(ids)
            codes, times = (expand(x.as_py()).astype(np.int64) for x in (codes, times))
            docs, best = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64), np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
            if len(codes):
                place, count, top = answers.values.flatten()
                at = place.to_numpy()
                docs[at], best[at] = count.to_numpy(), top.to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(n), expand(sizes.as_py()).astype(np.int64))
            found = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            for out, x in zip(found, (best, docs), strict=True):
                np.add.at(out, of, times * x[codes])
            columns = [ids.values, *(x.values for x in figures.values), pa.array(found[0]), pa.array(found[1]), digests.values]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    workers_import(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and groups of every row: a1,a2|b1;a3|b2,b3 (decimal ids of A and B in their order; empty without tokens)."""
    return _rows(docs, id_column, text_column).mapInArrow(lean(_group_texts((path_a, path_b)), "alignment"), "id long, groups string").withColumnRenamed("id", id_column)


def link_counts(chunks: DataFrame, width: int) -> DataFrame:
    """link, a, docs and best: how many documents hold each link, and whether none of the same token of A is in more."""
    each = chunks.select("chunk", "links", "docs").mapInArrow(lean(_each_link), "link long, chunk long, place int, docs long")
    counted = stored(each.groupBy("link").agg(F.sum("docs").alias("docs")).withColumn("a", F.floor(F.col("link") / width)))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("link", "a", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_a, n_b (tokens), n_groups, n_links, n_best (links of the count that is their A token's highest
    in the corpus), count_sum (over links), groups_sha256 (of the text that token_groups gives; empty without tokens).

    A link's count is the number of rows of docs that hold it, so a repeated row counts again. Null and empty texts, and texts of
    which either tokenizer's bytes differ (the piece model reads U+2581 as a space), have no tokens. Rows with a null id are kept;
    texts of any length are read whole. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    paths = (path_a, path_b)
    chunks = stored(_rows(docs, id_column, text_column).mapInArrow(lean(_chunks(paths), "alignment"), _CHUNK))
    counted = link_counts(chunks, Pieces(path_b).model.get_piece_size())
    each = chunks.select("chunk", "links", "docs").mapInArrow(lean(_each_link), "link long, chunk long, place int, docs long").drop("docs")
    answers = each.join(counted, "link").groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("docs").alias("count"), "best")).alias("answers"))
    known = chunks.join(answers, "chunk", "left").select("ids", "figures", "digests", "codes", "times", "sizes", "answers")
    return known.mapInArrow(lean(_with_counts), "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("id", id_column)
