"""Byte-level BPE as a lazily determinised transducer, and streaming decoding with an incremental UTF-8 machine."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import lean, worker_tables, workers_import

#: Bounds of a worker's tables. With the moves full, new ones are made and not kept; the other two are emptied and filled anew.
MOST_MOVES, MOST_PIECES, MOST_PAIRS = 350_000, 600_000, 400_000
#: Longer pieces are not remembered: they hardly come again.
REMEMBERED = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: The token emitted last (-1: none, -2: no guess stands right after it), and the guesses (node, tokens), that at the root last.
State = tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]


class Transducer:
    """Reads the bytes of a piece and emits its BPE tokens as soon as no continuation can change them.

    BPE has this property: a row of tokens is the encoding of their bytes exactly if each neighbouring pair is the encoding of
    its own bytes. So of all tokens that end at a place, one alone continues the encoding of the bytes before it.

    A nondeterministic reader would guess at every place that a token starts there, and walk down the trie of tokens. A state is
    the set of its guesses that are alive: each a trie node, and the tokens between the last emitted one and the guess. One of
    them stands at the root: the encoding of what has been read. A byte moves every guess down the trie and drops those that
    leave it; the one whose token ends here and fits gives the new guess at the root. Tokens with which all guesses begin are
    settled: the move emits them, and the state forgets them, so that different beginnings lead to one state. A guess lives at
    most as long as the longest token, which bounds the lookahead. States and moves are made when they are first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves = {token: self._parts(piece, token) for piece, token in ranks.items()}
        self.pairs: dict[int, bool] = {}
        # the trie: down[node * 256 + byte] is the next node, token[node] its token or -1, inner[node]: longer tokens begin so
        self.down: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for piece, token in ranks.items():
            node = 0
            for byte in piece:
                self.inner[node] = True
                to = self.down.get(node * 256 + byte)
                if to is None:
                    self.token.append(-1)
                    self.inner.append(False)
                    to = self.down[node * 256 + byte] = len(self.token) - 1
                node = to
            self.token[node] = token
        self.states: list[State] = [(-1, ((0, ()),))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte: (state, emitted tokens)

    def _parts(self, piece: bytes, limit: int = 1 << 60) -> list[int]:
        """Merges the neighbours of the lowest rank below limit, the leftmost first, until none can be."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, limit) for a, b in zip(parts, parts[1:])]  # noqa: B905
            least = min(ranks)
            if least >= limit:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a (for a = -1: whether merges reach b at all).

        The merges undone backwards: of the two tokens at the border the one that was merged last gives way to its half at the
        border; a pair whose own merge would have come earlier than that would have been merged, and the border would be gone.
        """
        key = a * 0x1000000 + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = len(self.halves[b]) < 3 if a < 0 else self._border(a, b)
        return known

    def _border(self, a: int, b: int) -> bool:
        halves, text = self.halves, self.bytes
        if len(halves[a]) > 2 or len(halves[b]) > 2:
            return False
        until = 1 << 60
        while True:
            if self.ranks.get(text[a] + text[b], 1 << 60) < until:
                return False
            left, right = len(halves[a]) == 2, len(halves[b]) == 2
            if right and (not left or b >= a):
                b, until = halves[b][0], b + 1  # of equal ranks the one on the left is merged first
            elif left:
                a, until = halves[a][1], a
            else:
                return True

    def _step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        before, guesses = state
        kept: list[tuple[int, tuple[int, ...]]] = []
        read = None
        for node, tokens in guesses:
            to = self.down.get(node * 256 + byte)
            if to is None:
                continue
            if read is None and self.token[to] >= 0:
                a, token = tokens[-1] if tokens else before, self.token[to]
                known = self.pairs.get(a * 0x1000000 + token)
                if known or known is None and self.fits(a, token):
                    read = (*tokens, token)
            if self.inner[to]:
                kept.append((to, tokens))
        if read is None:
            raise ValueError("the ranks lack a single byte")
        settled, stands = len(read), False
        for _, tokens in kept:
            settled = min(settled, len(tokens))
            while tokens[:settled] != read[:settled]:
                settled -= 1
            if not settled:
                break
        if settled:
            before = read[settled - 1]
            kept = [(node, tokens[settled:]) for node, tokens in kept]
        kept.append((0, read[settled:]))
        for _, tokens in kept:
            if not tokens:
                stands = True
                break
        return (before if stands else -2, tuple(kept)), read[:settled]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        key, emitted = self._step(self.states[state], byte)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state * 256 + byte] = (to, emitted)
        return move

    def emit(self, piece: bytes) -> Iterator[tuple[int, ...]]:
        """For every byte the tokens that it settles, and then those that the end settles."""
        state = self.states[0]
        for byte in piece:
            state, emitted = self._step(state, byte)
            yield emitted
        yield state[1][-1][1]

    def encode(self, piece: bytes) -> list[int]:
        """What emit() gives, along the moves that are known. New ones are kept while there is room."""
        at, moves, out = 0, self.moves, []
        for k, byte in enumerate(piece):
            move = moves.get(at * 256 + byte)
            if move is None:
                if len(moves) >= MOST_MOVES:
                    state = self.states[at]
                    for last in piece[k:]:
                        state, emitted = self._step(state, last)
                        out += emitted
                    out += state[1][-1][1]
                    return out
                move = self._move(at, byte)
            at = move[0]
            if move[1]:
                out += move[1]
        out += self.states[at][1][-1][1]
        return out


class Utf8Machine:
    """An incremental UTF-8 reader fed with byte strings; keeps the bytes of an unfinished character between calls."""

    #: For a first byte: bytes that follow, and the range of the first of them.
    LEAD = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]

    def __init__(self) -> None:
        self.table = {b: (n, lo, hi) for a, z, n, lo, hi in self.LEAD for b in range(a, z + 1)}
        self.reset()

    def reset(self) -> None:
        self.wanted, self.low, self.high, self.held, self.bad = 0, 0x80, 0xBF, b"", 0

    def feed(self, data: bytes) -> str:
        """The text that is complete by now; each ill-formed part reads as U+FFFD and counts in bad."""
        out = []
        for byte in data:
            if self.wanted:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.wanted -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.wanted:
                        out.append(self.held.decode())
                        self.held = b""
                    continue
                self.wanted, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
                self.bad += 1
                out.append("�")
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.table:
                self.wanted, self.low, self.high = self.table[byte]
                self.held = bytes((byte,))
            else:
                self.bad += 1
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        cut = self.wanted > 0
        bad = self.bad + cut
        self.reset()
        self.bad = bad
        return "�" * cut


class Codec:
    """Texts to ids and back. A piece runs through the transducer from its start state; what it emitted is remembered."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.machine = Transducer(ranks)
        self.bytes = self.machine.bytes
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}  # ids as int32 bytes
        self.partial = np.zeros(max(self.bytes) + 1, bool)
        self.partial[[i for i, b in self.bytes.items() if not _complete(b)]] = True
        self.utf8 = Utf8Machine()

    def encode(self, text: str) -> np.ndarray:
        pieces, known = self.find(text), self.pieces
        out = list(map(known.get, pieces))
        i, misses = -1, out.count(None)
        for _ in range(misses):
            i = out.index(None, i + 1)
            piece = pieces[i]
            ids = known.get(piece)
            if ids is None:
                ids = array("i", self.machine.encode(piece.encode())).tobytes()
                if len(piece) <= REMEMBERED:
                    if len(known) >= MOST_PIECES:
                        known.clear()
                    known[piece] = ids
            out[i] = ids
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """Runs of bytes that end at character borders, as the ids come; ill-formed parts become U+FFFD's bytes.

        Tokens that are whole characters are joined as they stand; the UTF-8 machine takes over at a token that cuts a
        character, and until its state is clear again.
        """
        text, at = self.bytes.__getitem__, 0
        for cut in [*np.flatnonzero(self.partial[ids]).tolist(), len(ids)]:
            if cut < at:
                continue
            if cut > at:
                yield b"".join(map(text, ids[at:cut].tolist()))
            at = cut
            while at < len(ids):
                done = self.utf8.feed(text(int(ids[at])))
                at += 1
                if done:
                    yield done.encode()
                if not self.utf8.wanted:
                    break
        tail = self.utf8.close()
        if tail:
            yield tail.encode()


def _complete(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


_CODECS: dict[tuple[str, str], Codec] = worker_tables("bpe")


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec; its tables outlive a task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, ids array<int>. Null counts as the empty text, which has no ids; any length is encoded whole."""
    workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = tool.encode(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["id", "ids"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lean(run, "bpe"), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes).

    The ids never leave the task that makes them, so nothing is shuffled. Null and empty texts have no tokens and the digests
    of nothing. Repeated rows are encoded each; an empty table gives no rows; other columns are not read.
    """
    workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        name = {i: str(i) for i in tool.bytes}.__getitem__
        for batch in batches:
            counts, names, decoded = [], [], []
            for text in batch.column(1):
                ids = tool.encode(text.as_py() or "")
                counts.append(len(ids))
                names.append(hashlib.sha256(" ".join(map(name, ids.tolist())).encode()).hexdigest())
                digest = hashlib.sha256()
                for part in tool.decode(ids):
                    digest.update(part)
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lean(run, "bpe"), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
