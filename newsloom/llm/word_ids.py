"""Whole texts to token ids with the tokenizers library, one call for each distinct word.

The vocabulary's rules (white space dropped, then pieces by a pattern that never crosses white space) make the encoding of a
text the row of its words' encodings. So a worker encodes each distinct word once and strings the ids together; the result is
what the library gives for the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from newsloom.llm.runtime import worker_tables
from newsloom.llm.textbytes import SPACE_WORDS, Words, word_runs

#: Words a worker remembers. A full table forgets the words that came in one run only since it was full last.
MOST_WORDS = 1_500_000


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._reset()

    def _reset(self) -> None:
        # about 30 bytes a word: sorted hashes with the words' numbers; the ids of word k are ids[start[k]:start[k + 1]]
        self.hashes, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.start = np.zeros(1 << 19, np.uint32), np.zeros(1 << 17, np.int64)
        self.again = np.zeros(0, bool)  # by number: came in a later run too

    def _forget(self) -> None:
        """Keeps the words that came again, if they are at most half of the table."""
        keep = np.flatnonzero(self.again[self.number])
        if len(keep) > MOST_WORDS // 2:
            keep = keep[:0]
        hashes, number = self.hashes[keep], self.number[keep]
        begin, size = self.start[number], self.start[number + 1] - self.start[number]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
        self._reset()
        self.hashes, self.number = hashes, np.arange(len(hashes), dtype=np.int32)
        self.ids = np.concatenate([ids, self.ids])
        self.start = np.concatenate([[0], end, self.start])

    def _learn(self, words: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, used = len(self.hashes), int(self.start[len(self.hashes)])
        total = int(sizes.sum())
        while used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[used : used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        self.start[n + 1 : n + 1 + len(words)] = used + np.cumsum(sizes)

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): document d of the run has ids[first[d]:first[d + 1]]."""
        hashes, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > MOST_WORDS:
            self._forget()
        while len(self.again) < len(self.hashes) + len(hashes):
            self.again = np.concatenate([self.again, np.zeros(max(1 << 17, len(hashes)), bool)])
        at = np.searchsorted(self.hashes, hashes)
        inside = at < len(self.hashes)
        number = np.full(len(hashes), -1)
        same = self.hashes[at[inside]] == hashes[inside]
        number[inside] = np.where(same, self.number[at[inside]], -1)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            data, here = words.data.tobytes(), where[new]
            self._learn([data[a:b].decode() for a, b in zip(words.start[here].tolist(), words.end[here].tolist(), strict=True)])
            number[new] = np.arange(len(self.hashes), len(self.hashes) + len(new))
            self.hashes, self.number = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.number, at[new], number[new].astype(np.int32))
        begin, size = self.start[number], self.start[number + 1] - self.start[number]
        size_each = size[back]
        end = np.cumsum(size_each)
        index = np.repeat(begin[back] - (end - size_each), size_each) + np.arange(int(end[-1]) if len(end) else 0)
        return self.ids[index], np.concatenate([[0], end])[words.first]


_ENCODERS: dict[str, WordEncoder] = worker_tables("words")


def encoded_runs(column: pa.Array, path: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, ids, first) for runs of a string column's rows; null counts as the empty text. The worker's encoder is kept for tasks
    that are run by lean(..., "words")."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    for words in word_runs(column, SPACE_WORDS, lower=False):
        yield words.rows, *_ENCODERS[path].encode(words)
