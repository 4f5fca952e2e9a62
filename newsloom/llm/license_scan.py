"""License scans by template markup.

A template is wording with two kinds of markup: [[...]] may be left out, <<n>> stands for any 0 to n words, and <<a|b c>> for
one of the given wordings. It is compiled to a token automaton; a place in a text is accepted when all wording outside the
markup stands there exactly, word for word. Texts are read as words of letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import lean, workers_import
from newsloom.llm.textbytes import PLAIN_WORDS, text_hash, word_runs

#: Phrases whose every place counts, and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Templates and their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license [[,]] version 2.0 [[the license you may not use this file except in compliance with the license]]"),
    ("cc-by-4.0", "licensed under [[a|the]] <<cc by|a creative commons attribution|the creative commons attribution>> 4.0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] <<cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial>> 4.0 [[international]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] <<cc by sa|creative commons attribution sharealike|creative commons attribution share alike>> 4.0 [[international]] [[license]]"),
    ("gpl-2.0", "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation either]] version 2 [[of the license]] [[or at your option any later version]]"),
    ("gpl-3.0", "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation either]] version 3 [[of the license]] [[or at your option any later version]]"),
    ("mit", "<<released|licensed|distributed|available>> under the [[terms of the]] mit license"),
    ("copyright-notice", "copyright [[c]] <<6>> all rights reserved"),
]

# The published wordings. Names of holders are replaceable, list numbers may be left out.
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: [[1|a]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. [[2|b]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """[[3|c]] Neither the name of <<12>> nor the names of <<4>> contributors may be used to endorse or promote products derived from this
software without specific prior written permission. """
_BSD_DISCLAIMER = """This software is provided by <<12>> "as is" and any express or implied warranties, including, but not limited to, the implied
warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall <<12>> be liable for any direct, indirect,
incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of
use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
(including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_GPL_NOTICE = """This program is free software [[:]] you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation [[,]] either version {} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a
particular purpose. See the GNU General Public License for more details. [[You should have received a copy of the GNU General Public License
along with this program. If not, see https://www.gnu.org/licenses/]]"""

#: Whole texts of licences, and the notices that their authors ask for in full.
BODIES = [
    ("apache-2.0-text", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<http|https>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "as is" basis, without warranties or conditions of any kind, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd-2-clause-text", _BSD_TERMS + _BSD_DISCLAIMER),
    ("bsd-3-clause-text", _BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("gpl-2.0-text", _GPL_NOTICE.format(2)),
    ("gpl-3.0-text", _GPL_NOTICE.format(3)),
    ("isc-text", """Permission to use, copy, modify, <<and|and/or>> distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and <<12>> disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall <<12>> be liable for any
special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of
contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."""),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial
portions of the Software. The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall <<12>> be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in
the software."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied <<warranty|warranties>>. In no event will <<12>> be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. [[3]] This notice may not be removed or altered from any source distribution."""),
]

#: First sentences of licences: a text that goes on otherwise holds one of these alone, which is no accepted licence.
OPENINGS = [
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-opening", "permission to use copy modify <<and|and or>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
]


class Automaton:
    """Token automaton of one template: arcs[state] = [(word hash or None for any word, next state)]; state 0 starts, final ends."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[int | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]  # moves without a word
        self.final = self._wording(template, 0)
        starts = self.reach({0})
        self.first = {w for s in starts for w, _ in self.arcs[s]}
        assert None not in self.first and self.final not in starts, "a template begins with wording"
        self._steps: dict[tuple[frozenset[int], int], frozenset[int]] = {}
        self._start = frozenset(starts)

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _words(self, text: str, at: int) -> int:
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()):
            to = self._state()
            self.arcs[at].append((text_hash(word), to))
            at = to
        return at

    def _wording(self, text: str, at: int) -> int:
        for optional, replaceable, plain in re.findall(r"(?s)\[\[(.*?)\]\]|<<(.*?)>>|((?:(?!\[\[|<<).)+)", text):
            if plain:
                at = self._words(plain, at)
            elif replaceable.isdigit():
                states = [at]
                for _ in range(int(replaceable)):
                    states.append(self._state())
                    self.arcs[states[-2]].append((None, states[-1]))
                for s in states[:-1]:
                    self.free[s].append(states[-1])
                at = states[-1]
            else:
                end = self._state()
                for choice in (optional or replaceable).split("|"):
                    self.free[self._words(choice, at)].append(end)
                if optional:
                    self.free[at].append(end)
                at = end
        return at

    def reach(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accept(self, words: Iterable[int]) -> int:
        """Length of the longest accepted run from the first word, 0 if there is none."""
        states, best = self._start, 0
        for i, word in enumerate(words):
            key = (states, word)
            if key not in self._steps:
                if len(self._steps) > 10_000:
                    self._steps.clear()
                self._steps[key] = frozenset(self.reach({t for s in states for w, t in self.arcs[s] if w is None or w == word}))
            states = self._steps[key]
            if not states:
                break
            if self.final in states:
                best = i + 1
        return best


def _scan(phrases: list[tuple[str, str]], templates: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(kind, label, Automaton(t)) for kind, label, t in templates]
        wording = [(label, [np.uint64(text_hash(w)) for w in text.split()]) for text, label in phrases]
        starters = np.array(sorted({w for *_, m in machines for w in m.first}), np.uint64)
        longest = max((len(m.arcs) for *_, m in machines), default=0)
        for batch in batches:
            for words in word_runs(batch.column(1), PLAIN_WORDS):
                hashes, first = words.hashes(), words.first
                n = len(first) - 1
                found: list[list[tuple[str, str, int, int]]] = [[] for _ in range(n)]
                for label, phrase in wording:
                    at = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0])
                    for k, w in enumerate(phrase[1:], 1):
                        at = at[hashes[at + k] == w]
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + len(phrase) <= first[doc + 1]
                    for d, w in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                        found[d].append(("phrase", label, w - int(first[d]), w - int(first[d]) + len(phrase)))
                at = np.flatnonzero(np.isin(hashes, starters))
                doc = np.searchsorted(first, at, "right") - 1
                for d, w in zip(doc.tolist(), at.tolist(), strict=True):
                    ahead, here = hashes[w : min(w + longest, int(first[d + 1]))], int(hashes[w])
                    for kind, label, machine in machines:
                        if here in machine.first and (length := machine.accept(map(int, ahead))):  # most fail at the second word
                            found[d].append((kind, label, w - int(first[d]), w - int(first[d]) + length))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.rows.start, n), pa.array(words.count), pa.array([[dict(zip(("kind", "label", "start", "end"), x, strict=True)) for x in f] for f in found], _FOUND)],
                    names=["id", "n_words", "found"],
                )

    return run


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = [*TEMPLATES, *BODIES], openings: list[tuple[str, str]] = OPENINGS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_words, found array<struct<kind, label, start, end>> (places in words, end excluded).

    kind is 'phrase' (the words of a phrase stand consecutively; every place, overlapping ones too) or 'template' (an automaton
    accepts; the longest run from its start) or 'opening' (the same for the first sentence of a licence, whatever follows). Null and empty texts have 0 words and nothing found. Repeated rows and ids are
    scanned each on its own; an empty table gives no rows; other columns are not read. A text is scanned as a whole, whatever
    its length; matches never reach over two texts.
    """
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(_scan(phrases, [*(("template", *t) for t in templates), *(("opening", *t) for t in openings)])), f"id {kind}, n_words long, found array<struct<kind: string, label: string, start: long, end: long>>")
    return out.withColumnRenamed("id", id_column)
