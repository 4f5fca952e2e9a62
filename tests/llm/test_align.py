"""Alignment of two tokenizers against the libraries on whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import align, registry
from tests.llm.fixtures import frame, no_rows, rows

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, docs):
    """Rows as of the operator, by whole texts and all pairs of tokens."""
    t, s = libraries
    letters = align.byte_alphabet()
    made = []
    for doc, text in docs:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        spell_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        spell_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            made.append((doc, 0, 0, [], []))
            continue
        ends = []
        for spelled in (spell_a, spell_b):
            ends.append([sum(map(len, spelled[: k + 1])) for k in range(len(spelled))] if len(spelled) < 400 else list(accumulate(map(len, spelled))))
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for end in common:
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            for x in range(i, k):
                for y in range(j, m):
                    if max(ends[0][x] - len(spell_a[x]), ends[1][y] - len(spell_b[y])) < min(ends[0][x], ends[1][y]):
                        links.append((a[x], b[y]))
            i, j = k, m
        made.append((doc, len(a), len(b), groups, links))
    count = Counter(link for *_, links in made for link in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (doc, n_a, n_b, len(g), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
        for doc, n_a, n_b, g, links in made
    ]


def groups_of(libraries, text):
    """Of a text without awkward characters, by comparing all ends."""
    a, b = libraries[0].encode(" " + text), libraries[1].encode(text)
    ends_b = list(accumulate(len(libraries[1].id_to_piece(i)) for i in b))
    out, i, j = [], 0, 0
    for k, (_, end) in enumerate(a.offsets):
        if end in ends_b:
            m = ends_b.index(end)
            out.append(f"{','.join(map(str, a.ids[i : k + 1]))}|{','.join(map(str, b[j : m + 1]))}")
            i, j = k + 1, m + 1
    return ";".join(out)


PARTS = ["a", "é", "漢字", "don't", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "’", "\x00", "<s>", "<|endoftext|>", "<0x41>", "▁", "😀", "the", "Straße", "123", "!!", "\x85", "ing", "\x1c", "});\r"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_units_give_what_the_libraries_give_for_the_whole_text(text):
    aligner = align._aligner((A, B))
    [(_, data, start, end, first)] = list(align.units(pa.array([text, "x"]), True))
    pieces = [data.tobytes()[x:y].decode() for x, y in zip(start[first[0] : first[1]], end[first[0] : first[1]], strict=True)]
    assert "".join(pieces) == (" " + text if text else "")
    assert [i for ids in aligner.a.encode(pieces) for i in ids] == (aligner.a.encode([" " + text])[0] if text else [])
    assert [i for ids in aligner.b.encode(pieces) for i in ids] == aligner.b.model.encode(text)


def nasty():
    data = rows()
    return [*data, *((700 + k, t, *data[0][2:]) for k, t in enumerate(["<s> </s> <|endoftext|>", "under▁score", "a  b　 c", " lead  and trail ", "\n\n", "\x00", "x" * 3000])), (None, "the end", *data[0][2:]), data[0]]


def test_alignment(spark, libraries):
    data = nasty()
    got = align.alignment(frame(spark, data), A, B).collect()
    expected = plain(libraries, [r[:2] for r in data])
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert any(r.n_best < r.n_links for r in got) and any(r.n_groups < min(r.n_a, r.n_b) for r in got)
    texts = {r.doc_id: r.groups for r in align.token_groups(frame(spark, data), A, B).collect()}
    assert all((hashlib.sha256(texts[r.doc_id].encode()).hexdigest() if r.n_a else "") == r.groups_sha256 for r in got)
    assert align.alignment(no_rows(spark), A, B).count() == 0


def test_a_full_table_starts_anew(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "MOST_UNITS", 40)
    aligner = align.Aligner(A, B)
    texts = [f"word{k} and more{k % 7}" for k in range(60)]
    for text in texts:
        for _, data, start, end, _ in align.units(pa.array([text]), True):
            found = aligner.numbers(data, start, end)
            assert b";".join(aligner.texts[k] for k in found).decode() == groups_of(libraries, text)
    assert len(aligner.texts) < 60


def test_op11(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in registry.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = registry.op11_align(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plain(libraries, docs))
