"""Benchmark passages by fingerprints against a plain search."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from newsloom.llm import decontaminate
from newsloom.llm.textbytes import PLAIN_WORDS, word_runs
from tests.llm.fixtures import frame, low, no_rows, rows

ITEMS = "item_id long, text string, doc_id long, words int, start int, h1 long, hits string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain(docs, items):
    """{(id, text): (n_words, n_hit, item_ids)}"""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (items_of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_of
        out[doc, text or ""] = (len(w), len(hit), sorted(found))
    return out


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 5, 6, 7, 8, "h") for i, t in items], ITEMS)


def cases():
    data = rows()
    long = data[-3][1].split()
    texts = [data[k][1] for k in (0, 4, 9)]
    items = [(k, t) for k, t in enumerate(texts)] + [(3, texts[0].upper()), (3, "Al ça"), (4, " ".join(long[2000:2013])), (5, " ".join(long[100:109])), (100, " ".join(long[3000:3010]))]
    items += [(20, "one"), (21, "License CC"), (22, "漢字"), (23, None), (24, ""), (25, "!!"), (None, texts[1]), (26, "never seen here at all"), (27, texts[2]), (27, texts[2]), (28, "x x x x x x x x x x x x")]
    data += [(900, "lead " + texts[0] + " tail " + " ".join(long[2000:2012]), *data[0][2:]), (None, texts[1], *data[0][2:]), (None, "one", *data[0][2:])]
    return data, items


def check(spark, data, items):
    expected = plain([r[:2] for r in data], items)
    got = decontaminate.contamination(frame(spark, data), item_frame(spark, items)).collect()
    texts = {}
    for r in data:
        texts.setdefault(r[0], []).append(r[1] or "")
    assert len(got) == len(data)
    assert sorted(((r.doc_id or -1, r.n_words, r.n_hit, r.item_ids) for r in got)) == sorted((d or -1, *expected[d, t]) for d, ts in texts.items() for t in ts)
    return expected


def test_contamination(spark):
    expected = check(spark, *cases())
    assert sum(n > 0 for _, n, _ in expected.values()) > 10


def test_contamination_beyond_the_broadcast_bound_and_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "BITS", 7)
    check(spark, *cases())


def test_contamination_without_rows_or_items(spark):
    data, items = cases()
    assert decontaminate.contamination(no_rows(spark), item_frame(spark, items)).count() == 0
    check(spark, data, [])
    check(spark, data, [(1, None), (None, "one two")])


def test_a_passage_of_many_documents_and_items(spark):
    """A third of the documents hold one passage that many items have too; other items only share its first five words."""
    passage = [f"p{i}" for i in range(30)]
    data = [(k, " ".join([f"a{k}", f"b{k % 7}", *(passage if k % 3 == 0 else passage[:5]), f"c{k}"]), *rows()[0][2:]) for k in range(300)]
    items = [(k, " ".join([*passage[k % 15 : k % 15 + 15], f"i{k}"])) for k in range(40)] + [(100 + k, " ".join([*passage[:5], *(f"o{k}x{i}" for i in range(8))])) for k in range(40)]
    check(spark, data, items)


@pytest.mark.parametrize("n", range(12))
def test_spans_choose_the_rightmost_smallest_hash(n):
    [run] = word_runs(pa.array([" ".join("abcabcabcabc"[:n]), "z"]), PLAIN_WORDS)
    start, whole, chosen, place = decontaminate.spans(run, 10)
    grams = decontaminate.combine(run.hashes(), 5)
    assert start.tolist() == list(range(max(0, n - 9))) and len(whole) == len(start)
    for s, c, p in zip(start.tolist(), chosen.tolist(), place.tolist(), strict=True):
        assert c == min(grams[s : s + 6].tolist()) and p == max(i for i in range(s, s + 6) if grams[i] == c)
