"""Large term lists: places and rewritten texts against a plain scan, by the automaton and by the join."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from newsloom.operators import dictionary as D
from newsloom.operators import gates
from newsloom.plans import dictionaries

SF = "/root/testdata/sf0.001"


def plain_places(text, terms):
    """Leftmost-longest by trying every size at every word."""
    w = [x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", text or "")]
    most, out, i = max((k.count(" ") + 1 for k in terms), default=0), [], 0
    while i < len(w):
        n = next((n for n in range(min(most, len(w) - i), 0, -1) if " ".join(w[i : i + n]) in terms), 0)
        if n:
            out.append((i, n, " ".join(w[i : i + n]), terms[" ".join(w[i : i + n])]))
        i += max(n, 1)
    return out


def plain_rewrite(text, terms):
    if text is None:
        return None
    spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    out, at = "", 0
    for start, n, _, value in plain_places(text, terms):
        out += text[at : spans[start][0]] + (value or "")
        at = spans[start + n - 1][1]
    return out + text[at:]


def made(seed=7, n_terms=10_000):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeşéж") for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    terms = {}
    while len(terms) < n_terms:
        terms.setdefault(" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 2, 3, 5)))), rng.choice(("x", "y", None)))
    marks = [" ", ", ", "\n", " - ", "'", "  "]
    texts = ["".join(rng.choice((str.upper, str.lower))(rng.choice(vocabulary)) + rng.choice(marks) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    some = list(terms)
    texts += [" ".join(rng.choice(some) for _ in range(30)) for _ in range(30)] + [None, "", " ,;", "-- " + some[0], some[1] + " " + some[1], "word " * 30_000 + some[2], some[3], some[3]]
    return terms, texts


@pytest.mark.parametrize("limits", [{}, {"most_chars": 10}])
def test_ten_thousand_terms(spark, limits):
    terms, texts = made()
    given = [(t.upper(), v) for t, v in terms.items()] + [("", "z"), (None, "z"), ("!!", "z")]
    table = spark.createDataFrame(given, "term string, value string")
    rows = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "id long, text string, value array<int>")
    got = {r.id: r for r in D.rewrite_terms(D.find_terms(rows, table, **limits), table, **limits).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        assert [tuple(f) for f in got[i].found] == plain_places(t, terms), i
        assert got[i].rewritten == plain_rewrite(t, terms) and got[i].value == [1]
    assert sum(len(r.found) for r in got.values()) > 1000


@pytest.mark.parametrize("limits", [{}, {"most_terms": 0}])
def test_ties_repeats_and_nothing(spark, limits):
    rows = spark.createDataFrame([(1, "A b c"), (1, "A b c"), (2, "b"), (None, "a B")], "id long, text string")
    terms = spark.createDataFrame([("a b", "2"), ("A, b", "10"), ("b", None), ("b c", "x")], "term string, value string")
    got = sorted(((r.id or 0), [tuple(f) for f in r.found]) for r in D.find_terms(rows, terms, **limits).collect())
    assert got == [(0, [(0, 2, "a b", "10")]), (1, [(0, 2, "a b", "10")]), (1, [(0, 2, "a b", "10")]), (2, [(0, 1, "b", None)])]
    assert D.find_terms(rows.limit(0), terms, **limits).count() == 0
    none = D.rewrite_terms(D.find_terms(rows, terms.limit(0), **limits), terms.limit(0), **limits).collect()
    assert all(r.found == [] and r.rewritten == r.text for r in none) and len(none) == 4


def test_lists_and_places_of_a_gazetteer(spark):
    rows = spark.createDataFrame([("Explosion near Old Harbour and Westerfield, 3 dead; Old Harbour shut",)], "text string")
    terms = spark.createDataFrame([("Old Harbour", "coast"), ("Westerfield", "hills"), ("harbour", "none")], "term string, value string")
    out = D.find_terms(rows, terms)
    r = out.select(D.counted_by_value(F.col("found")).alias("n"), gates.incident_signature(F.col("text"), [("blast", "explosion")], F.col("found"), F.array().cast("array<string>")).alias("s")).first()
    assert r.n == {"coast": 1, "hills": 1} and (r.s.kind, r.s.regions, r.s.places) == ("blast", ["coast", "hills"], ["old harbour", "westerfield"])


def test_rewritten_documents_replayed(spark):
    terms = {}
    for item, text in duckdb.sql(f"SELECT item_id::VARCHAR, text FROM '{SF}/benchmark.parquet'").fetchall():
        w = [x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", text or "")]
        for n in (2, 3):
            for i in range(len(w) - n + 1):
                terms[" ".join(w[i : i + n])] = min(f"[{item}]", terms.get(" ".join(w[i : i + n]), f"[{item}]"))
    want = {i: plain_rewrite(t, terms) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    got = {r.doc_id: (r.digest, r.chars) for r in dictionaries.dictionary_rewritten(spark, SF).collect()}
    assert got == {i: (t and hashlib.md5(t.encode()).hexdigest(), t and len(t)) if t is not None else (None, None) for i, t in want.items()}


def test_a_text_key_is_its_words_with_single_spaces(spark):
    texts = ["ΟΔΟΣ, ΑΣ. Σ", "İstanbul--İ 5٣", " ,;", "", None, "𝔘nd 😀 x́y", "ﬁn ß ẞ Ǆ", "A\tb\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(D._key(F.col("t")).alias("a"), F.array_join(D.words_of(F.col("t")), " ").alias("b")).collect())


def test_join_meets_only_likely_sequences(spark):
    """Of 60,000 word sequences those few reach the join that a term's bit lets through, and all real ones do."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(300)]
    terms = [t.split()[5] + " " + t.split()[6] for t in texts[:50]] + ["none at all"]
    table = spark.createDataFrame([(t, "v") for t in terms], "term string, value string")
    sizes, packed = D._filter_of(table)
    assert sizes == [2, 3] and 0 < int(np.unpackbits(packed).sum()) <= 51
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("term", pa.string())]))
    likely = D._likely(pa.array(texts), sizes, packed, kind).to_pylist()
    assert {x["term"] for row in likely for x in row} >= set(terms[:-1]) and sum(map(len, likely)) < 100
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = {r.id: [tuple(f) for f in r.found] for r in D.find_terms(rows, table, most_terms=0).collect()}
    assert found == {i: plain_places(t, dict.fromkeys(terms, "v")) for i, t in enumerate(texts)}


def test_places_are_listed_by_slices():
    """A worker holds the places of a slice of texts as Python objects, not those of a batch."""
    seen = []
    search = lambda part: (seen.append(len(part)), [[(0, 1, 0)]] * len(part))[1]
    out = D._in_slices(search, pa.array(["a"] * 1000), D._columns([("a", None)]))
    assert len(out) == 1000 and max(seen) <= D.SLICE and out[999].as_py() == [{"start": 0, "size": 1, "term": "a", "value": None}]
