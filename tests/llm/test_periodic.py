"""Periodic runs by block convolution against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import periodic, registry
from tests.llm.fixtures import frame, no_rows, rows


def plain_runs(w):
    """(start, end, period) of all maximal stretches of at least six words and four smallest periods."""
    out, n = {}, len(w)
    codes = np.unique(np.array(w), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
    return sorted((a, b, q) for (a, b), q in out.items())


def plain(doc_id, text, edited=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if edited and n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((a, b - a, q) for a, b, q in plain_runs(w)), key=lambda r: (r[0], r[2]))
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)),
        sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def found(codes, sizes=None):
    words = np.random.default_rng(3).integers(0, 1 << 64, max(codes, default=0) + 1, dtype=np.uint64)
    first = np.cumsum([0, *(sizes or [len(codes)])])
    r = periodic.find_runs(words[np.array(codes, int)], first)
    return list(zip(r.start.tolist(), r.end.tolist(), r.period.tolist(), strict=True))


def planted(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        q, s = rng.randint(1, max(1, n // 5)), rng.randrange(n)
        for i in range(s + q, min(n, s + rng.randint(3 * q, 6 * q))):
            w[i] = w[i - q]
    return w


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=60), min_size=1, max_size=4))
def test_runs_of_two_words(docs):
    expected, at = [], 0
    for d in docs:
        expected += [(at + a, at + b, q) for a, b, q in plain_runs(d)]
        at += len(d)
    assert sorted(found([x for d in docs for x in d], [len(d) for d in docs])) == sorted(expected)


@pytest.mark.parametrize("seed", range(12))
def test_planted_runs(seed):
    rng = random.Random(seed)
    w = planted(rng, rng.choice([40, 130, 700, 1500]), rng.choice([2, 3, 50, 1000]))
    assert sorted(found(w)) == plain_runs(w)


def test_words_of_fibonacci_and_of_one_kind():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert sorted(found(b)) == plain_runs(b)
    assert found([7] * 5) == [] and found([7] * 6) == [(0, 6, 1)] and found([7] * 300_000) == [(0, 300_000, 1)]


def test_long_periods_need_the_larger_prime():
    w = [i % 40_000 for i in range(170_000)]
    assert found([9, *w, 9]) == [(1, 170_001, 40_000)]


@pytest.mark.parametrize("half", [1, 2, 8, 64, 1 << 16])
def test_transforms_are_exact(half):
    t = periodic._transform(half)
    rng = np.random.default_rng(half)
    x, y = rng.integers(0, 1 << 16, (half, 2)), rng.integers(0, 1 << 16, (2 * half, 2))
    p = t.field.prime
    fx, fy = t.forward(x.astype(t.field.kind)), t.field.add(t.forward(y[:half].astype(t.field.kind)), 0 * t.forward(y[:half].astype(t.field.kind)))
    second = t.forward(y[half:].astype(t.field.kind))
    fy[:half] = t.field.add(fy[:half], second[:half])
    fy[half:] = t.field.sub(fy[half:], second[half:])
    got = t.correlation(fx, t.field.fold(fy))
    for d in {0, half // 3, half - 1}:
        exact = [sum(a * b for a, b in zip(x[:, c].tolist(), y[d : d + half, c].tolist(), strict=True)) for c in range(2)]
        assert [int(v) % p for v in got[d]] == [-2 * e % p for e in exact]


def test_a_difference_hidden_by_the_modulus_is_seen(monkeypatch):
    """All words have one number, so every sum is zero: only the words themselves decide."""
    rng = random.Random(5)
    w = [0] + planted(rng, 90, 3) + [1] * 9
    words = np.arange(4, dtype=np.uint64)
    r = periodic.find_runs(words[np.array(w)], np.array([0, len(w)]))
    assert sorted(zip(r.start.tolist(), r.end.tolist(), r.period.tolist(), strict=True)) == plain_runs(w)




def nasty():
    rng = random.Random(8)
    data = rows()
    extra = [" ".join(f"w{x}" for x in planted(rng, rng.choice([9, 40, 400]), rng.choice([1, 2, 9]))) for _ in range(60)]
    extra += ["so so so so so so", "So so so so so so", "a b " * 4, "a\tb\n" * 3 + "a b", "x " * 9000]
    data += [(5000 + i, t, *data[0][2:]) for i, t in enumerate(extra)]
    return [*data, (None, "n n n n n n n", *data[0][2:]), (None, None, *data[0][2:]), data[-1]]


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic, "JOINED_BYTES", 1000)
    data = nasty()
    got = periodic.periodic_runs(frame(spark, data), edited=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, sha("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)), r.collapsed_sha256) for r in got]
    assert sorted(shown, key=repr) == sorted((plain(r[0], r[1]) for r in data), key=repr)
    assert all(r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", dict((d[0], d[1] or "") for d in data)[r.doc_id])) for r in got if r.doc_id is not None)
    untouched = {r.doc_id: r.n_runs for r in periodic.periodic_runs(frame(spark, data)).collect()}
    assert all(untouched[d] == plain(d, t, edited=False)[1] for d, t, *_ in data if d is not None)
    assert periodic.periodic_runs(no_rows(spark)).count() == 0


def test_op12(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.op12_periodic(spark, sf).collect()
    docs = registry.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(plain(*d) for d in docs)
    assert any(r.n_runs for r in got)
