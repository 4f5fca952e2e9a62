"""Exact and near dedup, components, winnowing against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from newsloom.llm import exact_dedup, near_dedup, runtime, winnow
from newsloom.llm.exact_dedup import exact_duplicates
from newsloom.llm.shingles import MinHash, shingle_sets
from tests.llm.fixtures import frame, low, no_rows, rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(data):
    sets = {r[0]: shingles(r[1]) for r in data}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


def test_near_duplicates(spark):
    data = rows()
    sets, label = classes(data)
    got = near_dedup.near_duplicates(frame(spark)).collect()
    assert len(got) == len(data)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id) for r in got)
    assert len(set(label.values())) < len(label)


def test_near_duplicates_chain_across_a_large_band(spark, monkeypatch):
    """Versions that differ step by step: neighbours are linked, the ends share little; every link must be found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    data = []
    for k in range(60):
        w = list(base)
        for j in range(0, k // 2):
            w[2 * j] = f"new{j}"
        data.append((k, " ".join(w), *rows()[0][2:]))
    _, label = classes(data)
    got = near_dedup.near_duplicates(frame(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_near_duplicates_nulls_and_no_rows(spark):
    assert near_dedup.near_duplicates(no_rows(spark)).count() == 0
    rest = rows()[0][2:]
    got = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f", *rest), (4, "a b c d e f", *rest), (2, None, *rest), (9, "", *rest)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [(0, 2, 0, True), (2, 0, 2, True), (4, 2, 4, True), (9, 0, 9, True)]


def test_shingle_sets_of_runs_of_few_words():
    """A run is one batch of rows or less: batches of one short text, and a short text between two that are runs of their own."""
    few = [" ".join("abcdef"[:k]) for k in range(7)]
    long = " ".join(f"w{i}" for i in range(400_000))
    for texts in [*([t] for t in few), [long, few[3], long], [few[1], few[2]]]:
        found = [int(n) for _, _, first in shingle_sets(pa.array(texts)) for n in np.diff(first)]
        assert found == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("n", range(7))
def test_near_duplicates_one_row_a_partition(spark, n):
    data = [(k, " ".join("abcdef"[:n]), *rows()[0][2:]) for k in range(2)]
    got = near_dedup.near_duplicates(frame(spark, data).repartitionByRange(2, "doc_id")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.kept) for r in got) == [(0, len(shingles(data[0][1])), True), (1, len(shingles(data[1][1])), n == 0)]


def test_odd_sketch_bound():
    rng = np.random.default_rng(4)
    hashing, worst = MinHash(), 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]), np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        s = hashing.odd_sketches(hashing.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        worst = max(worst, int(np.bitwise_count(s[0] ^ s[1]).sum()))
    assert worst <= near_dedup.SKETCH_BOUND


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_duplicates(spark, digest_all):
    data = rows()
    groups: dict[str, list[int]] = {}
    for r in data:
        groups.setdefault(low(r[1]), []).append(r[0])
    text = {r[0]: low(r[1]) for r in data}
    got = exact_duplicates(frame(spark), digest_all=digest_all).collect()
    assert len(got) == len(data)
    for r in got:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        digest = hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.text_sha256 == digest if digest_all or len(g) > 1 else r.text_sha256 in (None, digest)
    assert exact_duplicates(no_rows(spark)).count() == 0


def test_exact_duplicates_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 1)
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", 1)
    got = exact_duplicates(frame(spark)).select("doc_id", "keep_id", "group_size", "kept").collect()
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact_duplicates(frame(spark), digest_all=True).select("doc_id", "keep_id", "group_size", "kept").collect()))


@pytest.mark.parametrize("most", [0, 10**6])
def test_ids_are_picked_whole_with_a_bounded_broadcast(spark, monkeypatch, most):
    """r04 F1: more ids than the bound are not broadcast; they pass a filter of fixed size and are joined by a shuffle."""
    monkeypatch.setattr(runtime, "FILTER_BITS", 9)
    monkeypatch.setattr(runtime, "BROADCAST_IDS", most)
    data = [(i * 7919 if i % 50 else None, f"t{i}") for i in range(900)]
    picked = {i * 7919 for i in range(0, 900, 3) if i % 50} | {-5}
    table, ids = spark.createDataFrame(data, "id long, text string"), spark.createDataFrame([(i,) for i in picked], "id long")
    only, rest = runtime.only_ids(table, ids, "id"), runtime.without_ids(table, ids, "id")
    assert sorted(map(tuple, only.collect())) == sorted(r for r in data if r[0] in picked) and only.columns == table.columns
    assert sorted(map(repr, map(tuple, rest.collect()))) == sorted(repr(r) for r in data if r[0] not in picked) and rest.columns == table.columns
    hinted = [x for x in only._jdf.queryExecution().optimizedPlan().toString().splitlines() if "strategy=broadcast" in x and "LeftSemi" in x]
    assert bool(hinted) == bool(most) and near_dedup.BROADCAST_KEYS <= 200_000 and exact_dedup.BROADCAST_IDS <= 200_000


def test_near_and_exact_duplicates_beyond_the_bounds(spark, monkeypatch):
    """r04 F1: the same results when no id is broadcast."""
    monkeypatch.setattr(runtime, "BROADCAST_IDS", 0)
    data = rows()
    _, label = classes(data)
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark)).collect()} == set(label.items())


def test_exact_duplicates_null_ids(spark):
    rest = rows()[0][2:]
    got = exact_duplicates(frame(spark, [(None, "A", *rest), (3, "a", *rest), (None, "b", *rest)])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 3, 2, False), (3, 3, 2, True)]


def turned(x, bits):
    bits %= 64
    return ((x << bits) | (x >> (64 - bits))) & ((1 << 64) - 1)


def plain_winnow(text):
    """[(hash, position)] by the rule: all k-gram hashes, the minimum of every window as signed numbers, the rightmost of equals."""
    words = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^ \t-\r]{1,%d}" % winnow.WORD_CHARS, text)]
    if not words:
        return []
    grams = []
    for i in range(max(1, len(words) - winnow.GRAM + 1)):
        h = 0
        for j in range(winnow.GRAM):
            h ^= turned(words[i + j], winnow.TURN * (winnow.GRAM - 1 - j)) if i + j < len(words) else 0
        grams.append(h - (1 << 64) if h >> 63 else h)
    out = []
    for k in range(max(1, len(grams) - winnow.WINDOW + 1)):
        best = min(range(k, min(k + winnow.WINDOW, len(grams))), key=lambda i: (grams[i], -i))
        if not out or out[-1][1] != best:
            out.append((grams[best], best))
    return out


def alike(a, b):
    x, y = {h for h, _ in plain_winnow(a)}, {h for h, _ in plain_winnow(b)}
    return len(x & y) / len(x | y) if x | y else 1.0


def shown(text):
    return " ".join(f"{h & ((1 << 64) - 1):x}:{p}" for h, p in plain_winnow(text))


def test_winnowing(spark):
    data = rows()
    got = winnow.half_edited(frame(spark), ranges=7).collect()
    assert len(got) == len(data)
    # rows of one id are ordered by their texts
    order = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), shown(t), shown(edited), round(alike(t, edited), 9), round(alike(t, following), 9)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert winnow.half_edited(no_rows(spark), ranges=4).count() == 0


def test_winnowing_of_null_ids_and_clashing_names(spark):
    rest = rows()[0][2:]
    got = winnow.half_edited(frame(spark, [(None, "a b c d e f", *rest), (None, None, *rest), (4, "a b", *rest), (9, None, *rest)]), ranges=3).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.fingerprint) for r in got) == sorted([(0, 11, shown("a b c d e f")), (0, 0, ""), (4, 3, shown("a b")), (9, 0, "")])


def test_winnowing_chooses_by_the_rule(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t", "z z z z z z z z z z z z z z z z", "a b", "a b c d e", "", "x" * 500, " ".join(f"w{i % 977}" for i in range(60_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(p.hash, p.position) for p in r.fingerprint] for r in winnow.fingerprints(df).collect()}
    assert got == {i: plain_winnow(t) for i, t in enumerate(texts)}


def test_positions_are_not_bounded(spark):
    """More words than 24 bits count: positions and hashes stay apart."""
    n = (1 << 24) + 50
    from pyspark.sql import functions as F

    placed = F.struct(F.lit(5).cast("bigint").alias("hash"), F.lit(n).alias("position"))
    assert spark.range(1).select(winnow.as_text(F.array(placed)).alias("t")).first().t == f"5:{n}"


def crowd(n, shared=60, own=40):
    """n texts that share a passage of `shared` words and little else; every tenth has a near copy, every fortieth a chain of them."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(shared)]
    out = []
    for i in range(n):
        words = passage + [f"u{rng.randrange(1 << 40)}" for _ in range(own)]
        out.append(words)
        for k in range(3 if i % 40 == 0 else 1 if i % 10 == 0 else 0):
            words = list(words)
            words[-1 - 7 * k] = f"e{i}-{k}"
            out.append(words)
    return [(k, " ".join(w), *rows()[0][2:]) for k, w in enumerate(out)]


def test_a_crowd_around_a_passage(spark, monkeypatch):
    """Bands above BLOCK that hold many components: no link is lost, and the rows that are compared stay linear in the members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    compared = []
    across = near_dedup._across
    data = crowd(400)
    _, label = classes(data)
    seen = spark.sparkContext.accumulator(0)

    def counted(percent):
        run = across(percent)

        def wrapped(batches):
            def passed():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from run(passed())

        return wrapped

    monkeypatch.setattr(near_dedup, "_across", counted)
    got = near_dedup.near_duplicates(frame(spark, data)).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    compared.append(seen.value)
    seen.value = 0
    near_dedup.near_duplicates(frame(spark, crowd(800))).count()
    compared.append(seen.value)
    assert compared[1] <= 2.6 * compared[0] + 400


def test_the_rarest_shingles_meet_every_similar_set():
    rng = np.random.default_rng(8)

    class frequency:
        value = rng.integers(0, 5, near_dedup.COUNTERS)

    for n, m in [(1, 1), (4, 3), (4, 4), (10, 8), (100, 75), (133, 100), (37, 31)]:
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            shared = -(-75 * (n + m) // 175)  # the least overlap at similarity 0.75
            if shared > min(n, m):
                continue
            a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:shared], both[200 : 200 + m - shared]]))
            table = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["id", "items"])
            out = list(near_dedup._rarest(frequency, 75)(iter([table])))[0]
            keys = {i: {k for j, k in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True) if j == i} for i in (1, 2)}
            assert keys[1] & keys[2]


def test_recall_of_bands_and_sketches():
    """Pairs right at similarity 0.75: all of 600 meet in a band, and pass the sketch bound."""
    rng = np.random.default_rng(12)
    hashing, met = MinHash(), 0
    for _ in range(600):
        both = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 25, dtype=np.uint64)]) for _ in range(2))
        minima = hashing.minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        keys, sketch = hashing.band_keys(minima), hashing.odd_sketches(minima)
        met += bool((keys[0] == keys[1]).any()) and int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) <= near_dedup.SKETCH_BOUND
    assert met == 600
