"""The line CRF, the backoff model and the license templates."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import katz_lm, license_scan, quality_crf
from newsloom.llm.registry import fold
from tests.llm.fixtures import frame, low, no_rows, rows


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 8])
    emission, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, moved, total = quality_crf._marginals(emission, first, moves)
    want, want_moved, want_total = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = math.exp(sum(e * v for e, v in zip(emission[a:b], y, strict=True)) + sum(moves[p, q] for p, q in itertools.pairwise(y)))
        z = sum(weights.values())
        want_total += math.log(z)
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for p, q in itertools.pairwise(y):
                want_moved[p, q] += w / z
    assert np.allclose(good, want) and np.allclose(moved, want_moved) and math.isclose(total, want_total)


def labelled(spark, n=240):
    rng = random.Random(8)
    words = ["alpha", "bravo", "delta", "echo", "kilo", "lima"]
    good = lambda: " ".join(rng.choices(words, k=12)).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(rng.choices(words, k=9)), "!! ".join(w.upper() for w in rng.choices(words, k=9)) + "!!", " ".join([rng.choice(words)] * 15), "### ".join(rng.choices(words, k=9))])
    data = [(i, "\n".join((good if i % 3 else bad)() for _ in range(rng.randint(1, 6)))) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_quality(spark):
    docs, labels = labelled(spark)
    held = F.col("doc_id") % 4 == 2
    model = quality_crf.train(docs, labels.where(~held))
    got = quality_crf.score(docs, model).join(labels, "doc_id").where(held).collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in got) / len(got) > 0.95


def test_every_line_of_a_training_document_counts(spark):
    """What a document says after its 64th line is learnt: here only the later lines tell the labels apart."""
    data = [(i, "\n".join(["Plain words stand here."] * 80 + (["Plain words stand here."] if i % 2 else ["!!! BUY | NOW !!!"]) * 120)) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = quality_crf.score(docs, quality_crf.train(docs, labels.where("doc_id < 60"))).where("doc_id >= 60").collect()
    assert all((r.score >= 0.7) == (r.doc_id % 2 == 1) for r in got) and {r.n_lines for r in got} == {200}


def test_the_sample_is_bounded_by_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 40)
    docs, labels = labelled(spark, 90)
    seen = []
    monkeypatch.setattr(quality_crf, "fit", lambda features, first, label, size: seen.append((len(features), np.diff(first))) or {})
    quality_crf.train(docs, labels)
    assert 20 < seen[0][0] <= 40 and (seen[0][1] > 0).all()


def test_quality_of_awkward_rows(spark):
    docs, labels = labelled(spark, 60)
    model = quality_crf.train(docs, labels)
    got = quality_crf.score(frame(spark), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    text = {r[0]: r[1] for r in rows()}
    assert all(r.score == 0 and r.good_share is None for r in got if not (text[r.doc_id] or "").strip(" \n\t\r\x0b\x0c"))
    assert quality_crf.score(no_rows(spark), model).count() == 0
    neutral = quality_crf.train(docs, labels.where("false"))
    assert {round(r.score, 9) for r in quality_crf.score(docs, neutral).collect()} == {0.5}


@pytest.mark.parametrize("sizes", [(4 << 20, 1_000_000), (2_000, 300)])
def test_backoff_scores(spark, monkeypatch, sizes):
    monkeypatch.setattr(katz_lm, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(katz_lm, "PARTITION_TOKENS", sizes[1])
    data = rows()
    got = katz_lm.score_documents(frame(spark), fold("doc_id", 7) == 2).collect()
    assert len(got) == len(data)
    tokens = {r[0]: [*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), "\0"] for r in data}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    trained = [tokens[r[0]] for r in data if not held[r[0]]]
    c = Counter(w for t in trained for w in t)
    b = Counter(p for t in trained for p in zip(["\1", *t], t))  # noqa: B905
    n, v = sum(c.values()), len(c)
    times = lambda x: [Counter(x.values())[k] for k in range(1, 7)]
    uni, d = katz_lm.Unigrams(n, v, times(c)), katz_lm.discounts(times(b))
    p = {w: float(uni.probability(np.array([k]))[0]) for w, k in c.items()}
    assert math.isclose(sum(p.values()) + uni.unknown, 1)
    after = defaultdict(dict)
    for (h, w), k in b.items():
        after[h][w] = k
    alpha, total = {}, {}
    for h, seen in after.items():
        all_ = sum(seen.values())
        mass = sum((d[k] if k <= 5 else 1) * k for k in seen.values())
        total[h] = all_ if mass < all_ - 1e-9 else all_ + 1
        alpha[h] = (1 - mass / total[h]) / (1 - sum(p[w] for w in seen))
        assert math.isclose(mass / total[h] + alpha[h] * (1 - sum(p[w] for w in seen)), 1)  # every history sums to 1
    for r in got:
        t = tokens[r.doc_id]
        score = 0.0
        for h, w in zip(["\1", *t], t):  # noqa: B905
            k = b.get((h, w), 0)
            score += math.log10((d[k] if k <= 5 else 1) * k / total[h]) if k else math.log10(p.get(w, uni.unknown)) + math.log10(alpha.get(h, 1))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_backoff_without_rows_or_training(spark):
    assert katz_lm.score_documents(no_rows(spark), F.lit(False)).count() == 0
    got = katz_lm.score_documents(frame(spark, rows()[:3]), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 3


def test_license_phrases(spark):
    data = rows()
    got = license_scan.scan_licenses(frame(spark)).collect()
    text = {r[0]: low(r[1]) for r in data}
    assert len(got) == len(data)
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[r.doc_id])
        want = sorted((label, i) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert r.n_words == len(w) and sorted((f.label, f.start) for f in r.found if f.kind == "phrase") == want
    assert license_scan.scan_licenses(no_rows(spark)).count() == 0


@pytest.mark.parametrize(
    "text, label",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"), ("Released under the MIT License.", "mit"), ("Copyright (c) 2020 Some Body Here. All rights reserved.", "copyright-notice"),
        ("Licensed under the Apache Licence, Version 2.0.", None), ("Released under no MIT License", None), ("Copyright 1 2 3 4 5 6 7 all rights reserved", None),
    ],
)
def test_license_templates(text, label):
    from newsloom.llm.textbytes import text_hash

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    hashes = [text_hash(w) for w in words]
    found = {name for name, t in license_scan.TEMPLATES for i in range(len(words)) if hashes[i] in license_scan.Automaton(t).first and license_scan.Automaton(t).accept(hashes[i:])}
    assert found == ({label} if label else set())


def wording(template, optional):
    """One reading of a template, and whether each of its words is mandatory; optional parts are left out or taken."""
    out = []
    for left_out, replaceable, plain in re.findall(r"(?s)\[\[(.*?)\]\]|<<(.*?)>>|((?:(?!\[\[|<<).)+)", template):
        part = plain or ("The Authors of 2024" if replaceable.isdigit() else replaceable.split("|")[0]) or (left_out.split("|")[0] if optional else "")
        out += [(w, bool(plain)) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.lower())]
    return out


@pytest.mark.parametrize("label, template", license_scan.BODIES)
@pytest.mark.parametrize("optional", [False, True])
def test_licence_bodies_hold_every_mandatory_word(label, template, optional):
    from newsloom.llm.textbytes import text_hash

    machine, words = license_scan.Automaton(template), wording(template, optional)
    hashes = [text_hash(w) for w, _ in words]
    assert machine.accept(hashes) == len(words) > 60
    refused = [i for i, (_, fixed) in enumerate(words) if fixed and not machine.accept([*hashes[:i], text_hash("xyzzy"), *hashes[i + 1 :]])]
    short = [i for i, (_, fixed) in enumerate(words) if fixed and not machine.accept([*hashes[:i], *hashes[i + 1 :]])]
    assert refused == short == [i for i, (_, fixed) in enumerate(words) if fixed]


def test_changed_licence_is_its_opening_only(spark):
    bodies = {label: " ".join(w for w, _ in wording(t, True)) for label, t in license_scan.BODIES}
    texts = [("whole " + label, "Some code.\n" + t.upper() + "\nEnd") for label, t in bodies.items()]
    texts += [("changed mit-text", bodies["mit-text"].replace("noninfringement", "infringement")), ("bsd both", bodies["bsd-2-clause-text"] + " " + bodies["bsd-3-clause-text"]), ("none", None), ("cut", bodies["isc-text"][:-1])]
    got = {r.doc_id: {(f.kind, f.label) for f in r.found if f.kind != "phrase"} for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    for label in bodies:
        assert {x for k, x in got["whole " + label] if k == "template" and x.endswith("-text")} == {label}
    assert got["changed mit-text"] == {("opening", "mit-opening")} and got["cut"] == {("opening", "isc-opening")} and not got["none"]
    assert got["bsd both"] == {("template", "bsd-2-clause-text"), ("template", "bsd-3-clause-text"), ("opening", "bsd-opening")}


def test_thresholds_are_held_against_unseen_folds(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_crf.cross_validated(docs.withColumn("score", F.lit("x")), labels, [0.0, 0.25, 0.5, 1.01], folds=2).collect()
    have = labels.join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q is not null")
    good, bad = have.where("q = 1").count(), have.where("q = 0").count()
    assert [r.threshold for r in got] == [0.0, 0.25, 0.5, 1.01] and all(r.n == good + bad for r in got)
    assert (got[0].bad_kept, got[0].good_lost) == (bad, 0) and (got[-1].bad_kept, got[-1].good_lost) == (0, good)
    assert got[1].bad_kept >= got[2].bad_kept and got[1].good_lost <= got[2].good_lost and got[1].bad_kept + got[1].good_lost < (good + bad) / 5
