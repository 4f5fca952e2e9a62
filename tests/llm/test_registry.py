"""The registered queries as they are: against their SQL, or against plain versions, on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from newsloom.llm import bpe_fst, license_scan, registry
from tests.llm.fixtures import low
from tests.llm.test_dedup import alike, shown

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = registry.QUERIES[name](spark, SF)
    assert set(columns) <= set(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_op2(spark, texts):
    got = registry.op2_line_crf(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    quality = dict(duckdb.sql(f"SELECT doc_id, min(quality) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert held and sum(r.predicted == quality[r.doc_id] for r in held) / len(held) > 0.9


def test_op3(spark, texts):
    order = sorted(texts.items(), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        following, n = order[(k + 1) % len(order)][1], len(t)
        edited = t[: n - n // 2] + following[: n // 2]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), shown(t), shown(edited), round(alike(t, edited), 9), round(alike(t, following), 9)))
    got = registry.op3_winnow(spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def readings(template):
    """All wordings of a template as patterns over words."""
    out = ""
    for optional, replaceable, plain in re.findall(r"(?s)\[\[(.*?)\]\]|<<(.*?)>>|((?:(?!\[\[|<<).)+)", template):
        words = lambda text: "".join(f" {w}" for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
        if plain:
            out += words(plain)
        elif replaceable.isdigit():
            out += "( [^ ]+){0,%s}" % replaceable
        else:
            out += "(" + "|".join(words(c) for c in (optional or replaceable).split("|")) + ")" + ("?" if optional else "")
    return re.compile(out + "(?= |$)")


def test_op4(spark, texts):
    templates = [(label, readings(t)) for label, t in [*license_scan.TEMPLATES, *license_scan.BODIES]]
    openings = [(label, readings(t)) for label, t in license_scan.OPENINGS]
    got = {r.doc_id: r for r in registry.op4_license_scan(spark, SF).collect()}
    assert sorted(got) == sorted(texts)
    seen: Counter = Counter()
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        base = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        own, begun = ({label for label, pattern in some if pattern.search("".join(f" {x}" for x in w))} for some in (templates, openings))
        starts = [k for k, _ in base]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base})) and r.labels == ",".join(sorted({label for _, label in base} | own | begun))
        assert r.score == (1.0 if own else 0.5 if base or begun else 0.0)
        seen.update(own)
    assert len(seen) >= 3


def test_op5(spark, texts):
    got = registry.op5_katz(spark, SF).collect()
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        t = tokens[r.doc_id]
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n) and abs(r.base_score - base) < 1e-6 and r.score <= 0
    # the model predicts better than single words do, on texts that it has not seen
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op6(spark, texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op6_bpe_fst(spark, SF).collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
    assert got == want


def test_op7_and_op10(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, at = {}, 0
    for i in sorted(ids):
        want[i] = at, len(ids[i]) + 1, crc([*ids[i], 2])
        at += len(ids[i]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.op7_wavelet(spark, SF).collect()} == want
    filled: dict[int, list[tuple[int, int]]] = {}
    pieces = set()
    for r in registry.op10_best_fit(spark, SF).collect():
        own = [*ids[r.doc_id], 0]
        assert r.start == 2048 * r.piece and r.length == min(2048, len(own) - r.start) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.add((r.doc_id, r.piece))
    assert pieces == {(i, k) for i, x in ids.items() for k in range(-(-(len(x) + 1) // 2048))}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(filled) <= 1.01 * -(-sum(len(x) + 1 for x in ids.values()) // 2048) + 1
