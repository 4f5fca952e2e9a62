"""Tokenising, token files, packing and URL rules against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import bpe_fst, packing, url_filter, wavelet, word_ids
from newsloom.llm.registry import URL_RULES
from newsloom.llm.runtime import shared_folder
from newsloom.llm.textbytes import SPACE_WORDS, text_hash, word_runs
from newsloom.llm.word_ids import encoded_runs
from tests.llm.fixtures import frame, low, no_rows, rows

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CODEC = bpe_fst.Codec(RANKS, P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
LIBRARY = Tokenizer.from_file(WORDS)
LIBRARY.encode_special_tokens = True
TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdeAB é\n\t 's'll12!=-ñ漢😀\x1c\x85\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library_and_comes_back(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert b"".join(CODEC.decode(ids)) == text.encode()


def test_bpe_of_long_pieces():
    rng = random.Random(3)
    for piece in ("a" * 3000, "=" * 777, "".join(rng.choice("abcdefgh") for _ in range(4000)), "é" * 900, " " * 2000):
        assert CODEC.encode(piece).tolist() == REFERENCE.encode_ordinary(piece)


def test_tokens_are_emitted_before_the_piece_ends():
    machine = bpe_fst.Transducer(bpe_fst.read_ranks(RANKS))
    pieces = [b"internationalisation", b"a" * 3000, "".join(random.Random(5).choices("etaoin shrdlu", k=4000)).encode(), "é漢".encode() * 300]
    for piece in pieces:
        out, early, lag = [], 0, 0
        for k, tokens in enumerate(machine.emit(piece)):
            out += tokens
            early += len(tokens) * (k < len(piece))
            lag = max(lag, min(k + 1, len(piece)) - sum(len(machine.bytes[t]) for t in out))
        assert out == REFERENCE._encode_single_piece(piece)
        assert early > 0 and lag <= 2 * machine.longest
        assert machine.encode(piece) == out
    assert len(machine.states) < len(machine.moves) + 1  # different beginnings lead to one state


def test_a_full_transducer_goes_on(monkeypatch):
    monkeypatch.setattr(bpe_fst, "MOST_MOVES", 20)
    machine = bpe_fst.Transducer(bpe_fst.read_ranks(RANKS))
    for word in ("hello", "hellish", "transducer", "xyzzyx", "antidisestablishmentarianism"):
        assert machine.encode(word.encode()) == REFERENCE._encode_single_piece(word.encode())
    assert len(machine.moves) == 20


def test_utf8_machine_equals_the_codec():
    rng = random.Random(6)
    for _ in range(400):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randint(0, 9)))
        machine = bpe_fst.Utf8Machine()
        got = "".join(machine.feed(bytes((b,))) for b in data) + machine.close()
        try:
            assert got == data.decode()
        except UnicodeDecodeError:
            assert "�" in got


def test_round_trip(spark):
    data = rows()
    got = bpe_fst.round_trip(frame(spark), RANKS, P.PATTERN).collect()
    text = {r[0]: r[1] or "" for r in data}
    assert len(got) == len(data)
    for r in got:
        ids = REFERENCE.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert bpe_fst.round_trip(no_rows(spark), RANKS, P.PATTERN).count() == 0
    assert [len(r.ids) for r in bpe_fst.encode_texts(frame(spark, data[:3]), RANKS, P.PATTERN).orderBy("doc_id").collect()] == [len(REFERENCE.encode_ordinary(r[1])) for r in data[:3]]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_word_ids_equal_the_library(texts):
    got = [ids[a:b].tolist() for _, ids, first in encoded_runs(pa.array(texts, pa.string()), WORDS) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_word_table_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(word_ids, "MOST_WORDS", 40)
    encoder, rng = word_ids.WordEncoder(WORDS), random.Random(3)
    for k in range(60):
        texts = [" ".join(rng.choice(["usual", "common", f"rare{rng.randrange(10**6)}"]) for _ in range(30 if k % 20 else 90)) for _ in range(2)]
        run = next(iter(word_runs(pa.array(texts), SPACE_WORDS, lower=False)))
        ids, first = encoder.encode(run)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.hashes) <= 40 or k % 20 == 0 or len(encoder.hashes) < 200


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 40))
def test_words_of_runs(texts, size):
    got = []
    for run in word_runs(pa.array(texts, pa.string()), SPACE_WORDS, size):
        hashes = run.hashes().tolist()
        got += [hashes[a:b] for a, b in zip(run.first[:-1], run.first[1:], strict=True)]
    assert got == [[text_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", low(t))] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1400), st.integers(0, 300), st.sampled_from([3, 40, 4096]), st.sampled_from([1, 8, 8192]))
def test_wavelet_matrix(values, token, sample, section):
    """Access, rank, count and select against plain lists, with small directories and sections too."""
    x = np.array(values, np.uint32)
    kept = wavelet.SAMPLE, wavelet.SECTION
    wavelet.SAMPLE, wavelet.SECTION = sample, section
    try:
        matrix = wavelet.open_shard(wavelet.pack_shard(np.arange(1), np.array([len(x)]), x, 2)).matrix
        places = [i for i, v in enumerate(values) if v == token]
        assert matrix.occurrences(token).tolist() == places and matrix.occurrences(token, 1, 3).tolist() == places[1:3]
        assert [matrix.select(token, k) for k in range(len(places))] == places and matrix.select(token, len(places)) == -1
        for at in {0, len(values) // 2, len(values)}:
            assert matrix.rank(token, at) == sum(p < at for p in places)
        assert matrix.access(np.arange(len(x))).tolist() == values and matrix.tokens().tolist() == values
    finally:
        wavelet.SAMPLE, wavelet.SECTION = kept


def test_a_shard_opens_only_what_it_reads():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 50_000, 3_000_000, dtype=np.uint32)
    matrix = wavelet.open_shard(wavelet.pack_shard(np.arange(1), np.array([len(x)]), x, 2)).matrix
    assert matrix.access(np.array([7, 11])).tolist() == x[[7, 11]].tolist()
    assert sum(int((~p.shut).sum()) for p in matrix.planes) <= 2 * len(matrix.planes) < sum(len(p.shut) for p in matrix.planes)
    assert matrix.select(int(x[5]), 0) == int(np.flatnonzero(x == x[5])[0])


def test_end_ids_inside_a_document_end_nothing():
    shard = wavelet.open_shard(wavelet.pack_shard(np.array([5, 6]), np.array([4, 5]), np.array([1, 2, 7, 2, 2], np.uint32), 2))
    assert shard.ends().tolist() == [4, 5] and shard.ids.tolist() == [5, 6]


def test_token_files(spark):
    data = rows()
    path = f"{shared_folder(spark)}/files"
    wavelet.write_shards(frame(spark), path, WORDS, 2, shard_tokens=900)
    got = sorted(wavelet.read_documents(spark.read.parquet(path)).collect(), key=lambda r: r.start)
    assert len(got) == len(data) and spark.read.parquet(path).count() > 3
    at, text = 0, {r[0]: r[1] or "" for r in data}
    assert [r.doc_id for r in got] == sorted(r[0] for r in data)
    for r in got:
        ids = [*LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    every = [t for i in text for t in LIBRARY.encode(text[i], add_special_tokens=False).ids for _ in range(sum(d[0] == i for d in data))]
    counted = wavelet.count_tokens(spark.read.parquet(path), [every[0], every[-1], 2, 49_000_000]).collect()
    assert {r.token: r.n for r in counted} == {t: every.count(t) for t in (every[0], every[-1])} | {2: len(data), 49_000_000: 0}
    lost = frame(spark, [(None, "a", *data[0][2:]), (-(1 << 63), "a b", *data[0][2:]), (None, None, *data[0][2:])])
    wavelet.write_shards(lost, f"{path}-lost", WORDS, 2)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in wavelet.read_documents(spark.read.parquet(f"{path}-lost")).collect())[0] == (-(1 << 63), 3)
    empty = f"{shared_folder(spark)}/none"
    wavelet.write_shards(no_rows(spark), empty, WORDS, 2)
    assert wavelet.read_documents(spark.read.parquet(empty)).count() == 0


def test_packing(spark):
    data = rows()
    text = {r[0]: r[1] or "" for r in data}
    got = packing.pack(frame(spark), WORDS, 0, capacity=256).collect()
    filled: dict[int, list[tuple[int, int]]] = {}
    pieces: dict[int, list] = {}
    for r in got:
        ids = [*LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.start == 256 * r.piece and r.length == min(256, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r.piece)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert set(pieces) == set(text)
    assert len(filled) <= 1.05 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(no_rows(spark), WORDS, 0).count() == 0


def plain_best_fit(lengths, capacity):
    gaps: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 4)), max_size=12), st.lists(st.tuples(st.integers(1, 9), st.integers(1, 2), st.integers(1, 4)), max_size=12), st.integers(1, 4))
def test_a_sweep_finds_successors(gaps, items, ranges):
    """Ranges swept apart and then together give each bundle, the largest first, the smallest free gap that holds it."""
    first = np.cumsum([0, *[n for _, n in gaps]]).tolist()
    rows = [{"gap": g, "first": f, "n": n, "length": None, "each": None} for (g, n), f in zip(gaps, first, strict=False)]
    rows += [{"gap": None, "first": None, "n": n, "length": x, "each": e} for x, e, n in items]
    of = lambda r: (r["gap"] or r["length"] * r["each"]) * ranges // 21
    schema = pa.schema([(c, pa.int64()) for c in ("gap", "first", "n", "length", "each")])
    apart = [packing._sweep((), pa.Table.from_pylist([r for r in rows if of(r) == k], schema)) for k in range(ranges)]
    got = packing._sweep((), pa.concat_tables(apart)).to_pylist()
    free = [g for g, n in gaps for _ in range(n)]
    want = []
    for size, x, e in sorted(((x * e, x, e) for x, e, n in items for _ in range(n)), key=lambda t: (-t[0], -t[1])):
        fits = [g for g in free if g >= size]
        if fits:
            free.remove(min(fits))
            want.append((min(fits), size))
    assert sorted((r["gap"], r["length"] * r["each"]) for r in got if r["gap"] and r["length"] for _ in range(r["n"])) == sorted(want)
    names = [r["first"] + i for r in got if r["gap"] for i in range(r["n"])]
    assert sorted(names) == list(range(first[-1]))  # each sequence once
    assert sorted(g for r in got if r["gap"] and not r["length"] for g in [r["gap"]] * r["n"]) == sorted(free)


def placed(spark, lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    filled: dict[int, list[tuple[int, int]]] = {}
    seen: dict[int, list[int]] = {}
    for r in packing.place_runs(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity).collect():
        seen.setdefault(r.length, []).extend(range(r.rank, r.rank + r.n * r.each))
        for k in range(r.n):
            filled.setdefault(r.sequence + k, []).extend((r.offset + j * r.length, r.length) for j in range(r.each))
    assert {x: list(range(n)) for x, n in counts.items()} == {x: sorted(r) for x, r in seen.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_rounds_place_every_piece_about_as_best_fit_does(spark):
    rng = random.Random(4)
    for lengths in ([rng.randint(1, 40) for _ in range(150)], [1] * 300, [13, 14] * 40, [40]):
        assert placed(spark, lengths, 40) <= 1.03 * plain_best_fit(lengths, 40) + 1


def test_packing_of_awkward_rows(spark):
    """Null and repeated ids, equal rows, and a length that is split over groups of ranks."""
    pieces = spark.createDataFrame([(None if i % 3 else i % 7, 0, 3, "x") for i in range(900)], "doc_id long, piece int, length long, sequence string").repartition(4)
    got = packing.assign(pieces, 10).collect()
    assert len(got) == 900 and len({(r.sequence_id, r.offset) for r in got}) == 900
    assert len({r.sequence_id for r in got}) == 300 and {r.offset for r in got} == {0, 3, 6}


def judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = low(raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(r), v == "block", r, v) for v, r in URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_long_urls_take_no_longer(spark):
    """60,000 folders: only as many prefixes are built as the rules have folders."""
    urls = ["http://www.example.com/en/" + "a/" * 60_000, "http://" + "x." * 60_000 + "com/" + "/" * 60_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.rule_table(spark, URL_RULES)
    url_filter.filter_urls(pages.limit(1), rules).collect()
    began = time.time()
    got = url_filter.filter_urls(pages, rules).collect()
    assert time.time() - began < 15 and {r.page_id: r.rule for r in got} == {0: "www.example.com/en/", 1: "com/"}


def test_full_digests_decide(spark, monkeypatch):
    """With short prefixes of one hexadecimal digit nearly every expression meets a wrong rule."""
    monkeypatch.setattr(url_filter, "SHORT", 1)
    rules = [(v, r) for v, r in URL_RULES] + [("block", f"host{i}.org/p{i}/") for i in range(60)]
    urls = [f"http://a{i}.host{i}.org/p{i}/x" for i in range(60)] + [f"http://host{i}.org/q{i}/" for i in range(60)] + ["http://x.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i: f"host{i}.org/p{i}/" if i < 60 else "com/" if i == 120 else None for i in range(121)}


def test_url_rules(spark):
    urls = [None, "", "nohost", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://example.com/enx", "http://com/", "http://x.com", "ftp://a.net/es/1#t", "http://net/fr/", "http://xnet/fr/", "a://b://c/d", "http://.com/", "http://e.example.com:80/en/", "//x.com/", "http://x.com//en/", "http://é.com/É/?"]
    data = [(i, u, "h", "p", "v") for i, u in enumerate(urls)] + [(3, urls[3], "h", "p", "v")] * 2 + [(None, urls[3], "h", "p", "v")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, path string, verdict string").repartition(3)
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=repr) == sorted(((d[0], *judge(d[1])) for d in data), key=repr)
    assert url_filter.filter_urls(pages.where("false"), url_filter.rule_table(spark, URL_RULES)).count() == 0
