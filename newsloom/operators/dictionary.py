"""Large term lists: places of thousands of terms and more in texts, and texts rewritten by them.

Terms and texts are read as words (runs of letters and digits, lower-cased), so a term stands in a text where its words stand one
after another, whatever is between them. Of the places of all terms those stay that are met from the left, the longest at each
place, without overlap.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.editing import let

WORD = r"[\p{L}\p{N}]+"
#: Terms up to this many, and this many characters, go into one automaton in every worker; beyond that they are joined.
MOST_TERMS, MOST_CHARS = 200_000, 8_000_000
_FOUND = "array<struct<start: int, size: int, term: string, value: string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("term", pa.string()), ("value", pa.string())]))
_built: dict[str, ahocorasick.Automaton] = {}


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def _key(text: Column) -> Column:
    """The words of words_of with single spaces, in one pass without an array of them."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", " ")))


def leftmost_longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, size, which) those met from the left, the longest at each start, none over another."""
    kept, end = [], 0
    for start, size, which in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= end:
            kept.append((start, size, which))
            end = start + size
    return kept


def _automaton(name: str, terms: Iterable[str]) -> ahocorasick.Automaton:
    """The terms' automaton, built once a worker; the last one only is kept."""
    if name not in _built:
        _built.clear()
        machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            machine.add_word(f" {term} ", (i, term.count(" ") + 1))
        if len(machine):
            machine.make_automaton()
        _built[name] = machine
    return _built[name]


def _places(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    text = f" {text} "
    hits = list(machine.iter(text)) if len(machine) else []
    if not hits:
        return []
    gaps = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    ends = np.searchsorted(gaps, [at for at, _ in hits]).tolist()  # words before the gap that closes a hit
    return leftmost_longest([(end - size, size, i) for end, (_, (i, size)) in zip(ends, hits, strict=True)])


def find_terms(rows: DataFrame, terms: DataFrame, text: str = "text", into: str = "found", most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """rows with one more column, the places of terms (term, value) in a text: array<struct<start, size, term, value>>, by start.

    start and size count words from 0; term is written as its words with single spaces. Of terms with equal words the smallest
    value counts; terms without words and null ones are passed over. Null and empty texts hold nothing; texts are read whole,
    repeated rows each. Up to most_terms terms of most_chars characters in all, every worker searches by one Aho-Corasick
    automaton and nothing is shuffled. Beyond either, all word sequences of the terms' sizes meet the terms by a join, with
    the same result; terms are unique there, so a sequence that very many texts hold can be split by adaptive execution.
    """
    spark = rows.sparkSession
    unique = terms.select(_key(F.col("term")).alias("term"), F.col("value").cast("string").alias("value")).where("term <> ''").groupBy("term").agg(F.min("value").alias("value"))
    size = unique.select(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size.n <= most_terms and size.chars <= most_chars:
        shared, name = spark.sparkContext.broadcast([(r.term, r.value) for r in unique.collect()]), uuid.uuid4().hex

        @F.arrow_udf(_FOUND)
        def found(texts: pa.Array) -> pa.Array:
            machine = _automaton(name, [t for t, _ in shared.value])
            return _in_slices(lambda part: [_places(t, machine) for t in part.to_pylist()], texts, _columns(shared.value))

        return rows.withColumn(into, found(_key(F.col(text))))
    return _joined(rows, unique, text, into)


#: Texts that are searched together: bounds a worker's memory, as places are Python objects only until a slice is done.
SLICE = 128


def _columns(terms: list[tuple[str, str | None]]) -> tuple[pa.Array, pa.Array]:
    return pa.array([t for t, _ in terms], pa.string()), pa.array([v for _, v in terms], pa.string())


def _in_slices(search: Callable[[pa.Array], list[list[tuple[int, int, int]]]], texts: pa.Array, terms: tuple[pa.Array, pa.Array]) -> pa.Array:
    """_FOUND of the (start, size, which of the terms) that search gives for each text of a slice."""
    parts = [_structs(search(texts.slice(i, SLICE)), terms) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)


def _structs(found: list[list[tuple[int, int, int]]], terms: tuple[pa.Array, pa.Array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int32, 3 * int(ends[-1])).reshape(-1, 3)
    which = pa.array(flat[:, 2])
    values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), terms[0].take(which), terms[1].take(which)], fields=list(_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=_ARROW)


#: Bits of the filter that a text's word sequences pass before they meet the terms (8 MB); terms set one each, so ten million set an eighth.
FILTER_BITS = 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, computed once for equal ones."""
    known = words.dictionary_encode()
    bits = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known.dictionary.to_pylist()]
    return np.array(bits, np.uint64)[known.indices.to_numpy()]


def _bits(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The filter's bit of each sequence of n words from starts on."""
    mixed = np.zeros(len(starts), np.uint64)
    for k in range(n):
        mixed = (mixed ^ hashes[starts + k]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(FILTER_BITS)).astype(np.int64)


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ends of the texts' words, each word's text, words) of texts that are words with single spaces; an empty text is one empty word."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.cumsum(counts), np.repeat(np.arange(len(texts)), counts), words


def _filter_of(terms: DataFrame) -> tuple[list[int], np.ndarray]:
    """(the terms' sizes, the filter's bits as bytes): of fixed size, set by the partitions' distinct bits."""

    @F.arrow_udf("bigint")
    def bit(texts: pa.Array) -> pa.Array:
        ends, _, words = _cut(texts)
        counts = np.diff(np.concatenate(([0], ends)))
        hashes, out = _hashes(words), np.zeros(len(texts), np.int64)
        for n in np.unique(counts).tolist():
            at = np.flatnonzero(counts == n)
            out[at] = _bits(hashes, ends[at] - n, n)
        return pa.array(out)

    sizes = sorted(r.n for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect())  # sizes of terms: few
    words = terms.select(bit("term").alias("bit")).select(F.expr("bit div 32768").alias("word"), (F.col("bit") % 32768).alias("at"))
    set_ = np.zeros(FILTER_BITS, bool)
    for r in words.groupBy("word").agg(F.collect_set(F.col("at").cast("int")).alias("at")).toLocalIterator():  # at most 2048 rows
        set_[r.word * 32768 + np.array(r["at"])] = True
    return sizes, np.packbits(set_, bitorder="little")


def _joined(rows: DataFrame, unique: DataFrame, text: str, into: str) -> DataFrame:
    """The same by a join of the texts' word sequences with the terms; equal texts are searched once.

    Sequences that no term's bit in a filter of fixed size fits are left out where texts are read; the join decides on all others.
    """
    sizes, packed = _filter_of(unique)
    shared = rows.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("array<struct<start: int, size: int, term: string>>")
    def likely(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("term", pa.string())]))
        parts = [_likely(texts.slice(i, SLICE), sizes, shared.value, kind) for i in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    marked = rows.withColumn("_text", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    cut = marked.select("_text", likely(_key(F.col(text))).alias("x")).dropDuplicates(["_text"])
    met = cut.select("_text", F.explode("x").alias("x")).select("_text", "x.*").join(unique, "term").groupBy("_text").agg(F.collect_list(F.struct("start", "size", "term", "value")).alias("_met"))

    @F.arrow_udf(_FOUND)
    def kept(column: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(column), SLICE):
            lists = column.slice(i, SLICE)
            flat = lists.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            found = [leftmost_longest(list(zip(start[a:b].tolist(), size[a:b].tolist(), range(a, b), strict=True))) for a, b in pairwise([0, *ends.tolist()])]
            parts.append(_structs(found, (flat.field("term"), flat.field("value"))))
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    out = marked.join(met.select("_text", kept("_met").alias(into)), "_text", "left")
    return out.withColumn(into, F.coalesce(into, F.array().cast(_FOUND))).select(*rows.columns, into)


def _likely(texts: pa.Array, sizes: list[int], packed: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends, owner, words = _cut(texts)
    hashes, first = _hashes(words), np.concatenate(([0], ends))
    at, size, terms = [], [], []
    for n in sizes:
        starts = np.flatnonzero(np.arange(len(words)) + n <= ends[owner])
        bits = _bits(hashes, starts, n)
        starts = starts[(packed[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
        at.append(starts)
        size.append(np.full(len(starts), n))
        terms.append(pc.binary_join_element_wise(*[words.take(pa.array(starts + k)) for k in range(n)], " "))
    if not sizes:
        return pa.array([[]] * len(texts), kind)
    where = np.concatenate(at)
    order = np.argsort(where, kind="stable")
    where = where[order]
    per_text = np.bincount(owner[where], minlength=len(texts))
    values = pa.StructArray.from_arrays([pa.array((where - first[owner[where]]).astype(np.int32)), pa.array(np.concatenate(size)[order].astype(np.int32)), pa.concat_arrays(terms).take(pa.array(order))], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32()), values, type=kind)


def rewrite_terms(rows: DataFrame, terms: DataFrame, text: str = "text", into: str = "rewritten", **limits: int) -> DataFrame:
    """rows with one more column, the text with the places of terms (term, value) replaced by their values; see find_terms.

    All else stays as it is, letter case and marks included; a null value removes the term. Null texts stay null.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    out = find_terms(rows, terms, text, "_found", **limits).withColumn("_pieces", pieces)
    shift = F.when(F.col(text).rlike(rf"^{WORD}"), 1).otherwise(2)  # the first word's piece
    found = F.col("_found")

    def part(i: Column) -> Column:
        before, here = F.get(found, i - 1), F.get(found, i)
        begin = F.when(i == 0, 1).otherwise(2 * (before["start"] + before["size"] - 1) + shift + 1)
        end = F.when(i == F.size(found), F.size("_pieces") + 1).otherwise(2 * here["start"] + shift)
        return F.concat(F.array_join(F.slice("_pieces", begin, end - begin), ""), F.coalesce(here["value"], F.lit("")))

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.size(found)), part), "")
    return out.withColumn(into, F.when(F.size(found) == 0, F.col(text)).otherwise(whole)).drop("_found", "_pieces")


def counted_by_value(found: Column) -> Column:
    """map of a value (the list that a term belongs to) to the number of its distinct terms in a text."""
    pairs = F.transform(F.filter(found, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["value"].alias("value"), x["term"].alias("term")))
    distinct = lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))

    def counted(rows: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(rows)), lambda i: (i < F.size(rows)) & ((i == 0) | (F.get(rows, i)["value"] != F.get(rows, i - 1)["value"])))
        return let(starts, lambda at: F.map_from_entries(F.transform(at, lambda i, k: F.struct(F.get(rows, i)["value"], F.coalesce(F.get(at, k + 1), F.size(rows)) - i))))

    return let(F.array_sort(pairs), lambda s: let(distinct(s), counted))
