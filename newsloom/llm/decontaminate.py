"""Benchmark passages in training documents, found by winnowing fingerprints.

The span to be found is SPAN words. Of the SPAN - GRAM + 1 hashes of GRAM consecutive words in it the smallest is its fingerprint (the
rightmost among equals), so a winnowing window and a span of SPAN words are one and the same: a span that a document shares with an
item has one fingerprint in both, wherever it stands. An item of fewer than SPAN words is one span, and its own fingerprint.

1. the items' spans and fingerprints are a table; which hashes occur is put into a bitmap of fixed size;
2. documents keep the fingerprints of which the bitmap knows the hash, with the spans that chose each, and join the items' ones;
3. a hit is extended over the spans that chose it: those that the items have (by their own 64-bit hashes) cover the hit words.

Neither join multiplies rows: both meet distinct keys. Items come in at the end, once for each document and span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import broadcast_if_small, lean, stored, workers_import
from newsloom.llm.shingles import combine
from newsloom.llm.textbytes import PLAIN_WORDS, Words, word_runs

#: Words of a span that must be found wherever it is shared; words of a fingerprint's hash.
SPAN, GRAM = 10, 5
#: The bitmap has 2 ** BITS bits, at any size of the benchmark. A full one lets more through to the join, never less.
BITS = 23
#: The items' distinct fingerprints or spans up to this many rows (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def spans(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, fingerprint, place) of every span of size words inside one document; starts and places count the run's words.

    place is the first word of the chosen hash, so spans in a row with one place made one choice. Spans shorter than SPAN are
    their own fingerprints.
    """
    h = words.hashes()
    of = words.document()
    n = max(0, len(h) - size + 1)
    start = np.flatnonzero(of[:n] == of[size - 1 : size - 1 + n])
    whole = combine(h, size)[start]
    if size < SPAN:
        return start, whole, whole, start
    grams = combine(h, GRAM)
    best, place = grams[:n].copy(), np.arange(n)
    for i in range(1, size - GRAM + 1):
        later = grams[i : i + n]
        np.copyto(place, np.arange(i, i + n), where=later <= best)
        np.minimum(best, later, out=best)
    return start, whole, best[start], place[start]


_ITEM_SPANS = "item_id string, words int, span long, fingerprint long"


def _item_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_runs(batch.column(1), PLAIN_WORDS):
            names = batch.column(0).slice(words.rows.start, len(words.count))
            of = words.document()
            for size in sorted(set(np.minimum(words.count, SPAN).tolist()) - {0}):
                start, whole, chosen, _ = spans(words, size)
                if size < SPAN:  # only the items of just so many words
                    here = words.count[of[start]] == size
                    start, whole, chosen = start[here], whole[here], chosen[here]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of[start])), pa.array(np.full(len(start), size, np.int32)), pa.array(whole.view(np.int64)), pa.array(chosen.view(np.int64))], names=["item_id", "words", "span", "fingerprint"])


def item_spans(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id (as text), words, span and fingerprint (hashes) of every span of every item; items without an id or words have none."""
    workers_import(items.sparkSession)
    rows = items.select(F.col(id_column).cast("string").alias("item_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).where("item_id is not null")
    return rows.mapInArrow(lean(_item_spans), _ITEM_SPANS)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Which of the 2 ** BITS leading bit patterns occur; as many words reach the driver at most as the bitmap has."""
    lead = F.shiftrightunsigned(F.col(column), 64 - BITS)
    found = hashes.select(F.shiftright(lead, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), lead.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint8)


_CANDIDATES = "h1 long, h2 long, id long, n_words long, hits array<struct<words int, fingerprint long, start int, spans array<long>>>"


def _candidates(sizes: list[int], bits: np.ndarray):
    """For each document its words, and the fingerprints that may be items' with the spans that chose them."""

    def known(hashes: np.ndarray) -> np.ndarray:
        lead = hashes >> np.uint64(64 - BITS)
        return (bits[(lead >> np.uint64(3)).astype(np.intp)] >> (lead & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(batch.column(3), PLAIN_WORDS):
                of, lists, owner = words.document(), [], []
                for size in sizes:
                    start, whole, chosen, place = spans(words, size)
                    at = np.flatnonzero(known(chosen))
                    start, whole, chosen, place = start[at], whole[at], chosen[at], place[at]
                    # spans of one choice follow each other
                    new = np.ones(len(at), bool)
                    new[1:] = (place[1:] != place[:-1]) | (of[start[1:]] != of[start[:-1]]) | (np.diff(at) > 1)
                    lead = np.flatnonzero(new)
                    owner.append(of[start[lead]])
                    lists.append((np.full(len(lead), size, np.int32), chosen[lead].view(np.int64), (start - words.first[of[start]])[lead].astype(np.int32), np.diff(np.append(lead, len(at))), whole.view(np.int64)))
                yield _rows(batch, words, owner, lists)

    return run


def _rows(batch: pa.RecordBatch, words: Words, owner: list[np.ndarray], lists: list[tuple]) -> pa.RecordBatch:
    n, base = len(words.count), words.rows.start
    who = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(who, kind="stable")
    size, chosen, start, count, whole = (np.concatenate([x[k] for x in lists]) if lists else np.zeros(0, np.int64) for k in range(5))
    edge = np.cumsum(np.append(0, count))
    moved = count[order]
    inner = np.cumsum(np.append(0, moved))
    place = np.repeat(edge[:-1][order] - inner[:-1], moved) + np.arange(int(inner[-1]))
    each = pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(whole[place].astype(np.int64)))
    hits = pa.StructArray.from_arrays([pa.array(size[order].astype(np.int32)), pa.array(chosen[order].astype(np.int64)), pa.array(start[order].astype(np.int32)), each], names=["words", "fingerprint", "start", "spans"])
    first = np.searchsorted(who[order], np.arange(n + 1)).astype(np.int32)
    columns = [batch.column(k).slice(base, n) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(first), hits)], names=["h1", "h2", "id", "n_words", "hits"])


def _covered(intervals: Column) -> Column:
    """Words in the union of sorted structs (start, words)."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        end = (x.start + x.words).cast("long")
        return F.struct(F.greatest(acc.end, end).alias("end"), (acc.total + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc.end, x.start.cast("long")))).alias("total"))

    return F.aggregate(intervals, zero, step, lambda acc: acc.total)


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_hit (words inside a span of SPAN words that an item has, or inside a whole shorter
    item), item_ids (array of the distinct ids, as text in their order, of items with a span in the document).

    Words are runs of letters, digits and everything outside ASCII, A-Z lower-cased. A null or empty text has no words and no hits;
    an item without an id or words hits nothing; repeated items count once; rows with a null id, and repeated rows, are judged each.
    Texts of any length are read whole. Without items no document is hit; an empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    workers_import(spark)
    known = stored(item_spans(items, item_column, item_text_column))
    sizes = sorted(r[0] for r in known.select("words").distinct().collect())  # SPAN numbers at most
    bits = bitmap(known, "fingerprint")
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = F.col(id_column).cast("long")
    # rows are told apart by 128 bits of id and text; equal rows have equal results
    rows = docs.select(F.xxhash64(own, text).alias("h1"), F.xxhash64(text, own).alias("h2"), own.alias("id"), text.alias("text"))
    base = stored(rows.mapInArrow(lean(_candidates(sizes, bits)), _CANDIDATES))

    each = base.where(F.size("hits") > 0).select("h1", "h2", F.explode("hits").alias("hit")).select("h1", "h2", "hit.*")
    fingerprints = broadcast_if_small(known.select("words", "fingerprint").distinct(), BROADCAST_ROWS)
    met = each.join(fingerprints, ["words", "fingerprint"], "left_semi")
    extended = met.select("h1", "h2", "words", "start", F.posexplode("spans").alias("step", "span")).withColumn("start", F.col("start") + F.col("step")).drop("step")
    shared = stored(extended.join(broadcast_if_small(known.select("words", "span").distinct(), BROADCAST_ROWS), ["words", "span"], "left_semi"))
    key = ["h1", "h2"]
    covered = shared.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "words"))).alias("intervals")).select(*key, _covered(F.col("intervals")).alias("n_hit"))
    of_items = broadcast_if_small(known.select("words", "span", "item_id").distinct(), BROADCAST_ROWS)
    named = shared.select(*key, "words", "span").distinct().join(of_items, ["words", "span"]).groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = base.select("id", "n_words", *key).join(covered, key, "left").join(named, key, "left")
    return out.select(F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
