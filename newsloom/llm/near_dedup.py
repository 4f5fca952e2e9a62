"""MinHash near-duplicate detection with odd sketches.

Method: each document's set of five-word shingles gives 32 bands of 4 MinHash values (a pair at similarity 0.75 shares no band
with probability 5e-6) and an odd sketch: 256 MinHash samples folded into 512 parity bits, whose XOR with another sketch has a
population count that tells the similarity. Documents with equal sets are one class from the start, so copies never meet each
other. Candidates come in three steps:

1. every member of a band with the band's smallest id; links are confirmed on full sets and joined to components. This is linear
   in the members of a band, and settles bands of near copies however large they are;
2. in bands of at most BLOCK members that still hold several components: pairs across components, inside one task;
3. larger bands that still hold several components are crowds that share a passage and little else. Their members are met by the
   rarest of their shingles instead: of two sets of similarity t, the first n - ceil(t n) + 1 shingles of each, in any order
   common to all sets, share one. The order is by a frequency sketch of bounded size, so the common passage comes last and is
   met by hardly anyone; no link is lost by it. Groups of a shingle that hold several components are compared as in step 2; one
   above BLOCK is dealt out to pairs of blocks. Work is linear in the members' shingles but for such groups, whose pairs are
   compared by their sketches.

Pairs pass a sketch bound five standard deviations below similarity 0.75 and are then decided on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import broadcast_if_small, checkpointed, lean, only_ids, shuffle_partitions, stored, workers_import
from newsloom.llm.shingles import MinHash, shingle_sets
from newsloom.llm.textbytes import mix
from newsloom.operators.components import components

#: Bits in which the sketches of two sets of similarity 0.75 may differ: mean 98 and five standard deviations of 9.7.
SKETCH_BOUND = 147
#: Members of a block inside a large band; documents whose sets meet in one confirming group, on average.
BLOCK = 512
SET_BLOCK = 4096
#: Keys of large bands or groups up to this many are broadcast; above, all rows are shuffled by their key.
BROADCAST_KEYS = 200_000
#: Asking documents of one confirming group, on average; counters of the frequency sketch (8 bytes each).
ASKS, COUNTERS = 8192, 1 << 18


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinHash()
        for batch in batches:
            ids = batch.column(0)
            for rows, hashes, first in shingle_sets(batch.column(1), size):
                n = np.diff(first)
                full = np.flatnonzero(n)
                bands = np.zeros((len(n), hashing.bands), np.int64)
                sketch = np.zeros((len(n), hashing.sketch_bits // 64), np.int64)
                key = np.zeros((2, len(n)), np.int64)
                if len(full):
                    minima = hashing.minima(hashes, np.r_[first[:-1][full], len(hashes)])
                    bands[full] = hashing.band_keys(minima).view(np.int64)
                    sketch[full] = hashing.odd_sketches(minima).view(np.int64)
                    start = first[:-1][full]
                    with np.errstate(over="ignore"):
                        key[0, full] = np.add.reduceat(mix(hashes + np.uint64(1)), start).view(np.int64)
                        key[1, full] = np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), start).view(np.int64)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(rows.start, len(n)), pa.array(n), pa.array(key[0]), pa.array(key[1]), lists(bands), lists(sketch)], names=["id", "n", "key1", "key2", "bands", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, hashes, first in shingle_sets(batch.column(1), size):
                packed = pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(packed)), packed], names=["id", "items"])

    return run


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes + np.uint64(7)) % np.uint64(COUNTERS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task for the frequency sketch of the sets' shingles."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for items in batch.column(1):
            np.add.at(counts, _slots(np.frombuffer(items.as_buffer(), np.uint64)), 1)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], names=["slot", "n"])


def _rarest(frequency: Broadcast, percent: int):
    """(id, key): the shingles by which a set must meet every other of the wanted similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                items = np.frombuffer(items.as_buffer(), np.uint64)
                order = np.lexsort((items, frequency.value[_slots(items)]))
                first = items[order[: len(items) + percent * -len(items) // 100 + 1]]  # n - ceil(t n) + 1
                ids.append(np.full(len(first), i))
                keys.append(first.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["id", "key"])

    return run


def _sketches_agree(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (bits <= SKETCH_BOUND)


def _across(percent: int):
    """From rows sorted by (key, i, j): pairs of different labels that may be similar, packed by asking document and the home of
    the others. Rows without u list the others of a flush once, so that their texts can be picked without all pairs."""

    def pairs(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        left = rows["block"] == rows["i"]
        right = rows["block"] == rows["j"]
        one = rows["i"][0] == rows["j"][0]
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        found = []
        for k in range(0, len(a), 256):
            x = a[k : k + 256]
            near = rows["label"][x][:, None] != rows["label"][b][None, :]
            if one:
                near &= x[:, None] < b[None, :]
            n, m = rows["n"][x][:, None], rows["n"][b][None, :]
            near &= np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            p, q = np.nonzero(near)
            for c in range(0, len(p), 1 << 17):
                u, v = x[p[c : c + (1 << 17)]], b[q[c : c + (1 << 17)]]
                ok = np.bitwise_count(rows["sketch"][u] ^ rows["sketch"][v]).sum(1) <= SKETCH_BOUND
                found.append(np.stack([u[ok], v[ok]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        u, v = np.concatenate(found, 1)
        _, where, size = np.unique(rows["label"], return_inverse=True, return_counts=True)
        swap = size[where[u]] > size[where[v]]  # the rarer label asks
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        return rows["id"][u], rows["home"][v], rows["id"][v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table, last: bool) -> tuple[list[tuple[np.ndarray, ...]], pa.Table | None]:
            cols = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "id", "n", "label", "home")}
            cols["sketch"] = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            new = np.flatnonzero(np.r_[True, (cols["key"][1:] != cols["key"][:-1]) | (cols["i"][1:] != cols["i"][:-1]) | (cols["j"][1:] != cols["j"][:-1])])
            ends = np.r_[new[1:], table.num_rows]
            if not last:
                new, ends = new[:-1], ends[:-1]
            out = [pairs({c: v[a:b] for c, v in cols.items()}) for a, b in zip(new, ends, strict=True)]
            return out, None if last else table.slice(int(ends[-1]) if len(ends) else 0)

        def packed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            found = [x for x in found if len(x[0])]
            if found:
                u, home, v = (np.concatenate([x[k] for x in found]) for k in range(3))
                order = np.lexsort((v, home, u))
                u, home, v = u[order], home[order], v[order]
                new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
                u, home, v = u[new], home[new], v[new]
                first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (home[1:] != home[:-1])])
                seen = np.unique(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array([*u[first].tolist(), None], pa.int64()), pa.array([*home[first].tolist(), None], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.r_[first, len(v), len(v) + len(seen)].astype(np.int32)), pa.array(np.r_[v, seen])),
                ], names=["u", "home", "others"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows >= 20_000:
                found, held = done(held, False)
                yield from packed(found)
        if held is not None and held.num_rows:
            yield from packed(done(held, True)[0])

    return run


def _confirm_block(percent: int):
    def run(_key, asks: pa.Table, sets: pa.Table) -> pa.Table:
        items = {i: np.frombuffer(b.as_buffer(), np.uint64) for i, b in zip(sets.column("id").to_pylist(), sets.column("items"), strict=True)}
        a, b = [], []
        for u, mine, others in zip(asks.column("u").to_pylist(), asks.column("mine"), asks.column("others"), strict=True):
            mine = np.frombuffer(mine.as_buffer(), np.uint64)
            for v in np.unique(others.values.to_numpy()).tolist():
                other = items.get(v)
                if other is None:
                    continue
                at = np.searchsorted(mine, other)
                at[at == len(mine)] = 0
                shared = int((mine[at] == other).sum())
                if 100 * shared >= percent * (len(mine) + len(other) - shared):
                    a.append(u)
                    b.append(v)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _set_table(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(id, items): the full sets of the documents in ids."""
    wanted = only_ids(texts, ids, "id").groupBy("id").agg(F.min("text").alias("text"))
    return stored(wanted.mapInArrow(lean(_sets(size)), "id long, items binary"))


def _confirm(asks: DataFrame, ids: DataFrame, texts: DataFrame, home: Column, size: int, percent: int) -> DataFrame:
    """The links (a, b) among packed candidates (u, home, others), decided on the full sets of the documents in ids.

    A home's documents meet those that ask for them; the askers of a home are dealt to groups of about ASKS, each with the home's sets.
    """
    sets = _set_table(checkpointed(ids.distinct()), texts, size)
    asks = checkpointed(asks.groupBy("u", "home").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")))  # at most a home's documents
    groups = checkpointed(asks.groupBy("home").agg(F.ceil(F.count("*") / ASKS).alias("groups")))
    groups = broadcast_if_small(groups)
    asks = asks.join(groups, "home").withColumn("group", F.pmod(F.xxhash64("u"), F.col("groups"))).drop("groups")
    asks = asks.join(sets.select(F.col("id").alias("u"), F.col("items").alias("mine")), "u")
    homes = sets.withColumn("home", home).join(groups, "home").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    return asks.groupBy("home", "group").cogroup(homes.groupBy("home", "group")).applyInArrow(_confirm_block(percent), "a long, b long")


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with the columns of keys (key, m and more). Rows of keys with more than BLOCK members meet them by a broadcast, where
    they lie, and only the others are shuffled by their key; above BROADCAST_KEYS such keys, all are."""
    hot = keys.where(F.col("m") > BLOCK)
    if not 0 < hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(keys, "key")
    few = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(keys.where(F.col("m") <= BLOCK), "key")
    return rows.join(F.broadcast(hot), "key").unionByName(few)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct size-word shingles (words are
    runs of non-white space, A-Z lower-cased; a text of fewer words is one shingle). component_id is the smallest id that links
    reach, and the document of that id is kept. A null or empty text has the empty set and is linked with nothing, not even its
    like. A row with a null id takes no part in links: component_id null, kept. Rows that repeat an id are one document, whose
    links are decided on its smallest text; each row is returned. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    workers_import(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = stored(texts.mapInArrow(lean(_signatures(size)), "id long, n long, key1 long, key2 long, bands array<long>, sketch array<long>"))
    able = signed.where("n > 0 and id is not null")
    classes = stored(able.groupBy("key1", "key2", "n").agg(F.min(F.struct("id", "bands", "sketch")).alias("x")).select("key1", "key2", "n", F.col("x.id").alias("id"), "x.bands", "x.sketch"))
    links = _links(classes, texts, size, percent)
    label = components(links)
    firsts = classes.select("key1", "key2", F.col("n").alias("n2"), F.col("id").alias("first"))
    named = firsts.join(label.withColumnRenamed("node", "first"), "first", "left").select("key1", "key2", "n2", F.coalesce("label", "first").alias("label"))
    named = checkpointed(named)
    rows = signed.select("id", "n", "key1", "key2")
    out = rows.join(named, (rows.key1 == named.key1) & (rows.key2 == named.key2) & (rows.n == named.n2) & rows.id.isNotNull(), "left")
    out = out.select("id", "n", F.coalesce("label", "id").alias("component"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that join the classes to the components of all confirmed links."""
    members = classes.select("id", F.explode("bands").alias("key"))
    shared = checkpointed(members.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1"))
    members = checkpointed(_met(members, shared))
    homes = max(1, -(-members.select(F.approx_count_distinct("id")).first()[0] // SET_BLOCK))
    home = F.pmod(F.xxhash64("id"), F.lit(homes))
    about = classes.select("id", "n", "sketch", home.alias("home"))

    # step 1: the band's smallest id asks every member
    first = members.where("id <> least").select("id", "least").distinct()
    first = first.join(about, "id").join(about.select(F.col("id").alias("least"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "least")
    first = first.where(_sketches_agree(F.col("sketch"), F.col("sketch2"), F.col("n"), F.col("n2"), percent))
    first = checkpointed(first.select(F.col("least").alias("u"), "home", "id"))
    ids = first.select("id").union(first.select("u"))
    links = checkpointed(_confirm(first.select("u", "home", F.array("id").alias("others")), ids, texts, home, size, percent))

    # step 2: across the components that a band still holds
    label = components(links)
    named = lambda rows: rows.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = checkpointed(named(members.select("key", "m", "id")))
    mixed = checkpointed(members.groupBy("key", "m").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "m"))
    inside = members.drop("m").join(mixed.where(F.col("m") <= BLOCK), "key")
    # step 3: crowds by their rarest shingles
    crowds = mixed.where(F.col("m") > BLOCK)
    if not crowds.isEmpty():
        crowd = checkpointed(_met(members.drop("m"), crowds).select("id").distinct())
        sets = _set_table(crowd, texts, size)
        frequency = np.zeros(COUNTERS, np.int64)
        counts = sets.mapInArrow(lean(_tally), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
        frequency[counts["slot"].to_numpy()] = counts["n"].to_numpy()
        spark = texts.sparkSession
        rare = stored(named(sets.mapInArrow(lean(_rarest(spark.sparkContext.broadcast(frequency), percent)), "id long, key long")))
        shared = rare.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        inside = inside.unionByName(_met(rare, checkpointed(shared.select("key", "m"))))
    inside = inside.join(about, "id")
    inside = inside.withColumn("blocks", F.ceil(F.col("m") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = inside.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "id", "n", "label", "sketch", "home")
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    packed = stored(dealt.mapInArrow(lean(_across(percent)), "u long, home long, others array<long>"))
    asks = packed.where("u is not null")
    ids = packed.where("u is null").select(F.explode("others").alias("id")).union(asks.select("u"))
    # what is linked already enters the last search for components as stars
    stars = label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return checkpointed(stars.union(_confirm(asks, ids, texts, home, size, percent)))
