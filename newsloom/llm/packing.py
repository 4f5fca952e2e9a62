"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Pieces of one length are interchangeable, and so are sequences with one gap, so a round works on runs: free sequences (gap, first,
n: so many sequences from the first on have that gap) and waiting pieces (length, each, n: n bundles of `each` pieces of that
length). There are at most `capacity` lengths and gaps however many documents there are. A round:

1. Runs are range-partitioned by size. Each range is swept from the largest size down, a gap before the pieces of its size: a
   bundle's successor is the smallest free gap that holds it.
2. Conflicts: of bundles that want the same gaps the longest come first, and take a range of ranks among the sequences of that gap.
   What finds no gap in its range is swept once more with the gaps that the ranges above have left; the rest waits.
3. Gaps that got a bundle shrink, and the next round begins. Where sequences have room for several of the longest pieces left,
   pieces go in bundles, so that the number of rounds grows with the logarithm of the capacity (12 to 25 for 2048).

When no gap holds the shortest piece left, as many sequences are opened as the tokens left fill. The driver sees four numbers of a
round. In the end Spark ranks the pieces of each length (a common length is split over salted groups), and each piece finds its
sequence and offset by its length and rank.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from newsloom.llm.runtime import checkpointed, lean, shared_folder, shuffle_partitions, stored, workers_import
from newsloom.llm.word_ids import encoded_runs

CAPACITY = 2048
#: Pieces of one length that are ranked in one group at least, before the length is split.
RANKED = 200
#: Ranges of sizes that are swept side by side.
RANGES = 16


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, first in encoded_runs(batch.column(1), tokenizer):
                ids = np.insert(ids, first[1:], end_id).astype("<u4")
                first = first + np.arange(len(first))
                count = np.diff(first)
                parts = -(-count // capacity)
                doc = np.repeat(np.arange(len(count)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, count[doc] - start)
                at = first[doc] + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                names = batch.column(0).slice(rows.start, len(count)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([names, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Each text's ids are followed by end_id; only longer ones are cut."""
    workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(_pieces(tokenizer, end_id, capacity), "words"), f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_column)


def _before(of: str, window: Window) -> Column:
    return F.coalesce(F.sum(of).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


#: Runs: gap and first of free sequences, length and each of waiting bundles, all four of a bundle that has its sequences.
_RUNS = "gap long, first long, n long, length long, each long"


def _sweep(_key: tuple, table: pa.Table) -> pa.Table:
    """Runs of one range to runs: bundles that find a gap get its sequences, what is left over comes back."""
    rows = table.select(["gap", "first", "n", "length", "each"]).to_pylist()
    done = [tuple(r.values()) for r in rows if r["gap"] is not None and r["length"] is not None]
    line = [(-r["gap"], 0, r["first"], 0, r["n"]) for r in rows if r["length"] is None]
    line += [(-r["length"] * r["each"], 1, -r["length"], r["each"], r["n"]) for r in rows if r["gap"] is None]
    free: list[list[int]] = []  # the last is the smallest
    for size, waiting, name, each, n in sorted(line):
        if not waiting:
            free.append([-size, name, n])
            continue
        while n and free:
            gap, first, many = free[-1]
            taken = min(n, many)
            done.append((gap, first + many - taken, taken, -name, each))
            n -= taken
            free[-1][2] -= taken
            if many == taken:
                free.pop()
        if n:
            done.append((None, None, n, -name, each))
    done += [(gap, first, n, None, None) for gap, first, n in free]
    return pa.table({c: pa.array([r[k] for r in done], pa.int64()) for k, c in enumerate(("gap", "first", "n", "length", "each"))})


def _items(left: DataFrame, most: int) -> DataFrame:
    """What a round places: bundles of `most` pieces of a length, and the rest in bundles of 1, 2, 4 ... pieces."""
    rest = F.col("n") % most
    bundles = [F.struct(F.lit(most).cast("long").alias("each"), F.floor(F.col("n") / most).alias("n"))]
    if most > 1:
        bundles += [F.struct(F.lit(1 << b).cast("long").alias("each"), F.shiftright(rest, b).bitwiseAND(F.lit(1).cast("long")).alias("n")) for b in range((most - 1).bit_length())]
    items = left.select("length", F.explode(F.array(*bundles)).alias("x"))
    none = F.lit(None).cast("long")
    return items.select(none.alias("gap"), none.alias("first"), F.col("x.n").alias("n"), "length", F.col("x.each").alias("each")).where("n > 0")


def place_runs(counts: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """(length, rank, n, each, sequence, offset) of all pieces, from how many pieces have each length: counts (length, n).

    A row puts the pieces of its length with ranks rank to rank + n * each - 1 into sequences sequence to sequence + n - 1, each
    piece after the other from the offset on.
    """
    spark = counts.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    size = F.coalesce(F.col("length") * F.col("each"), F.lit(0).cast("long"))
    state = counts.select(F.lit(None).cast("long").alias("gap"), F.lit(None).cast("long").alias("first"), F.col("n").cast("long"), F.col("length").cast("long"), F.lit(1).cast("long").alias("each"))
    opened, turn = 0, 0
    while True:
        about = Observation()
        waits = F.col("gap").isNull()
        figures = [F.min(F.when(waits, F.col("length"))).alias("least"), F.max(F.when(waits, F.col("length"))).alias("most"), F.sum(F.when(waits, F.col("n") * size)).alias("tokens"), F.max(F.col("gap") - size).alias("room")]
        state.observe(about, *figures).write.parquet(f"{folder}/{turn}")
        state = spark.read.schema(_RUNS).parquet(f"{folder}/{turn}")
        least, most, tokens, room = (about.get.get(k) for k in ("least", "most", "tokens", "room"))
        if least is None:
            break
        if least < 1 or most > capacity:
            raise ValueError("a piece is empty or longer than a sequence")
        free = state.where("gap is not null").select((F.col("gap") - size).alias("gap"), "first", "n", F.lit(None).cast("long").alias("length"), F.lit(None).cast("long").alias("each")).where(F.col("gap") >= least)
        if (room or 0) < least:
            many, room = -(-tokens // capacity), capacity
            free = spark.createDataFrame([(capacity, opened, many, None, None)], _RUNS)
            opened += many
        left = state.where("gap is null").groupBy("length").agg(F.sum(F.col("n") * F.col("each")).alias("n"))
        runs = free.union(_items(left, max(1, room // most)))
        ranged = runs.withColumn("range", F.floor(F.coalesce("gap", F.col("length") * F.col("each")) * ranges / (capacity + 1)))
        state = ranged.groupBy("range").applyInArrow(_sweep, _RUNS).withColumn("range", F.lit(0)).groupBy("range").applyInArrow(_sweep, _RUNS)
        turn += 1
    placed = spark.read.schema(f"{_RUNS}").parquet(*[f"{folder}/{k}" for k in range(turn + 1)])
    placed = placed.where("gap is not null and length is not null").withColumn("pieces", F.col("n") * F.col("each"))
    rank = _before("pieces", Window.partitionBy("length").orderBy("first", F.desc("gap")))
    return placed.select("length", rank.alias("rank"), "n", "each", F.col("first").alias("sequence"), (capacity - F.col("gap")).alias("offset"))


def assign(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """pieces (id, piece, length and more) with sequence_id and offset; offsets of a sequence are gapless from 0.

    Lengths must be 1 to capacity. Equal rows, repeated and null ids are pieces like others; ties of rank fall either way, the
    packing is right for each. An empty table gives no rows.
    """
    pieces = stored(pieces)
    counts = checkpointed(pieces.groupBy("length").agg(F.count("*").alias("n")))  # at most capacity rows
    runs = place_runs(counts, capacity).groupBy(F.col("length").alias("of")).agg(F.sort_array(F.collect_list(F.struct("rank", "n", "each", "sequence", "offset"))).alias("runs"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    group = max(RANKED, total // (8 * shuffle_partitions(pieces.sparkSession)))
    salted = pieces.join(F.broadcast(counts.select(F.col("length").alias("c_length"), F.ceil(F.col("n") / group).alias("salts"))), F.col("length") == F.col("c_length"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(id_column, "piece", "start", "ids_crc32") if "ids_crc32" in pieces.columns else F.xxhash64(id_column, "piece"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").count()
    bases = checkpointed(sizes.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), _before("count", Window.partitionBy("length").orderBy("salt")).alias("base")))
    ranked = salted.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_column, "piece")) - 1)
    # as many groups as lengths and a few for each shuffle partition
    ranked = ranked.join(F.broadcast(bases), (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("at", F.col("base") + F.col("inside")).join(F.broadcast(checkpointed(runs)), F.col("length") == F.col("of"))
    run = F.element_at(F.filter("runs", lambda x: (x.rank <= F.col("at")) & (F.col("at") < x.rank + x.n * x.each)), 1)
    placed = ranked.withColumn("run", run).withColumn("nth", F.col("at") - F.col("run.rank"))
    sequence, offset = F.col("run.sequence") + F.floor(F.col("nth") / F.col("run.each")), F.col("run.offset") + F.col("length") * (F.col("nth") % F.col("run.each"))
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All documents packed: one row per piece with id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Rows that repeat an id, rows without an id and equal rows are packed
    each. Only the two named columns are read, whatever other columns are called. An empty table gives no rows.
    """
    return assign(cut_pieces(docs, tokenizer, end_id, capacity, id_column, text_column), capacity, id_column)
