"""What the operators need of a session: the shared folder, stored intermediate tables, and workers that find this package."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.runtime import broadcast_if_small, checkpointed, shared_folder, stored

__all__ = ["broadcast_if_small", "checkpointed", "id_ranges", "lean", "lower_ascii", "maybe_ids", "only_ids", "shared_folder", "shuffle_partitions", "stored", "without_ids", "workers_import"]

#: Ids up to this many are broadcast (some 100 bytes each of the driver's memory); more pass a filter of 2 ** FILTER_BITS bits first.
BROADCAST_IDS, FILTER_BITS = 200_000, 24

_ROOT = str(Path(__file__).resolve().parents[2])


def workers_import(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it (a cluster has it installed in the same place)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Texts without other characters take the fast way."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def id_ranges(docs: DataFrame, ranges: int) -> tuple[Column, list[int], int | None]:
    """(number, ends, top): the range of a row by its column id, the largest id of every range but the last, the largest of all.

    Ends are quantiles of the ids (a sketch of bounded size reaches the driver), so ranges hold about as many rows each.
    """
    top = docs.agg(F.max("id")).first()[0]
    if top is None:
        return F.lit(0), [], None
    at = [k / ranges for k in range(1, ranges)]
    ends = sorted({int(x) for x in docs.where("id is not null").approxQuantile("id", at, 0.25 / ranges)} - {int(top)}) if at else []
    limits = F.array(*[F.lit(e) for e in ends]).cast("array<bigint>")
    return (F.size(F.filter(limits, lambda e: e < F.col("id"))) if ends else F.lit(0)), ends, int(top)


def maybe_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with the boolean _maybe: false only where the id is not in ids (a null is an id here). The filter is a table of at most 2 ** (FILTER_BITS - 6)
    words of 64 bits, however many ids there are, so the driver's memory for it is bounded."""
    bit = F.shiftrightunsigned(F.xxhash64(column), 64 - FILTER_BITS)
    word, mask = F.shiftright(bit, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = checkpointed(ids.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")))
    met = rows.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).select(*rows.columns, "_maybe")


def only_ids(rows: DataFrame, ids: DataFrame, column: str, most_rows: int | None = None) -> DataFrame:
    """rows whose column is in ids (one column of that name, computed once). Few ids are broadcast; else rows that pass the filter are shuffled."""
    few = broadcast_if_small(ids, BROADCAST_IDS if most_rows is None else most_rows)
    if few is not ids:
        return rows.join(few, column, "left_semi")
    return maybe_ids(rows, ids, column).where("_maybe").drop("_maybe").join(ids, column, "left_semi").select(rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, column: str, most_rows: int | None = None) -> DataFrame:
    """rows whose column is not in ids, or null. Few ids are broadcast; else only rows that pass the filter are shuffled, and rows are read twice."""
    few = broadcast_if_small(ids, BROADCAST_IDS if most_rows is None else most_rows)
    if few is not ids:
        return rows.join(few, column, "left_anti").select(rows.columns)
    marked = maybe_ids(rows, ids, column)
    doubtful = marked.where("_maybe").drop("_maybe").join(ids, column, "left_anti").select(rows.columns)
    return marked.where("not _maybe").drop("_maybe").unionByName(doubtful)


_TABLES: dict[str, dict] = {}


def worker_tables(kind: str) -> dict:
    """A place for tables of one kind that outlive a task of a worker, until a task comes that does not use the kind."""
    return _TABLES.setdefault(kind, {})


def keep_only(kind: str | None) -> None:
    for name, tables in _TABLES.items():
        if name != kind and tables:
            tables.clear()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, without the tables of other kinds of tasks, and then the worker's free memory given back: workers stay for later tasks,
    and their memory counts as the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
