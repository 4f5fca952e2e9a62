"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.runtime import broadcast_if_small, checkpointed, lower_ascii, maybe_ids, shared_folder, stored

#: Characters of the prefix that the second refinement hashes.
PREFIX = 256
#: Groups up to this many are broadcast (some 100 bytes each of the driver's memory); more are joined by a shuffle, hot groups split by Spark.
BROADCAST_GROUPS = 200_000
#: Ids of survivors up to this many are broadcast to pick their texts; more are joined by a shuffle, behind a filter.
BROADCAST_IDS = 200_000


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of equal texts the largest id
    stays; a null id ranks below every other. Rows that repeat an id with equal texts all count in group_size and all are kept
    if that id is. An empty table gives no rows. Other columns are not read, whatever their names.

    Refinement: (1) rows whose byte length occurs once are done; (2) of the rest, rows whose (length, prefix hash) occurs once
    are done; (3) only the survivors' full text is hashed, and SHA-256 groups them. text_sha256 is null for rows that were done
    early, unless digest_all asks for every digest; then digests are taken in the first pass over the texts, and the refinement
    decides which of them are grouped. (1) and (2) work on a stored table of ids, lengths and prefix hashes, so no text is
    shuffled; survivors' texts are read again by id. Counts are summed before every shuffle, so a huge group is one row a task.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    length, digest = F.octet_length("text").alias("length"), F.sha2(lower_ascii(F.col("text")), 256).alias("sha")
    prefix = F.xxhash64(lower_ascii(F.substring("text", 1, PREFIX))).alias("prefix")
    narrow = stored(rows.select("id", length, prefix, digest if digest_all else F.lit(None).cast("string").alias("sha")))
    lengths = checkpointed(narrow.groupBy("length").count().where("count > 1").select("length"))
    again = narrow.join(broadcast_if_small(lengths, BROADCAST_GROUPS), "length", "left_semi")
    prefixes = checkpointed(again.groupBy("length", "prefix").count().where("count > 1").select("length", "prefix"))
    alive = again.join(broadcast_if_small(prefixes, BROADCAST_GROUPS), ["length", "prefix"], "left_semi").select("id", "length", "sha")
    every = narrow.select("id", "length", "sha")
    if not digest_all:
        ids = checkpointed(alive.select(F.col("id").alias("alive_id")).distinct())
        named = broadcast_if_small(ids, BROADCAST_IDS)
        texts = rows if named is not ids else maybe_ids(rows, ids.withColumnRenamed("alive_id", "id"), "id").where("_maybe")
        alive = stored(texts.join(named, texts.id.eqNullSafe(F.col("alive_id")), "left_semi").select("id", length, digest))
        every = alive.union(every.join(named, every.id.eqNullSafe(F.col("alive_id")), "left_anti"))
    groups = alive.groupBy("length", "sha").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    groups = checkpointed(groups.select(F.col("length").alias("g_length"), F.col("sha").alias("g_sha"), "keep", "n"))
    out = every.join(groups, (F.col("length") == F.col("g_length")) & (F.col("sha") == F.col("g_sha")), "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_column), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
