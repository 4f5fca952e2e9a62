"""Bounded logs, registries, block lists, caches and corrections: the state that runs leave to one another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import broadcast_if_small


def bounded_append(old: DataFrame, new: DataFrame, group: str, at: str, asof: Column, max_age: str, newest: int, tie: str) -> DataFrame:
    """Both logs together, without rows older than max_age, and the newest rows of each group."""
    rows = old.unionByName(new).where(F.col(at) >= asof - F.expr(max_age))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_n", place).where(F.col("_n") <= newest).drop("_n")


def upsert_counts(old: DataFrame, new: DataFrame, key: Sequence[str], asof: Column, max_age: str) -> DataFrame:
    """Logs of (key, first, last, runs): first seen, last seen and how often; rows last seen before max_age go."""
    both = old.unionByName(new)
    merged = both.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("runs").alias("runs"))
    return merged.where(F.col("last") >= asof - F.expr(max_age))


def compact_history(titles: DataFrame, keys: DataFrame, asof: Column, days: int = 7, most_keys: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Titles of the last days, the first of each wording; and the greatest most_keys keys."""
    fresh = titles.where(F.col("t") >= asof - F.expr(f"INTERVAL {days} DAYS"))
    norm = F.lower(F.trim(F.regexp_replace("title", r"(?U)\s+", " ")))
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(norm).orderBy("t", "title"))).where("_n = 1").drop("_n")
    return first, keys.select("key").distinct().orderBy(F.desc("key")).limit(most_keys)


def without_seen(rows: DataFrame, seen: DataFrame, key: str, bypass: Column | None = None) -> DataFrame:
    """Rows whose key was not seen, and those that may pass anyway."""
    seen = broadcast_if_small(seen.select(key).distinct())
    if bypass is None:
        return rows.join(seen, key, "left_anti")
    marked = rows.join(seen.withColumn("_seen", F.lit(True)), key, "left")
    return marked.where(F.col("_seen").isNull() | bypass).drop("_seen")


def live_blocks(blocks: DataFrame, asof: Column, outages: Sequence[str] = (), most: int = 300) -> DataFrame:
    """The newest blocks that still hold; one for an outage holds twenty minutes at most."""
    until = F.when(F.col("reason").isin(*outages), F.least("until", F.col("at") + F.expr("INTERVAL 20 MINUTES"))).otherwise(F.col("until")) if outages else F.col("until")
    rows = blocks.withColumn("until", until).where(F.col("until") > asof)
    return rows.orderBy(F.desc("at"), "title").limit(most)


def cached(rows: DataFrame, cache: DataFrame, key: str, asof: Column) -> DataFrame:
    """rows with the live cache entry's columns, null without one; the newest entry of a key counts."""
    live = cache.where(F.col("until") > asof)
    newest = live.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("until")))).where("_n = 1").drop("_n")
    return rows.join(newest, key, "left")


def corrected(rows: DataFrame, fixes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fields overlaid by corrections (key, action, fields): action 'drop' removes the row, 'retire' marks it."""
    f = fixes.select(F.col(key), F.col("action"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(f, key, "left").where(F.coalesce(F.col("action"), F.lit("")) != "drop")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in rows.columns], F.coalesce(F.col("action") == "retire", F.lit(False)).alias("retired"))


def registered(rows: DataFrame, registry: DataFrame, links: Sequence[str], title: Column) -> DataFrame:
    """rows with status 'skipped_duplicate' when any link (without query and closing slash) or the title is in the registry."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[?#].*$", ""), "/+$", "")
    by_link = registry.select(bare(F.col("source_url")).alias("k")).where("k <> ''").distinct().withColumn("_l", F.lit(True))
    by_title = registry.select(F.explode("titles").alias("k")).select(F.lower(F.trim("k")).alias("t")).distinct().withColumn("_t", F.lit(True))
    out = rows.withColumn("_hit", F.lit(False))
    for c in links:
        out = out.withColumn("_k", bare(F.col(c))).join(broadcast_if_small(by_link), F.col("_k") == F.col("k"), "left").withColumn("_hit", F.col("_hit") | F.coalesce("_l", F.lit(False))).drop("_k", "k", "_l")
    out = out.withColumn("_k", F.lower(F.trim(title))).join(broadcast_if_small(by_title), F.col("_k") == F.col("t"), "left")
    hit = F.col("_hit") | F.coalesce("_t", F.lit(False))
    return out.withColumn("status", F.when(hit, "skipped_duplicate").otherwise("new")).drop("_k", "t", "_t", "_hit")


def send_log(calls: DataFrame, limit: int = 4096) -> DataFrame:
    """Outbound attempts (t, method, chat, text, response) as log rows; a text that is cut says how long it was."""
    size, text = F.length("text"), F.substring("text", 1, limit)
    return calls.select(
        "t", "method", "chat", size.alias("len"), text.alias("text"), F.get_json_object("response", "$.ok").try_cast("boolean").alias("ok"), F.get_json_object("response", "$.result.message_id").try_cast("long").alias("message_id"),
        F.get_json_object("response", "$.description").alias("error"), F.when(size > limit, size).alias("trimmed_from"),
    )


def without_raw(rows: DataFrame, statuses: Sequence[str], asof: Column, hold: str = "INTERVAL 20 MINUTES") -> tuple[DataFrame, DataFrame]:
    """(rows that may go out, blocks): texts that no model rewrote are held back for a while."""
    raw = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    return rows.where(~raw), rows.where(raw).select("title", asof.alias("at"), (asof + F.expr(hold)).alias("until"), F.lit("raw_text").alias("reason"))
