"""Streams of stories and their batch twins: freshness, dedup within a watermark, remembered repeats, windows, interval joins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRESH_SECONDS, RESCUE_SECONDS, FUTURE_SECONDS = 1800, 43_200, 300


def freshness(at: Column, now: Column, critical: Column) -> Column:
    """'fresh' up to 30 minutes, 'rescued' up to 12 hours when critical, 'late', 'future' beyond 5 minutes ahead, 'undated'."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000
    return (
        F.when(at.isNull(), "undated").when(age < -FUTURE_SECONDS, "future").when(age <= FRESH_SECONDS, "fresh")
        .when((age <= RESCUE_SECONDS) & critical, "rescued").otherwise("late")
    )


def fresh_stream(stream: DataFrame, key: str, at: str, arrived: str, critical: Column) -> DataFrame:
    """A stream's fresh and rescued rows, once for each key, with their freshness against the arrival time.

    The watermark is as late as a rescue may be: a key is forgotten when no row of it could be rescued any more, and rows that are
    later still are dropped by Spark and counted (numRowsDroppedByWatermark). Undated and future rows leave by the filter, so a row
    from the future does not move the watermark.
    """
    rows = stream.withColumn("freshness", freshness(F.col(at), F.col(arrived), critical)).where(F.col("freshness").isin("fresh", "rescued", "late"))
    kept = rows.withWatermark(at, f"{RESCUE_SECONDS} seconds").where("freshness <> 'late'")
    return kept.dropDuplicatesWithinWatermark([key])


def unique_stream(stream: DataFrame, key: str, at: str, within: str = "7 days") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def unique_table(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The batch twin of unique_stream for a table that fits one watermark."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def windowed(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None, values: str = "value") -> DataFrame:
    """Counts and sums by (sliding) window; with late given, as a stream whose windows close after that delay."""
    rows = stream.withWatermark(at, late) if late else stream
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(values).alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    rows = stream.withWatermark(at, late) if late else stream
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def recent_matches(new: DataFrame, old: DataFrame, key: str, within: str, late: str = "1 hour", unmatched: bool = False) -> DataFrame:
    """New posts (id, t, key) with earlier ones (id, t, key) of the same key in the time before; two watermarks bound the state.

    unmatched: posts without an earlier one are given too, when the watermark has passed them (on tables: at once).
    """
    a = new.select(F.col("id").alias("a"), F.col("t").alias("a_t"), F.col(key).alias("a_key")).withWatermark("a_t", late)
    b = old.select(F.col("id").alias("b"), F.col("t").alias("b_t"), F.col(key).alias("b_key")).withWatermark("b_t", late)
    return a.join(b, F.expr(f"a_key = b_key AND b_t < a_t AND b_t >= a_t - INTERVAL {within}"), "left_outer" if unmatched else "inner")


def repeats(rows: list[tuple[Any, ...]], remembered: list[tuple[float, frozenset[str]]], seconds: float, most: int, least: int, share: float) -> tuple[list[bool], list[tuple[float, frozenset[str]]]]:
    """Rows (t, keys, ok) in order of time: whether each repeats a remembered one. Only rows that pass and are not failed are
    remembered, so a repeat that is held back does not make the memory last longer."""
    out = []
    for t, keys, ok in rows:
        remembered = [m for m in remembered if t - m[0] <= seconds]
        keys = frozenset(keys)
        seen = any(len(keys & k) >= least and len(keys & k) >= share * min(len(keys), len(k)) for _, k in remembered)
        out.append(seen)
        if not seen and ok is not False:
            remembered = [*remembered, (t, keys)][-most:]
    return out, remembered


def repeats_table(rows: DataFrame, channel: str = "channel", hours: float = 36, most: int = 150, least: int = 4, share: float = 0.6) -> DataFrame:
    """Rows (channel, id, t, keys, ok) with repeated: the memory of a channel replayed in order of (t, id).

    Channels are sorted by Spark and pass a task row by row, in the order the channel itself has; the task holds one channel's
    memory, which is bounded, however many rows the channel has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            seconds = pdf["t"].astype("datetime64[us]").astype("int64") / 1e6
            ok = [None if pd.isna(x) else bool(x) for x in pdf["ok"]]
            flags: list[bool] = []
            edge = [0, *(pdf[channel].ne(pdf[channel].shift()).to_numpy().nonzero()[0][1:]).tolist(), len(pdf)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if pdf[channel].iloc[a] != now:
                    now, held = pdf[channel].iloc[a], []
                some, held = repeats(list(zip(seconds[a:b], pdf["keys"][a:b], ok[a:b], strict=True)), held, hours * 3600, most, least, share)
                flags += some
            yield pd.DataFrame({"channel": pdf[channel], "id": pdf["id"], "repeated": flags})

    ordered = rows.select(channel, "id", "t", "keys", "ok").repartition(channel).sortWithinPartitions(channel, "t", "id")
    return ordered.mapInPandas(run, "channel string, id long, repeated boolean")


def once_a_day(batch: DataFrame, done: DataFrame, zone: str, hour: int, at: str = "t") -> DataFrame:
    """Boards (board, t) that are due: the local hour is reached and (board, local day) is not among those done."""
    local = F.from_utc_timestamp(at, zone)
    due = batch.withColumn("day", F.to_date(local)).where(F.hour(local) >= hour).dropDuplicates(["board", "day"])
    return due.join(done.select("board", "day"), ["board", "day"], "left_anti")


class DailyBoards:
    """For foreachBatch: writes each (board, local day) once, in a folder of its micro-batch's own.

    Boards done are those of earlier micro-batches, which have ended before this one begins. A micro-batch that is tried again after
    a failure finds the same ones done and overwrites its own folder, so it writes nothing twice and loses nothing.
    """

    def __init__(self, folder: str, zone: str = "UTC", hour: int = 0, at: str = "t"):
        self.folder, self.zone, self.hour, self.at = folder, zone, hour, at

    def start(self, spark: SparkSession) -> DailyBoards:
        spark.createDataFrame([], "board string, day date").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch=-1")
        return self

    def done(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """board, day and the micro-batch that wrote them."""
        rows = spark.read.schema("board string, day date, batch long").parquet(self.folder)
        return rows if before is None else rows.where(F.col("batch") < before)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        due = once_a_day(batch, self.done(batch.sparkSession, batch_id), self.zone, self.hour, self.at)
        due.select("board", "day").write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")


def retry_queue(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Outcomes that may be tried again: failed for certain, and fewer than most times; ambiguous ones never are."""
    per = attempts.groupBy("key").agg(F.max_by("outcome", "t").alias("outcome"), F.count("*").alias("tries"), F.bool_or(F.col("outcome") != "failed").alias("settled"))
    return per.where((F.col("outcome") == "failed") & (F.col("tries") < most) & ~F.col("settled")).select("key", "tries")
