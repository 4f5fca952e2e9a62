"""Queries that run as streams over the event table: it arrives in three parts, some of it late, and the stream is stopped and started
again in between. Their SQL states what must be settled when the watermark has come to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.base import query, table
from newsloom.runtime import shared_folder
from newsloom.streaming import stories as S
from newsloom.streaming import timers

_PARTS = 3
#: Rows come up to an hour late, and the watermark waits for two.
_LATE, _JITTER = "2 hours", 600
#: The last watermark: Spark keeps it in whole milliseconds.
_UPTO = "SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOURS AS upto FROM events"


def _part(at: str = "ts") -> Column:
    """The part (ten days) in which a row arrives."""
    arrived = F.unix_timestamp(at) + (F.col("event_id") % 7) * _JITTER
    first = F.lit("2024-01-01").cast("timestamp")
    return F.least(F.lit(_PARTS - 1), F.greatest(F.lit(0), F.floor((arrived - F.unix_timestamp(first)) / (10 * 86_400)))).cast("int")


def _plain(told: DataFrame) -> DataFrame:
    """Times without a zone, as the event table has them."""
    return told.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props")


_FAILED = "CASE WHEN event_type = 'error' THEN ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 24 HOURS ELSE INTERVAL 2 HOURS END END"


@query(
    f"""WITH w AS ({_UPTO}), c AS (SELECT user_id, event_id, ts, {_FAILED} AS until FROM events, w WHERE ts <= upto),
    n AS (SELECT *, lag(until) OVER u AS before, lead(ts) OVER u AS following FROM c WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id AS id, ts AS at, 'refused' AS kind FROM n WHERE ts < before
    UNION ALL SELECT user_id, NULL, until, 'reopened' FROM n, w WHERE until <= upto AND (following IS NULL OR following >= until)"""
)
def rests_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Calls made while their key rested after a failure (2 or 24 hours), and rests that ended by time."""
    until = F.when(F.col("event_type") == "error", F.col("ts") + F.when(F.col("user_id") % 2 == 0, F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 2 HOURS")))
    return _plain(timers.in_slices(_events(spark, sf), _part(), _PARTS, lambda s: timers.rests_stream(s, "user_id", "ts", "event_id", until, _LATE)))


@query(
    f"""WITH w AS ({_UPTO}), c AS (SELECT user_id, event_id, ts, {_FAILED} AS until FROM events, w WHERE ts <= upto),
    n AS (SELECT *, lag(until) OVER u AS before, lead(ts) OVER u AS following FROM c WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id AS id, ts AS at, 'refused' AS kind FROM n WHERE ts < before
    UNION ALL SELECT user_id, NULL, until, 'reopened' FROM n, w WHERE until <= upto AND (following IS NULL OR following >= until)"""
)
def rests_reported(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of rests_streamed."""
    until = F.when(F.col("event_type") == "error", F.col("ts") + F.when(F.col("user_id") % 2 == 0, F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 2 HOURS")))
    upto = _events(spark, sf).agg(F.max("ts")).first()[0]
    return _plain(timers.rests_table(_events(spark, sf), "user_id", "ts", "event_id", until, F.date_trunc("millisecond", F.lit(upto)) - F.expr("INTERVAL 2 HOURS")))


@query(
    f"""WITH w AS ({_UPTO}), b AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events, w WHERE ts <= upto)
    SELECT user_id, ts + INTERVAL 12 HOURS AS at, 'silent' AS kind FROM b, w WHERE following > ts + INTERVAL 12 HOURS OR (following IS NULL AND ts + INTERVAL 12 HOURS < upto)
    UNION ALL SELECT user_id, following, 'back' FROM b WHERE following > ts + INTERVAL 12 HOURS"""
)
def silence_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Users from whom nothing came for over 12 hours, told by a timer, and the events that ended it."""
    return _plain(timers.in_slices(_events(spark, sf), _part(), _PARTS, lambda s: timers.silence_stream(s, "user_id", "ts", "event_id", 12 * 60, _LATE)))


@query(
    """WITH m AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') || '|' || (user_id % 5) AS board, date_trunc('day', ts)::TIMESTAMP AS day,
        CASE WHEN event_type <> 'error' THEN ts + INTERVAL 90 MINUTES + to_minutes(30 * (event_id % 7)) END AS ended FROM events),
    w AS (SELECT date_trunc('milliseconds', max(greatest(day, ended))) - INTERVAL 2 HOURS AS upto FROM m),
    g AS (SELECT board, min(day) AS day, max(ts) AS last, count(*)::INT AS matches, bool_and(ended IS NOT NULL) AS every, max(ended) AS ended FROM m GROUP BY board),
    d AS (SELECT *, greatest(day + INTERVAL 21 HOURS, last + INTERVAL 135 MINUTES) AS due, greatest(day + INTERVAL 21 HOURS, last + INTERVAL 4 HOURS) AS stop FROM g),
    k AS (SELECT *, every AND (ended < stop OR ended <= due) AS complete FROM d),
    t AS (SELECT board, CASE WHEN complete THEN greatest(due, ended) ELSE stop END AS moment, CASE WHEN complete THEN 'complete' ELSE 'given up' END AS kind, matches FROM k)
    SELECT board, moment AS at, kind, (SELECT count(*) FROM m WHERE m.board = t.board AND m.ended < t.moment OR m.board = t.board AND kind = 'complete')::INT AS final, matches FROM t, w WHERE moment <= upto"""
)
def boards_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of a day's events as matches: the schedule comes in the morning, results 1.5 to 4.5 hours after the start, those of
    errors never. A board is told once: complete, or given up with what is final."""
    e = _events(spark, sf)
    board = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id") % 5)
    planned = e.select("event_id", board.alias("board"), F.date_trunc("day", "ts").alias("t"), F.col("ts").alias("start"), F.lit(False).alias("final"))
    late = F.expr("INTERVAL 90 MINUTES") + F.make_dt_interval(mins=(F.col("event_id") % 7 * 30).cast("int"))
    ended = e.where("event_type <> 'error'").select("event_id", board.alias("board"), (F.col("ts") + late).alias("t"), F.lit(None).cast("timestamp").alias("start"), F.lit(True).alias("final"))
    rows = planned.unionByName(ended)
    return _plain(timers.in_slices(rows, _part("t"), _PARTS, lambda s: timers.results_stream(s, "board", "t", "event_id", F.col("event_id"), F.col("start"), F.col("final"), _LATE)))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts: four keys each, of the kind and of three thirds of its number."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    keys = F.array(F.col("event_type"), *(F.concat(F.lit(f"{name}"), F.floor((k + shift) / width)) for name, width, shift in (("a", 20, 0), ("b", 20, 7), ("c", 20, 13), ("d", 25, 3))))
    return _events(spark, sf).select("event_id", "ts", (F.col("user_id") % 40).alias("channel"), keys.alias("keys"), (F.col("event_type") != "error").alias("ok"))


@query()
def memory_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Posts that repeat one of their channel's remembered posts of the last 36 hours. What is remembered depends on what was held
    back before, so a test replays it."""
    return _plain(timers.in_slices(posts(spark, sf), _part(), _PARTS, lambda s: timers.memory_stream(s, "channel", "ts", "event_id", F.col("keys"), F.col("ok"), "stories", _LATE)))


@query()
def incidents_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the memory of incidents, with its strong rule over 18 hours and its weak one over 8."""
    return _plain(timers.in_slices(posts(spark, sf), _part(), _PARTS, lambda s: timers.memory_stream(s, "channel", "ts", "event_id", F.col("keys"), F.col("ok"), "incidents", _LATE)))


@query(
    """WITH n AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'), o AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'error'),
    w AS (SELECT least(date_trunc('milliseconds', (SELECT max(ts) FROM n)), date_trunc('milliseconds', (SELECT max(ts) FROM o))) - INTERVAL 2 HOURS AS upto),
    j AS (SELECT n.event_id AS a, n.ts AS t, o.event_id AS b FROM n LEFT JOIN o ON n.user_id = o.user_id AND o.ts < n.ts AND o.ts >= n.ts - INTERVAL 36 HOURS)
    SELECT a, b FROM j, w WHERE b IS NOT NULL OR t <= upto"""
)
def recent_matches_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the user's errors of the 36 hours before, and those without any: two streams joined over an interval."""

    def joined(s: DataFrame) -> DataFrame:
        one = s.select(F.col("event_id").alias("id"), F.col("ts").alias("t"), "user_id", "event_type")
        kind = lambda name: one.where(F.col("event_type") == name).drop("event_type")
        return S.recent_matches(kind("purchase"), kind("error"), "user_id", "36 HOURS", _LATE, unmatched=True).select("a", "b")

    return timers.in_slices(_events(spark, sf), _part(), _PARTS, joined)


@query(
    """WITH sent AS (SELECT event_id, ts, event_type, ts + to_minutes(10 * (event_id % 97)) - INTERVAL 8 MINUTES AS arrived FROM events
        UNION ALL SELECT event_id, ts, event_type, ts + to_minutes(10 * (event_id % 97)) + INTERVAL 52 MINUTES FROM events)
    SELECT DISTINCT event_id FROM sent WHERE arrived - ts >= -INTERVAL 5 MINUTES AND (arrived - ts <= INTERVAL 30 MINUTES OR (arrived - ts <= INTERVAL 12 HOURS AND event_type = 'error'))"""
)
def fresh_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrive fresh, or late but critical, once each: every one is sent twice."""
    e = _events(spark, sf)
    way = F.make_dt_interval(mins=(F.col("event_id") % 97 * 10).cast("int"))
    sent = e.withColumn("arrived", F.col("ts") + way - F.expr("INTERVAL 8 MINUTES")).unionByName(e.withColumn("arrived", F.col("ts") + way + F.expr("INTERVAL 52 MINUTES")))
    part = F.least(F.lit(_PARTS - 1), F.floor((F.unix_timestamp("arrived") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / (10 * 86_400))).cast("int")
    return timers.in_slices(sent, F.greatest(F.lit(0), part), _PARTS, lambda s: S.fresh_stream(s, "event_id", "ts", "arrived", F.col("event_type") == "error").select("event_id"))


@query("SELECT event_type AS board, (ts - INTERVAL 3 HOURS)::DATE AS day, 1::BIGINT AS n FROM events WHERE hour(ts - INTERVAL 3 HOURS) >= 9 GROUP BY ALL")
def daily_boards_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Boards (kinds of events) written once a local day, when its ninth hour has come; n: how often each was written."""
    folder = f"{shared_folder(spark)}/boards-{uuid.uuid4().hex}"
    boards = S.DailyBoards(f"{folder}/done", "Etc/GMT+3", 9, "ts").start(spark)
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("board"), "ts")
    for k in range(_PARTS):
        rows.where(_part() == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run = stream.writeStream.foreachBatch(boards).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        if not run.awaitTermination(900):
            run.stop()
            raise TimeoutError("the stream did not end")
    return boards.done(spark).groupBy("board", "day").agg(F.count("*").alias("n"))
