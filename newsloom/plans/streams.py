"""Queries over the event table as runs, calls, beats and posts: usage, quotas, windows, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import audit, memory, ranking, similarity
from newsloom.operators.verdicts import outcome
from newsloom.plans.base import ASOF, asof, query, table
from newsloom.streaming import stories as S

_TS = f"TIMESTAMP '{ASOF}'"
_K = "TRY_CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INT)"
#: 2xx, 429 or an error, by the kind of event.
_STATUS = "CASE event_type WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 429 ELSE 500 END ELSE 200 END"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, 429).otherwise(500)).otherwise(200)
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("t"), F.col("user_id"), (F.col("user_id") % 7).alias("model"), code.alias("status"), F.when(code != 200, F.col("props")).alias("error"), "event_type", "value")


@query(
    f"""WITH c AS (SELECT *, user_id % 7 AS model, {_STATUS} AS status FROM events), d AS (SELECT ts::DATE AS day, model, count(*) AS calls, count_if(status = 200)::BIGINT AS ok, count_if(status = 429)::BIGINT AS limited, count_if(status = 500)::BIGINT AS other, arg_max(CASE WHEN status <> 200 THEN props END, CASE WHEN status <> 200 THEN ts END) AS last_error FROM c GROUP BY 1, 2)
    SELECT * FROM d QUALIFY dense_rank() OVER (PARTITION BY model ORDER BY day DESC) <= 4"""
)
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return audit.usage_by_day(calls(spark, sf), keep_days=4)


@query("WITH c AS (SELECT event_id, user_id % 7 AS model, ts, count(*) OVER (PARTITION BY user_id % 7, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM events) SELECT event_id, used, used < (10 + 5 * model) * least(1.0, (hour(ts) + 1) / 24) AS allowed FROM c")
def quota_share(spark: SparkSession, sf: str) -> DataFrame:
    budgets = spark.createDataFrame([(m, 10 + 5 * m) for m in range(7)], "model long, budget int")
    return audit.over_quota(calls(spark, sf), budgets, "t", "model", "event_id").select("event_id", "used", "allowed")


@query("SELECT event_id, gap_us FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) WHERE gap_us < 600000000")
def min_gap_violations(spark: SparkSession, sf: str) -> DataFrame:
    return audit.gap_violations(calls(spark, sf), "t", "user_id", "event_id", 600).select("event_id", "gap_us")


@query(f"WITH c AS (SELECT event_id, user_id, ts, {_STATUS} AS status FROM events), u AS (SELECT event_id, ts, lag(CASE WHEN status <> 200 THEN epoch_us(ts) + CASE WHEN status = 429 THEN 86400 ELSE 7200 END * 1000000::BIGINT END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rests_until FROM c) SELECT event_id, rests_until FROM u WHERE epoch_us(ts) < rests_until")
def cooldown_open(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.open_cooldowns(calls(spark, sf), "t", "user_id", "event_id", F.col("status") != 200, F.when(F.col("status") == 429, 86_400).otherwise(7_200))
    return out.select("event_id", "rests_until")


@query("WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_type, count(*) AS logged FROM s WHERE before IS NULL OR before <> event_type GROUP BY event_type")
def adjacent_repeat_drop(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("event_type")))
    return rows.groupBy("event_type").agg(F.count("*").alias("logged"))


@query("SELECT event_id, list_contains(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), event_type) IS TRUE AS repeated FROM events")
def recent_repeat(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    return table(spark, sf, "events").select("event_id", F.array_contains(F.collect_list("event_type").over(w), F.col("event_type")).alias("repeated"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY user_id, ts::DATE QUALIFY dense_rank() OVER (PARTITION BY user_id ORDER BY day DESC) <= 3")
def keep_last_k_days(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ranking.keep_last_days(days, "user_id", "day", 3)


@query(
    """WITH d AS (SELECT ts::DATE AS day, event_id, ts, floor(value / 20)::INT AS level, event_type FROM events), u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day, event_type, level ORDER BY ts, event_id) = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY level DESC, ts DESC, event_id) AS n FROM u) SELECT day, event_id, level, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS place FROM t WHERE n <= 5"""
)
def daily_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's five best items (a top-k report), once per wording, in the order of their time."""
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", "ts", F.floor(F.col("value") / 20).cast("int").alias("level"), "event_type")
    once = rows.withColumn("c", F.row_number().over(Window.partitionBy("day", "event_type", "level").orderBy("ts", "event_id"))).where("c = 1")
    best = once.withColumn("n", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("level"), F.desc("ts"), "event_id"))).where("n <= 5")
    return best.select("day", "event_id", "level", F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id")).alias("place"))


@query("SELECT a.event_id AS id, max(b.event_id) FILTER (b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'error' AND c.ts < a.ts)) AS match_id FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 36 HOURS WHERE a.event_type = 'purchase' GROUP BY 1")
def newest_earlier(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("t"), "event_type")
    out = similarity.newest_earlier(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'error'").drop("event_type"), "user_id", "INTERVAL 36 HOURS")
    return out.select("id", "match_id")


@query("SELECT a.event_id AS a, b.event_id AS b, CASE WHEN a.ts - b.ts <= INTERVAL 8 HOURS THEN 1 ELSE 2 END AS strength FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 18 HOURS")
def incident_pairs(spark: SparkSession, sf: str) -> DataFrame:
    # rows meet by key and cell of 18 hours, their own or the one before, so a key that lives long stays linear
    cell = F.floor(F.unix_timestamp("ts") / (18 * 3600))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws("|", "event_type", "user_id").alias("k"), F.col("ts").alias("t"), cell.alias("cell"))
    b = e.select(F.col("id").alias("b"), "k", F.col("t").alias("b_t"), "cell")
    met = e.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1))).join(b, ["k", "cell"]).where((F.col("b_t") < F.col("t")) & (F.col("b_t") >= F.col("t") - F.expr("INTERVAL 18 HOURS")))
    return met.select(F.col("id").alias("a"), "b", F.when(F.col("b_t") >= F.col("t") - F.expr("INTERVAL 8 HOURS"), 1).otherwise(2).alias("strength"))


@query(f"SELECT event_type, event_id FROM events WHERE ts >= {_TS} - INTERVAL 20 DAYS QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 150")
def bounded_append(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 150 of each log (the bound is the feature), appended to what the log held."""
    e = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return memory.bounded_append(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "event_type", "ts", asof(), "INTERVAL 20 DAYS", 150, "event_id").select("event_type", "event_id")


@query(f"SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS runs FROM events GROUP BY ALL HAVING max(ts) >= {_TS} - INTERVAL 5 DAYS")
def refused_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = lambda rows: rows.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("runs"))
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return memory.upsert_counts(log(e.where(half)), log(e.where(~half)), ["user_id", "event_type"], asof(), "INTERVAL 5 DAYS")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, (time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def daily_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.windowed(table(spark, sf, "events"), "ts", ["event_type"], "1 day")


@query("SELECT event_type, w AS window_start, w + INTERVAL 12 HOURS AS window_end, count(*) AS n, sum(value) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOURS, ts)::TIMESTAMP, time_bucket(INTERVAL 6 HOURS, ts)::TIMESTAMP - INTERVAL 6 HOURS]) AS w FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.windowed(table(spark, sf, "events"), "ts", ["event_type"], "12 hours", "6 hours")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_session FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, n_session")
def session_story(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessions(table(spark, sf, "events"), "ts", "user_id", "30 minutes")


@query("SELECT min(event_id) FILTER (n = 1) AS event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return S.unique_table(rows, "key", "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT outcome, count(*) AS n, count_if(outcome = 'failed')::BIGINT AS may_retry FROM (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'ambiguous' ELSE 'published' END AS outcome FROM events) GROUP BY outcome")
def outcome_states(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.when(F.col("event_type") == "error", False).when(F.col("event_type") != "view", True)
    return table(spark, sf, "events").select(outcome(ok).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("may_retry"))


@query(f"SELECT user_id, max(ts) AS last_beat, {_TS} - INTERVAL 2 DAYS > max(ts) AS stale FROM events GROUP BY user_id")
def heartbeat_staleness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.stale(table(spark, sf, "events"), "user_id", "ts", asof(), "INTERVAL 2 DAYS")


@query(
    """WITH a AS (SELECT ts::DATE AS run, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'ambiguous' ELSE 'published' END AS result FROM events),
    c AS (SELECT run, count(*) AS attempts, count_if(result = 'published')::BIGINT AS published, count_if(result = 'failed')::BIGINT AS failed, count_if(result = 'blocked')::BIGINT AS blocked, count_if(result = 'ambiguous')::BIGINT AS ambiguous FROM a GROUP BY run)
    SELECT *, CASE WHEN published = 0 AND failed > 0 THEN 'publication_failure' WHEN published = 0 AND blocked > 0 THEN 'editorial_blocked' WHEN failed > published THEN 'degraded' ELSE 'healthy' END AS status FROM c"""
)
def health_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    result = F.when(kind == "error", "failed").when(kind == "view", "blocked").when(kind == "click", "ambiguous").otherwise("published")
    return audit.health(table(spark, sf, "events").select(F.to_date("ts").alias("run"), result.alias("result")), "run")


@query("SELECT kind, status, count(*) AS feeds, count_if(candidates > 0)::BIGINT AS with_candidates, sum(candidates)::BIGINT AS candidates, avg(duration) AS mean_duration FROM (SELECT event_type AS kind, user_id % 3 AS status, floor(value)::INT % 5 AS candidates, value AS duration FROM events) GROUP BY ROLLUP (kind, status)")
def feed_summary(spark: SparkSession, sf: str) -> DataFrame:
    feeds = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("status"), (F.floor("value").cast("int") % 5).alias("candidates"), F.col("value").alias("duration"))
    return audit.feed_summary(feeds)


@query("SELECT ts::DATE AS day, max(ts) AS last_start, greatest(ts::DATE::TIMESTAMP + INTERVAL 21 HOURS, max(ts) + INTERVAL '2 hours 15 minutes') AS due_at, max(ts) + INTERVAL 4 HOURS AS given_up_at, bool_and(event_type <> 'error') AS all_finished, count(*) AS matches FROM events GROUP BY ts::DATE")
def match_timeout(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.boards import due_boards

    return due_boards(table(spark, sf, "events").withColumn("day", F.to_date("ts")), "day", "ts", F.col("event_type") != "error")


@query("SELECT model, used, budget, used < budget AS allowed, row_number() OVER (ORDER BY used < budget DESC, used / budget, model) AS place FROM (SELECT user_id % 7 AS model, count(*) AS used, 1200 + 100 * (user_id % 7) AS budget FROM events GROUP BY 1, 3)")
def provider_order(spark: SparkSession, sf: str) -> DataFrame:
    used = calls(spark, sf).groupBy("model").agg(F.count("*").alias("used")).withColumn("budget", 1200 + 100 * F.col("model"))
    rows = used.withColumn("allowed", F.col("used") < F.col("budget"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("allowed"), F.col("used") / F.col("budget"), "model")))  # one row a model


@query()
def remembered_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of a user whose keys repeat a remembered post of the last 36 hours."""
    e = table(spark, sf, "events")
    keys = F.array(F.col("event_type"), F.concat(F.lit("k"), F.floor(F.get_json_object("props", "$.k").cast("int") / 25)))
    rows = e.select(F.col("user_id").cast("string").alias("channel"), F.col("event_id").alias("id"), F.col("ts").alias("t"), keys.alias("keys"), (F.col("event_type") != "error").alias("ok"))
    return S.repeats_table(rows, least=2, share=1.0)
