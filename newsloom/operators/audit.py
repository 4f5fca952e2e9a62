"""Audits of page corpora, feeds, providers and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import broadcast_if_small


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def audit_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """One row per page: digest, bytes, title, kind and named checks, with passed when all checks hold."""
    h = F.col(html)
    title = F.trim(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1))
    checks = F.create_map(
        F.lit("doctype"), F.lower(h).startswith("<!doctype html"), F.lit("title"), title != "", F.lit("charset"), F.lower(h).contains("charset="),
        F.lit("lang"), h.rlike(r"(?i)<html[^>]*lang="), F.lit("closed"), F.lower(F.rtrim(h)).endswith("</html>"),
    )
    kind = F.when(h.rlike(r"(?i)<meta[^>]*noindex"), "retired").otherwise("active")
    out = pages.select("*", F.sha2(h, 256).alias("sha256"), F.octet_length(h).alias("bytes"), title.alias("title"), F.nullif(F.regexp_extract(h, r"""(?is)rel=["']canonical["'][^>]*href=["']([^"']+)""", 1), F.lit("")).alias("canonical"), kind.alias("kind"), checks.alias("checks"))
    return out.withColumn("passed", F.forall(F.map_values("checks"), lambda x: F.coalesce(x, F.lit(False))))


def audit_summary(audited: DataFrame, baseline: int) -> DataFrame:
    """One row: active, retired and failed pages, drift from a baseline, and how often each check failed."""
    failed = [F.count_if(~F.element_at("checks", F.lit(c))).alias(f"no_{c}") for c in ("doctype", "title", "charset", "lang", "closed")]
    return audited.agg(F.count("*").alias("pages"), F.count_if(F.col("kind") == "active").alias("active"), F.count_if(F.col("kind") == "retired").alias("retired"), F.count_if(~F.col("passed")).alias("failed"), (F.count("*") - baseline).alias("drift"), *failed)


def completeness(pages: DataFrame, expected: DataFrame, id_column: str) -> DataFrame:
    """One row: expected and found ids, how many of either the other side lacks, the smallest missing ids, and whether all is there."""
    have, want = pages.select(id_column).distinct().withColumn("_h", F.lit(True)), expected.select(id_column).distinct().withColumn("_w", F.lit(True))
    both = want.join(have, id_column, "full_outer")
    missing, extra = F.col("_h").isNull(), F.col("_w").isNull()
    out = both.agg(F.count("_w").alias("expected"), F.count("_h").alias("found"), F.count_if(missing).alias("missing"), F.count_if(extra).alias("extra"), F.min(F.when(missing, F.col(id_column))).alias("first_missing"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))


def duplicate_groups(rows: DataFrame, key: Column, id_column: str) -> DataFrame:
    """(key, n, first_id, last_id) of keys that occur more than once; counts are summed before the shuffle."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"), F.max(id_column).alias("last_id")).where("n > 1")


def feed_summary(feeds: DataFrame) -> DataFrame:
    """Runs of feeds (kind, status, candidates, duration) by kind and status, with totals."""
    return feeds.rollup("kind", "status").agg(F.count("*").alias("feeds"), F.count_if(F.col("candidates") > 0).alias("with_candidates"), F.sum("candidates").alias("candidates"), F.avg("duration").alias("mean_duration"))


def usage_by_day(calls: DataFrame, at: str = "t", model: str = "model", status: str = "status", error: str = "error", keep_days: int | None = None) -> DataFrame:
    """Calls per day and model: ok (2xx), limited (429), others, and the latest error; optionally of each model's last days."""
    code = F.col(status)
    out = calls.groupBy(F.to_date(at).alias("day"), model).agg(
        F.count("*").alias("calls"), F.count_if(code.between(200, 299)).alias("ok"), F.count_if(code == 429).alias("limited"), F.count_if(~code.between(200, 299) & (code != 429)).alias("other"),
        F.max_by(error, F.when(F.col(error).isNotNull(), F.col(at))).alias("last_error"),
    )
    if keep_days is not None:
        out = out.withColumn("_d", F.dense_rank().over(Window.partitionBy(model).orderBy(F.desc("day")))).where(F.col("_d") <= keep_days).drop("_d")
    return out


def over_quota(calls: DataFrame, budgets: DataFrame, at: str, model: str, tie: str) -> DataFrame:
    """Each call with the day's calls before it and whether they still are within the share that the hour allows."""
    day = F.to_date(at)
    w = Window.partitionBy(model, day).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("used", F.count("*").over(w)).join(broadcast_if_small(budgets), model)
    share = F.least(F.lit(1.0), (F.hour(at) + 1) / 24)
    return rows.withColumn("allowed", F.col("used") < F.col("budget") * share)


def paced(calls: DataFrame, budgets: DataFrame, at: str, model: str, tie: str, headroom_hours: float = 1.0) -> DataFrame:
    """Each call with quota_day, used and allowed, by the budgets (model, key, zone, budget).

    Models of one key share its budget. A key's day begins at midnight in its zone. Allowed: the key's calls of the day before
    this one are fewer than the budget's share for the hours gone by and the headroom; a budget of 0 or less allows all.
    """
    rows = calls.join(broadcast_if_small(budgets), model)
    local = F.from_utc_timestamp(at, F.col("zone"))
    rows = rows.withColumn("quota_day", F.to_date(local)).withColumn("_hours", (_micros(local) - _micros(F.date_trunc("day", local))) / 3.6e9)
    w = Window.partitionBy("key", "quota_day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    share = F.least(F.lit(1.0), (F.col("_hours") + headroom_hours) / 24)
    return rows.withColumn("used", F.count("*").over(w)).withColumn("allowed", (F.col("budget") <= 0) | (F.col("used") < F.col("budget") * share)).drop("_hours")


def next_midnight(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """The next midnight in the zone, as UTC: until then a used-up daily quota rests."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at, zone)) + F.expr("INTERVAL 1 DAY"), zone)


def gap_violations(calls: DataFrame, at: str, key: str, tie: str, least_seconds: float) -> DataFrame:
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = _micros(F.col(at)) - _micros(F.lag(at).over(w))
    return calls.withColumn("gap_us", gap).where(F.col("gap_us") < int(least_seconds * 1_000_000))


def open_cooldowns(calls: DataFrame, at: str, key: str, tie: str, failed: Column, seconds: Column) -> DataFrame:
    """Calls made while the key's last answer still rested it: a failure rests it for the seconds, a success clears the rest."""
    until = F.when(failed, _micros(F.col(at)) + seconds.cast("long") * 1_000_000)
    w = Window.partitionBy(key).orderBy(at, tie)
    return calls.withColumn("rests_until", F.lag(until).over(w)).where(_micros(F.col(at)) < F.col("rests_until"))


def run_health(runs: DataFrame) -> DataFrame:
    """runs (run_status, selected, published, missed, failed, ambiguous, blocked, duplicates, attempts) with status and diagnostics.

    The worst state counts: a run that failed, selected stories without an outcome or failed sends, and a run that selected
    something and published nothing, which is editorial when all of it was blocked or known.
    """
    c = F.col
    runtime = F.lower(F.coalesce(c("run_status"), F.lit(""))).isin("failed", "error", "unknown", "")
    lost = (c("missed") > 0) | (c("failed") > 0) | (c("ambiguous") > 0)
    gap = (c("selected") > 0) & (c("published") == 0)
    decided = (c("missed") == 0) & (c("attempts") > 0) & (c("blocked") + c("duplicates") >= c("selected"))
    status = F.when(lost, "publication_failure").when(runtime, "runtime_failure").when(gap & decided, "editorial_blocked").when(gap, "publication_failure").otherwise("healthy")
    notes = F.filter(F.array(
        F.when(runtime, "runtime"), F.when(c("missed") > 0, "missed"), F.when((c("failed") > 0) | (c("ambiguous") > 0), "failed"), F.when(gap, "gap"),
        F.when(c("blocked") > 0, "blocked"), F.when((c("selected") == 0) & (c("attempts") == 0), "nothing selected"),
    ), lambda x: x.isNotNull())
    return runs.withColumn("status", status).withColumn("diagnostics", notes)


def watchdog(runs: DataFrame, age_seconds: Column, most_age: int = 1200) -> DataFrame:
    """runs (status, engine, feeds, fed, selected, published) with errors and a warning: bad status, no or an old heartbeat, an
    engine that never ended, feeds that all gave nothing; a run that only editors stopped is a warning."""
    c = F.col
    errors = F.filter(F.array(
        F.when(c("status").isNull() | c("status").isin("runtime_failure", "publication_failure", "unknown", "error"), "status"),
        F.when(age_seconds.isNull(), "no heartbeat").when(age_seconds > most_age, "stale heartbeat"),
        F.when(F.lower(c("engine")).isin("starting", "running", "collecting"), "engine"),
        F.when((c("feeds") > 0) & (c("fed") == 0), "all feeds empty"),
    ), lambda x: x.isNotNull())
    return runs.withColumn("errors", errors).withColumn("warning", (c("status") == "editorial_blocked") & (c("selected") > 0) & (c("published") == 0))


def health(attempts: DataFrame, group: str) -> DataFrame:
    """Per run: counts by outcome, and a status that names the worst thing that happened."""
    n = {k: F.count_if(F.col("result") == k) for k in ("published", "failed", "blocked", "ambiguous")}
    out = attempts.groupBy(group).agg(F.count("*").alias("attempts"), *[v.alias(k) for k, v in n.items()])
    status = F.when(F.col("attempts") == 0, "idle").when((F.col("published") == 0) & (F.col("failed") > 0), "publication_failure").when((F.col("published") == 0) & (F.col("blocked") > 0), "editorial_blocked").when(F.col("failed") > F.col("published"), "degraded").otherwise("healthy")
    return out.withColumn("status", status)


def stale(beats: DataFrame, group: str, at: str, asof: Column, limit: str) -> DataFrame:
    last = beats.groupBy(group).agg(F.max(at).alias("last_beat"))
    return last.withColumn("stale", asof - F.expr(limit) > F.col("last_beat"))


def missed(selected: DataFrame, handled: DataFrame, key: str) -> DataFrame:
    """Selected rows of which no outcome is known."""
    return selected.join(handled.select(key).distinct(), key, "left_anti")


def reclassified(attempts: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Failures that a block explains become editorial_blocked, with the block's reason."""
    why = blocks.groupBy(key).agg(F.max_by("reason", "at").alias("block_reason"))
    rows = attempts.join(why, key, "left")
    explained = (F.col("result") == "failed") & F.col("block_reason").isNotNull()
    return rows.withColumn("reason", F.when(explained, F.col("block_reason")).otherwise(F.col("reason"))).withColumn("result", F.when(explained, "editorial_blocked").otherwise(F.col("result"))).drop("block_reason")


def run_metrics(attempts: DataFrame, feeds: DataFrame, run_id: str, started: Column) -> DataFrame:
    """One row for a run: counts by outcome, reasons by number, feeds without candidates."""
    reasons = attempts.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    listed = reasons.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("rejections"))
    done = attempts.agg(F.count("*").alias("attempts"), *[F.count_if(F.col("result") == k).alias(k) for k in ("published", "failed", "blocked", "ambiguous")])
    fed = feeds.agg(F.count("*").alias("feeds"), F.count_if(F.col("candidates") == 0).alias("empty_feeds"))
    return done.crossJoin(fed).crossJoin(listed).select(F.lit(run_id).alias("run_id"), started.alias("started_at"), "*")  # one row each
