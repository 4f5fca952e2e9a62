"""Queries over the ordered editorial gates and run reports, with rule tables in the languages of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import SENTENCE_END, collapsed, normal_space
from newsloom.operators import audit, clusters, editorial
from newsloom.operators.rules import any_of
from newsloom.plans.base import ASOF, TITLE, asof, query, table, title_of
from newsloom.plans.ranked import _SCORED, scored

# The gates' tables for invented prose and license lines.
OVERRIDES = {
    "assembly": (10, {"action": ["released"], "actor": ["mit"], "topic": ["software"], "routine": ["copyright"]}),
    "security": (9, {"action": ["licensed"], "actor": ["gnu", "apache"], "topic": ["version"], "routine": ["work"]}),
    "business": (8, {"action": ["reserved"], "actor": ["company"], "topic": ["rights"], "routine": ["all of"]}),
    "global": (8, {"action": ["unter", "pour"], "actor": ["die", "les"], "topic": ["und"], "routine": ["de", "von"]}),
}
BASE = {
    "ceremonial": ["worthless"], "low_value": ["stupid", "idiot"], "metaphor": ["with", "para"], "concrete": ["the", "los"], "event": ["the", "der", "les", "para"],
    "commentary": ["here", "pour"], "decided": ["from", "avec"], "statement": ["this", "une", "eine"], "change": ["that", "und"],
}
SCOPE = {
    "security": ["gnu"], "roundup": ["click", "subscribe"], "institution_place": ["the"], "institution": ["from", "this"], "health_service": ["les"], "health_scope": ["une"], "health_event": ["pour"],
    "city": ["der", "die"], "city_crime": ["und", "mit"], "policy": ["los"], "policy_change": ["para"], "policy_harm": ["con"], "marker": ["with", "que"], "term": ["de", "of", "to"],
    "global": ["that"], "severe": ["and"], "consequence": ["in"], "country": ["ion", "ent", "que", "sch"],
}
RELEVANCE = {"home": ["that"], "mass": ["from"], "soft": ["here", "avec"], "crime": ["this", "eine"], "actor": ["the", "der"], "schedule": ["pour", "para"], "province": ["with", "und"], "exception": ["of", "de"], "low_value": ["buy", "click"]}
TOPICS = [("license", ["license", "licensed"]), ("contact", ["mail", "phone", "call"]), ("english", ["the", "and", "with"]), ("french", ["les", "une", "pour"]), ("german", ["der", "und", "mit"]), ("spanish", ["los", "para", "que"])]
OPINIONS, EVENTS, OFFICES, PLACES = ["here", "this", "pour"], ["the", "les", "der"], ["contact", "note", "license"], ["author", "info", "cc"]


def _has(text: str, terms: list[str]) -> str:
    return f"regexp_matches({text}, '{any_of(terms)}')" if terms else "false"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), title_of().alias("title"), F.coalesce("text", F.lit("")).alias("body"))


_DOCS = f"(SELECT doc_id AS id, {TITLE} AS title, lower({TITLE}) AS low, lower(coalesce(text, '')) AS body, lower({TITLE} || ' ' || coalesce(text, '')) AS whole, coalesce(text, '') AS text FROM documents)"


def _override_sql(terms: dict[str, list[str]]) -> str:
    return f"({_has('low', terms['action'])} AND ({_has('low', terms['actor'])} OR {_has('low', terms['topic'])}) AND NOT {_has('low', terms['routine'])})"


_NAMED = "CASE " + " ".join(f"WHEN {_override_sql(t)} THEN '{n}'" for n, (_, t) in OVERRIDES.items()) + " END"
_FLOOR = "CASE " + " ".join(f"WHEN {_override_sql(t)} THEN {f}" for _, (f, t) in OVERRIDES.items()) + " END"


@query(f"SELECT id, {', '.join(f'{_override_sql(t)} AS {n}' for n, (_, t) in OVERRIDES.items())}, {_FLOOR} AS floor FROM {_DOCS}")
def override_flags(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("title")
    return _pairs(spark, sf).select("id", *[editorial.override(low, t).alias(n) for n, (_, t) in OVERRIDES.items()], editorial.overridden(low, OVERRIDES).floor.alias("floor"))


_B = {k: _has("low", v) for k, v in BASE.items()}
_EARLY = f"CASE WHEN bad THEN 'invalid-publisher-endpoint' WHEN length(title) < 12 THEN 'short-title' WHEN {_B['ceremonial']} THEN 'ceremonial-non-news' WHEN {_B['low_value']} THEN 'low-value' WHEN {_B['metaphor']} AND NOT {_B['concrete']} THEN 'routine-metaphorical-topic' END"
_LATE = f"CASE WHEN NOT {_has('(low || chr(32) || body)', BASE['event'])} THEN 'no-concrete-event' WHEN {_B['commentary']} AND NOT {_B['decided']} THEN 'commentary-only' WHEN {_B['statement']} AND NOT {_B['change']} THEN 'routine-statement' WHEN event < 7 THEN 'below-event-threshold' END"


@query(
    f"""WITH d AS (SELECT x.*, s.event, coalesce(s.source, '') = 'forum' AS bad FROM {_DOCS} x JOIN {_SCORED} s USING (id)), e AS (SELECT *, {_EARLY} AS early, {_NAMED} AS named, {_FLOOR} AS floor, {_LATE} AS late FROM d)
    SELECT id, CASE WHEN early IS NOT NULL THEN false WHEN named IS NOT NULL THEN true ELSE late IS NULL END AS accepted,
        CASE WHEN early IS NOT NULL THEN 0 WHEN named IS NOT NULL THEN greatest(event, floor) WHEN late = 'no-concrete-event' THEN 0 ELSE event END AS score,
        CASE WHEN early IS NOT NULL THEN early WHEN named IS NOT NULL THEN named || '-override' ELSE coalesce(late, 'ok') END AS reason FROM e"""
)
def base_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).join(scored(spark, sf).select("id", "event", "source"), "id")
    gate = editorial.base_gate(F.col("title"), F.col("body"), F.col("event"), F.coalesce("source", F.lit("")) == "forum", BASE, OVERRIDES)
    return rows.select("id", gate.alias("g")).select("id", "g.accepted", "g.score", "g.reason")


_S = {k: _has("low", v) for k, v in SCOPE.items() if k != "country"}
_LIFTED = f"({_S['global']} OR {_S['severe']})"
_SCOPE = (
    f"CASE WHEN {_S['security']} THEN NULL WHEN {_S['roundup']} THEN 'roundup' WHEN {_S['institution_place']} AND {_S['institution']} AND NOT {_LIFTED} THEN 'institution' WHEN {_S['health_service']} AND {_S['health_scope']} AND {_S['health_event']} THEN NULL"
    f" WHEN {_S['city']} AND {_S['city_crime']} AND NOT {_LIFTED} THEN 'city-crime' WHEN {_S['policy']} AND {_S['policy_change']} AND {_S['policy_harm']} THEN NULL WHEN {_S['marker']} THEN CASE WHEN {_LIFTED} THEN NULL ELSE 'marker' END"
    f" WHEN NOT {_S['term']} OR {_LIFTED} OR {_S['consequence']} THEN NULL WHEN {' + '.join(f'contains(low, {chr(39)}{c}{chr(39)})::INT' for c in SCOPE['country'])} < 2 THEN 'local-term' END"
)


@query(f"SELECT id, {_SCOPE} AS scope FROM {_DOCS}")
def foreign_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", editorial.foreign_scope(F.col("title"), SCOPE).alias("scope"))


_R = {k: _has("low", v) for k, v in RELEVANCE.items()}
_NEAR = f"({_has('whole', RELEVANCE['home'])} OR {_R['mass']})"


@query(
    f"""SELECT id, CASE WHEN NOT {_NEAR} AND ({_R['soft']} OR ({_R['crime']} AND NOT {_has('whole', RELEVANCE['actor'])})) THEN 'foreign-soft-local' WHEN {_has('whole', RELEVANCE['schedule'])} THEN 'service-schedule'
    WHEN {_R['province']} AND NOT {_R['exception']} THEN 'provincial-routine' WHEN {_R['low_value']} AND NOT {_R['mass']} THEN 'low-value' END AS relevance FROM {_DOCS}"""
)
def relevance_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The noise rules have no word in these tables' languages, so the SQL leaves them out."""
    return _pairs(spark, sf).select("id", editorial.relevance(F.col("title"), F.col("body"), RELEVANCE).alias("relevance"))


_TOPIC = "coalesce(" + ", ".join("CASE " + " ".join(f"WHEN {_has(c, t)} THEN '{n}'" for n, t in TOPICS) + " END" for c in ("low", "lower(split_part(text, chr(10), 2))")) + ", 'general')"


@query(f"SELECT id, {_TOPIC} AS topic, {_has('low', OPINIONS)} AND NOT {_has('whole', EVENTS)} AS opinion_only FROM {_DOCS}")
def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.coalesce(F.get(F.split("body", "\n"), 1), F.lit(""))
    return _pairs(spark, sf).select("id", editorial.topic_of(F.col("title"), lead, TOPICS).alias("topic"), editorial.opinion_only(F.col("title"), F.col("body"), OPINIONS, EVENTS).alias("opinion_only"))


@query(
    f"""WITH s AS (SELECT *, lower(regexp_extract(title, '^([^:]*):', 1)) AS speaker, lower(trim(title)) AS t FROM {_DOCS})
    SELECT id, speaker <> '' AND len(list_filter(string_split_regex(speaker, '\\s+'), lambda w: w <> '')) <= 10 AND {_has('speaker', OFFICES)} AND {_has('speaker', PLACES)} AS local_speaker,
        {_has('t', OPINIONS)} OR (regexp_matches(t, '^(should|is|will|why)\\b') AND regexp_matches(t, '[?؟]$')) AS opinion FROM s"""
)
def speaker_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("id", editorial.local_speaker(F.col("title"), OFFICES, PLACES).alias("local_speaker"), editorial.is_opinion(F.col("title"), OPINIONS).alias("opinion"))


@query(
    f"""WITH s AS (SELECT id, title, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS s FROM {_DOCS}),
    b AS (SELECT *, array_to_string(s, ' ') AS body, lower(title || ' ' || array_to_string(s, ' ')) AS whole FROM s),
    w AS (SELECT *, len(list_filter(string_split_regex(title, '\\s+'), lambda x: x <> '')) AS tw, len(list_filter(string_split_regex(body, '\\s+'), lambda x: x <> '')) AS bw, len(list_filter(string_split_regex(coalesce(s[1], ''), '\\s+'), lambda x: x <> '')) AS lw FROM b)
    SELECT id, CASE WHEN tw < 4 THEN 'title-too-short' WHEN len(list_filter(string_split_regex(title, '[^\\p{{L}}\\p{{N}}_+]+'), lambda a: a <> 'MIT' AND regexp_matches(a, '^[A-Z][A-Z0-9+]{{2,}}$'))) > 0 THEN 'unexplained-acronym' WHEN len(s) = 0 THEN 'empty-body'
        WHEN length(body) < 70 OR bw < 12 THEN 'body-too-thin' WHEN lw < 6 THEN 'lead-fragment' WHEN {_has('whole', ['click here', 'see above'])} THEN 'refers-to-missing-content' WHEN {_has('lower(title)', ['with'])} THEN 'service-schedule'
        WHEN NOT regexp_matches(s[-1], '[.!?؟»")]$') THEN 'body-truncated' END AS problem FROM w"""
)
def caption_problems(spark: SparkSession, sf: str) -> DataFrame:
    s = F.filter(F.transform(F.split("body", SENTENCE_END), lambda x: collapsed(x)), lambda x: x != "")
    problem = editorial.caption_problem(F.col("title"), F.col("s"), ["MIT"], ["click here", "see above"], ["with"], r"""[.!?؟»")]$""")
    return _pairs(spark, sf).withColumn("s", s).select("id", problem.alias("problem"))


@query(
    """WITH p AS (SELECT conv_id, turn, role, text AS summary, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), q AS (SELECT conv_id, turn, split_part(summary, '.', 1) AS title, summary, coalesce(source, '') AS source, turn % 4 = 1 AS abroad FROM p WHERE role = 'assistant' AND source IS NOT NULL),
    n AS (SELECT *, title || ' ' || summary AS text, lower(title || ' ' || summary) AS low, lower(source) AS old, len(list_filter(string_split(regexp_replace(summary, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentences FROM q),
    r AS (SELECT *, CASE WHEN len(regexp_extract_all(title, '\\p{L}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(title, '[a-zA-Z]'))::DOUBLE / len(regexp_extract_all(title, '\\p{L}')) END AS a, CASE WHEN len(regexp_extract_all(summary, '\\p{L}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(summary, '[a-zA-Z]'))::DOUBLE / len(regexp_extract_all(summary, '\\p{L}')) END AS b FROM n)
    SELECT conv_id, turn, CASE WHEN trim(title) = '' OR trim(summary) = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN regexp_matches(low, '(as an ai|here is|summary:)') THEN 'meta_phrase' END, CASE WHEN regexp_matches(text, '(```|\\{\\{|\\}\\}|<[a-z]+>)') THEN 'artefact' END, CASE WHEN sentences > 3 THEN 'too_many_sentences' END,
        CASE WHEN length(summary) > 750 THEN 'too_long' END, CASE WHEN len(list_filter(regexp_extract_all(text, '[ßäöüÄÖÜ]{2,}'), lambda w: upper(w) <> 'ÄÖ')) > 0 THEN 'stray_script' END, CASE WHEN a < 0.6 THEN 'title_script_low' END, CASE WHEN b < CASE WHEN abroad THEN 0.6 ELSE 0.45 END THEN 'summary_script_low' END, CASE WHEN regexp_matches(text, '[ñ]') THEN 'foreign_script' END,
        CASE WHEN (contains(low, 'eaux') AND NOT contains(old, 'eaux')) OR (contains(low, 'thion') AND NOT contains(old, 'thion')) THEN 'place_mismatch' END], lambda x: x IS NOT NULL), ',') END AS problems FROM r"""
)
def rewrite_problems(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of a rewrite but the numbers and roles, which output_numbers and the tests hold."""
    c = table(spark, sf, "conversations").withColumn("source", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' and source is not null")
    title = F.get(F.split("text", r"\."), 0)
    found = editorial.rewrite_problems(title, F.col("text"), F.col("source"), F.col("turn") % 4 == 1, inside="[a-zA-Z]", letters=r"\p{L}", stray="[ßäöüÄÖÜ]{2,}", alien="[ñ]", brands=["ÄÖ"], places=["eaux", "thion"])
    return c.select("conv_id", "turn", F.array_join(F.filter(found, lambda x: x != "new_number"), ",").alias("problems"))


_E = "(SELECT event_id AS id, ts AS t, event_type AS kind, ['k' || (user_id % 40), 'v' || floor(value / 20)::INT] AS anchors, [('c' || user_id % 30)] AS places, [('g' || user_id % 6)] AS regions, floor(value)::INT AS toll FROM events)"


@query(
    f"""WITH e AS {_E}, p AS (SELECT a.id AS a, b.id AS b, b.t AS bt, epoch_us(a.t) - epoch_us(b.t) AS age, a.toll AS n, b.toll AS o, CASE WHEN NOT list_has_any(a.places, b.places) THEN 0 WHEN len(list_intersect(a.anchors, b.anchors)) >= 2 THEN 2 ELSE 1 END AS strength FROM e a JOIN e b ON a.kind = b.kind AND b.t < a.t AND b.t >= a.t - INTERVAL 18 HOURS AND (list_has_any(a.places, b.places) OR list_has_any(a.regions, b.regions) OR list_has_any(a.anchors, b.anchors)))
    SELECT a AS id, b AS match_id, strength, n >= 3 AND n >= o + 3 AND n >= o * 1.3 AS released FROM p WHERE (strength = 2 AND age <= 64800000000) OR (strength = 1 AND age <= 28800000000) QUALIFY row_number() OVER (PARTITION BY a ORDER BY bt DESC, b DESC) = 1"""
)
def incident_matches(spark: SparkSession, sf: str) -> DataFrame:
    user, value = F.col("user_id"), F.floor("value").cast("int")
    text = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("t"), F.col("event_type").alias("kind"), F.array(text("k", user % 40), text("v", F.floor(F.col("value") / 20))).alias("anchors"),
        F.array(text("c", user % 30)).alias("places"), F.array(text("g", user % 6)).alias("regions"), value.alias("toll"),
    )
    return editorial.incident_matches(rows)


@query(
    """WITH f AS (SELECT lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS h, page_id,
        lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))) AS own FROM pages), held AS (SELECT split_part(t, ' | ', 1) AS x FROM f WHERE page_id % 9 = 0 UNION SELECT h FROM f WHERE page_id % 9 = 0)
    SELECT page_id FROM f WHERE page_id % 10 <> 0 AND own NOT IN (SELECT x FROM held WHERE x <> '')"""
)
def quarantine_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without a quarantined id, and without the title or heading of a quarantined page."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    held = editorial.quarantined_titles(pages.where("page_id % 9 = 0"))
    ids = pages.where("page_id % 10 = 0").select(F.col("page_id").cast("string").alias("id"))
    rows = pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return editorial.without_quarantined(rows, ids, held, "page_id").select("page_id")


@query("SELECT conv_id, bool_or(turn = 0 AND length(text) % 2 = 0) AND (bool_or(turn = 0 AND length(text) % 3 = 0) OR coalesce(bool_or(length(text) % 5 <> 0) FILTER (turn = 1), true)) AS stands FROM conversations GROUP BY conv_id")
def settled_repeats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text")
    first = lambda c: F.max(F.when(F.col("turn") == 0, c))
    votes = table(spark, sf, "conversations").groupBy("conv_id").agg(first(size % 2 == 0).alias("first"), first(size % 3 == 0).alias("related"), F.max(F.when(F.col("turn") == 1, size % 5 != 0)).alias("second"))
    return votes.select("conv_id", editorial.settled_repeat(F.col("first"), F.col("related"), F.col("second")).alias("stands"))


@query("WITH c AS (SELECT event_id, ts, user_id % 7 AS model, CASE WHEN user_id % 7 IN (1, 2) THEN 'shared' ELSE 'own ' || (user_id % 7) END AS key, CASE WHEN user_id % 7 < 3 THEN ts - INTERVAL 8 HOURS ELSE ts END AS here FROM events), u AS (SELECT *, here::DATE AS quota_day, count(*) OVER (PARTITION BY key, here::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM c) SELECT event_id, quota_day, used, model = 6 OR used < (10 + 5 * CASE WHEN model = 2 THEN 1 ELSE model END) * least(1.0, ((epoch_us(here) - epoch_us(date_trunc('day', here))) / 3.6e9 + 1) / 24) AS allowed FROM u")
def paced_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls within the share of their key's day; some keys' days begin at midnight Pacific time (UTC - 8 in these tables' winter)."""
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("t"), (F.col("user_id") % 7).alias("model"))
    budgets = spark.createDataFrame([(m, "shared" if m in (1, 2) else f"own {m}", "America/Los_Angeles" if m < 3 else "UTC", 0 if m == 6 else 10 + 5 * (1 if m == 2 else m)) for m in range(7)], "model long, key string, zone string, budget int")
    return audit.paced(rows, budgets, "t", "model", "event_id").select("event_id", "quota_day", "used", "allowed")


@query("SELECT count(b) AS expected, count(a) AS found, count_if(a IS NULL)::BIGINT AS missing, count_if(b IS NULL)::BIGINT AS extra, min(b) FILTER (a IS NULL) AS first_missing, count_if(a IS NULL) = 0 AND count_if(b IS NULL) = 0 AS complete FROM (SELECT DISTINCT page_id AS a FROM pages) FULL JOIN (SELECT DISTINCT doc_id AS b FROM documents) ON a = b")
def corpus_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.completeness(table(spark, sf, "pages").select(F.col("page_id").alias("id")), table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id")


_RUNS = """(SELECT ts::DATE AS day, user_id % 20 AS engine_id, CASE user_id % 20 WHEN 7 THEN 'failed' WHEN 8 THEN NULL ELSE 'done' END AS run_status, count_if(event_type = 'view')::BIGINT AS selected, count_if(event_type = 'purchase')::BIGINT AS published, count_if(event_type = 'error' AND value < 1)::BIGINT AS missed, count_if(event_type = 'error' AND value > 60)::BIGINT AS failed,
    count_if(event_type = 'error' AND value > 90)::BIGINT AS ambiguous, count_if(event_type = 'click')::BIGINT AS blocked, count_if(event_type = 'signup')::BIGINT AS duplicates, count(*) AS attempts, max(ts) AS last_beat, min(event_type) AS engine FROM events GROUP BY ALL)"""
_GAP = "selected > 0 AND published = 0"
_BAD = "coalesce(run_status, '') IN ('failed', 'error', 'unknown', '')"
_STATUS = f"CASE WHEN missed > 0 OR failed > 0 OR ambiguous > 0 THEN 'publication_failure' WHEN {_BAD} THEN 'runtime_failure' WHEN {_GAP} AND missed = 0 AND attempts > 0 AND blocked + duplicates >= selected THEN 'editorial_blocked' WHEN {_GAP} THEN 'publication_failure' ELSE 'healthy' END"


@query(
    f"""WITH r AS (SELECT *, {_STATUS} AS status FROM {_RUNS}), a AS (SELECT *, (epoch_us(TIMESTAMP '{ASOF}') - epoch_us(last_beat)) / 1e6 AS age FROM r)
    SELECT day, engine_id, status, array_to_string(list_filter([CASE WHEN {_BAD} THEN 'runtime' END, CASE WHEN missed > 0 THEN 'missed' END, CASE WHEN failed > 0 OR ambiguous > 0 THEN 'failed' END, CASE WHEN {_GAP} THEN 'gap' END, CASE WHEN blocked > 0 THEN 'blocked' END, CASE WHEN selected = 0 AND attempts = 0 THEN 'nothing selected' END], lambda x: x IS NOT NULL), ',') AS diagnostics,
        array_to_string(list_filter([CASE WHEN status IN ('runtime_failure', 'publication_failure') THEN 'status' END, CASE WHEN age > 86400 THEN 'stale heartbeat' END, CASE WHEN selected + blocked > 0 AND blocked = 0 THEN 'all feeds empty' END], lambda x: x IS NOT NULL), ',') AS errors, status = 'editorial_blocked' AND selected > 0 AND published = 0 AS warning FROM a"""
)
def run_watchdog(spark: SparkSession, sf: str) -> DataFrame:
    kind, value, n = F.col("event_type"), F.col("value"), F.count_if
    engine = F.col("user_id") % 20
    runs = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), engine.alias("engine_id")).agg(
        n(kind == "view").alias("selected"), n(kind == "purchase").alias("published"), n((kind == "error") & (value < 1)).alias("missed"), n((kind == "error") & (value > 60)).alias("failed"), n((kind == "error") & (value > 90)).alias("ambiguous"),
        n(kind == "click").alias("blocked"), n(kind == "signup").alias("duplicates"), F.count("*").alias("attempts"), F.max("ts").alias("last_beat"), F.min("event_type").alias("engine"),
    )
    runs = runs.withColumn("run_status", F.when(F.col("engine_id") == 7, "failed").when(F.col("engine_id") != 8, "done"))
    judged = audit.run_health(runs).withColumn("feeds", F.col("selected") + F.col("blocked")).withColumn("fed", F.col("blocked"))
    age = (F.unix_micros(asof()) - F.unix_micros(F.col("last_beat").cast("timestamp"))) / 1e6
    out = audit.watchdog(judged, age, 86_400)
    return out.select("day", "engine_id", "status", F.array_join("diagnostics", ",").alias("diagnostics"), F.array_join("errors", ",").alias("errors"), "warning")


_FACE = "(25 * (lang = 'en')::INT - 25 * (source = 'forum')::INT + 8 * (id % 2 = 0)::INT + 5 * (length(low) > 500)::INT + 3 * (id % 3 = 0)::INT + 4 * (id % 5 = 0)::INT + keyword + recency)"


@query(f"WITH t AS (SELECT id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS c, {_FACE.replace('(source', '(coalesce(source, chr(45))').replace('(lang', '(coalesce(lang, chr(45))').replace('length(low)', 'coalesce(length(low), 0)')} AS score FROM {_SCORED}) SELECT id, score FROM t QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, id) = 1")
def cluster_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Of the stories of one wording the one with the best representative score, the first of equals."""
    s = scored(spark, sf)
    flag = lambda c: F.coalesce(c, F.lit(False))
    score = editorial.representative_score(F.when(flag(F.col("lang") == "en"), 25).otherwise(0), F.col("keyword") + F.col("recency"), aggregator=flag(F.col("source") == "forum"), resolved=F.col("id") % 2 == 0, text=flag(F.length("low") > 500), image=F.col("id") % 3 == 0, video=F.col("id") % 5 == 0)
    rows = s.select("id", F.lower(normal_space(F.col("title"))).alias("cluster"), score.alias("score"))
    return clusters.representatives(rows, "cluster", F.desc("score"), F.col("id")).select("id", "score")


@query("SELECT event_id, list_contains(list(event_type || floor(value / 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), event_type || floor(value / 10)::INT) IS TRUE AS repeated FROM events")
def immediate_repeats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", F.concat("event_type", F.floor(F.col("value") / 10).cast("int")).alias("title"))
    return editorial.immediate_repeats(rows, "user_id", "title", "ts", "event_id").select("event_id", "repeated")


@query(
    """WITH d AS (SELECT ts::DATE AS day, event_id, ts, floor(value / 20)::INT AS level, event_type || floor(value / 20)::INT AS title FROM events WHERE event_type <> 'view'), u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY day, title ORDER BY ts, event_id) = 1),
    n AS (SELECT ts::DATE AS day, max(ts) AS latest FROM events GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY level DESC, ts DESC, event_id) AS n, count(*) OVER (PARTITION BY day) AS c FROM u)
    SELECT day, event_id, level, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS place FROM t JOIN n USING (day) WHERE n <= 5 AND c >= 3 AND hour(latest) >= 22"""
)
def evening_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's five best items (a top-k report), on days with three of them whose last event is late in the evening."""
    e = table(spark, sf, "events")
    level = F.floor(F.col("value") / 20).cast("int")
    items = e.where("event_type <> 'view'").select(F.to_date("ts").alias("day"), F.col("event_id").alias("id"), F.col("ts").alias("t"), level.alias("level"), F.concat("event_type", level).alias("title"))
    now = e.groupBy(F.to_date("ts").alias("day")).agg(F.max("ts").alias("at"))
    return editorial.daily_digest(items, now).select("day", F.col("id").alias("event_id"), "level", "place")

