"""Queries over documents as stories: scores, gates with reasons, similarity joins, clusters, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import tokens as K
from newsloom.functions.text import normal_space, story_head
from newsloom.operators import clusters, ranking, scores, similarity
from newsloom.operators.memory import without_seen
from newsloom.operators.rules import Rule, any_of, count_terms, first_reason, has
from newsloom.plans.base import ASOF, STORIES, TITLE, asof, query, stories, table, title_of
from newsloom.runtime import checkpointed

# A rule table in the languages of the tables.
VERY = ["license", "released", "unter", "avec", "from"]
PLAIN = ["with", "that", "pour", "mit", "para", "this"]
ACTORS = ["the", "les", "der", "los"]
CRITICAL = ["worthless", "stupid", "error", "rights"]
TERMS = {"high": ["license", "rights"], "medium": ["version", "public"], "actions": ["with", "from", "pour"], "entities": ["the", "les", "der"], "concrete": ["gnu", "apache"], "routine": ["this", "une", "eine"], "low": ["###", "***", "!!"]}
COUNTRIES = ["work", "license", "all"]
# Events by groups of terms, and words that name events and places, in the languages of the tables.
EVENTS = [[["apache"], ["license"], ["version"]], [["copyright", "rights"], ["reserved"], ["company", "inc"]]]
EVENT_WORDS, PLACE_WORDS = ["license", "released", "copyright"], ["gnu", "apache", "cc", "mit"]


def _has(word: str) -> str:
    return f"contains(norm, '{word}')"


def _count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t.lower()}')::INT" for t in terms) + ")"


_RECENCY = "CASE WHEN age < 1 THEN 12 WHEN age < 3 THEN 10 WHEN age < 6 THEN 8 WHEN age < 12 THEN 5 WHEN age < 24 THEN 3 WHEN age <= 36 THEN 1 ELSE 0 END"
_AGE = f"date_diff('second', published_at, TIMESTAMP '{ASOF}') / 3600.0"
_KEYWORD = f"least(8 * {_count('low', VERY)} + 3 * {_count('low', PLAIN)} + CASE WHEN {_count('low', ACTORS)} > 0 AND {_count('low', CRITICAL)} > 0 THEN 14 ELSE 0 END, 55)"
_N = {k: _count("low", v) for k, v in TERMS.items()}
_EVENT = (
    f"least(5 * {_N['high']}, 20) + least(2 * {_N['medium']}, 4) + least(2 * {_N['actions']}, 6) + CASE WHEN {_N['entities']} > 0 AND {_N['actions']} > 0 THEN 1 ELSE 0 END"
    f" + CASE WHEN {_N['concrete']} > 0 THEN 2 ELSE 0 END + 2 - least(2 * {_N['routine']}, 6) - least(8 * {_N['low']}, 16)"
)
_SCORED = f"(SELECT *, {_KEYWORD} AS keyword, {_RECENCY} AS recency, {_EVENT} AS event FROM (SELECT *, {_AGE} AS age FROM {STORIES}))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = stories(spark, sf).withColumn("age", (F.unix_timestamp(asof()) - F.unix_timestamp("published_at")) / 3600)
    low = F.col("low")
    return rows.select(
        "*", scores.keyword_importance(low, VERY, PLAIN, ACTORS, CRITICAL).alias("keyword"), scores.recency_score(F.col("age")).alias("recency"),
        scores.event_score(low, TERMS, F.lit(6), F.lit(1)).alias("event"),
    )


@query(f"SELECT id, keyword, recency, event, keyword + recency AS importance FROM {_SCORED}")
def story_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", "keyword", "recency", "event", (F.col("keyword") + F.col("recency")).alias("importance"))


_WORDS = {"license": ["license", "licensed"], "insult": ["worthless", "stupid", "idiot"], "contact": ["mail", "phone", "call"]}


def _rules(title: Column, low: Column, event: Column) -> list[Rule]:
    return [
        Rule("short_title", F.length(title) < 12),
        Rule("list", low.contains(" | ")),
        Rule("shouting", low.contains("!!")),
        Rule("symbols", low.contains("###")),
        Rule("license_note", has(low, _WORDS["license"])),
        Rule("insult", has(low, _WORDS["insult"])),
        Rule("contact", has(low, _WORDS["contact"])),
        Rule("no_event", event < 3),
    ]


_REASON = (
    "CASE WHEN length(title) < 12 THEN 'short_title' WHEN contains(low, ' | ') THEN 'list' WHEN contains(low, '!!') THEN 'shouting' WHEN contains(low, '###') THEN 'symbols' "
    + " ".join(f"WHEN regexp_matches(low, '{any_of(_WORDS[k])}') THEN '{r}'" for k, r in (("license", "license_note"), ("insult", "insult"), ("contact", "contact")))
    + " WHEN event < 3 THEN 'no_event' END"
)
_GATED = f"(SELECT *, {_REASON} AS reason FROM {_SCORED})"


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).withColumn("reason", first_reason(_rules(F.col("title"), F.col("low"), F.col("event"))))


@query(f"SELECT id, reason, reason IS NULL AS accepted FROM {_GATED}")
def gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).select("id", "reason", F.col("reason").isNull().alias("accepted"))


@query(f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, avg(event)::DOUBLE AS mean_event FROM {_GATED} GROUP BY 1")
def rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.avg("event").alias("mean_event"))


@query(f"SELECT source, lang, reason, count(*) AS n FROM (SELECT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, coalesce(reason, 'accepted') AS reason FROM {_GATED}) GROUP BY CUBE (source, lang, reason)")
def report_cube(spark: SparkSession, sf: str) -> DataFrame:
    rows = gated(spark, sf).select(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("reason", F.lit("accepted")).alias("reason"))
    return rows.cube("source", "lang", "reason").agg(F.count("*").alias("n"))


_FRESH = "CASE WHEN age < -300 / 3600.0 THEN 'future' WHEN age <= 0.5 THEN 'fresh' WHEN age <= 12 AND contains(low, 'license') THEN 'rescued' ELSE 'late' END"


@query(f"SELECT id, {_FRESH} AS freshness FROM {_SCORED}")
def freshness_gate(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.streaming.stories import freshness

    return stories(spark, sf).select("id", freshness(F.col("published_at"), asof(), F.col("low").contains("license")).alias("freshness"))


_TIER = f"CASE WHEN {_count('low', CRITICAL)} > 0 THEN 4 WHEN keyword >= 25 THEN 3 WHEN keyword >= 12 THEN 2 ELSE 1 END"


@query(f"WITH t AS (SELECT id, {_TIER} AS tier, keyword + recency AS score FROM {_SCORED}), m AS (SELECT max(tier) AS top, count_if(tier >= 4) AS fours FROM t) SELECT id, tier, score FROM t, m WHERE tier >= CASE WHEN top >= 4 AND fours >= 2 THEN 4 ELSE 2 END")
def tier_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    low, never = F.col("low"), F.lit(False)
    tier = scores.publication_tier(ceremonial=never, rescued=count_terms(low, CRITICAL) > 0, security=never, critical=F.col("keyword") >= 25, major=F.col("keyword") >= 12, sports_level=F.lit(0), editor_tier=F.lit(0))
    return ranking.eligible_tiers(scored(spark, sf).select("id", tier.alias("tier"), (F.col("keyword") + F.col("recency")).alias("score")))


_PLACED = f"(SELECT id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS family_place FROM (SELECT id, coalesce(source, '-') AS source, keyword + recency AS score FROM {_SCORED}))"


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("id", F.coalesce("source", F.lit("-")).alias("source"), (F.col("keyword") + F.col("recency")).alias("score"))


@query(f"SELECT *, row_number() OVER (ORDER BY adjusted DESC, id) AS place FROM (SELECT *, score - CASE family_place WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 10 ELSE 18 END AS adjusted FROM {_PLACED}) ORDER BY adjusted DESC, id LIMIT 50")
def diversity_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty stories that a greedy walk with family penalties picks first (a top-k report)."""
    return ranking.top(ranking.diverse_order(_families(spark, sf), "source", "score", "id"), 50, F.desc("adjusted"), F.col("id"))


@query(f"SELECT * FROM {_PLACED} WHERE family_place <= 2 OR score >= 40")
def family_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.family_cap(_families(spark, sf), "source", "score", "id", exempt=40)


@query(f"SELECT id, source, ok, coalesce(sum(ok::INT) OVER (PARTITION BY source ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 AS judged FROM (SELECT id, coalesce(source, '-') AS source, keyword + recency AS score, reason IS NULL AS ok FROM {_GATED})")
def pool_walk(spark: SparkSession, sf: str) -> DataFrame:
    rows = gated(spark, sf).select("id", F.coalesce("source", F.lit("-")).alias("source"), (F.col("keyword") + F.col("recency")).alias("score"), F.col("reason").isNull().alias("ok"))
    return ranking.walk(rows, "source", "ok", 4, F.desc("score"), F.col("id")).select("id", "source", "ok", "judged")


def title_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of at least two tokens with their sets; rows of one wording share the smallest id, so copies meet once."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lower(normal_space(title_of())).alias("norm"))
    one = t.groupBy("norm").agg(F.min("id").alias("id"))
    norm = F.col("norm")
    numbers = K.numbers_in(norm)
    return one.select("id", "norm", K.title_tokens(norm).alias("tokens"), K.story_tokens(norm).alias("story"), numbers.alias("numbers"), K.fingerprint(norm).alias("keys"), similarity.signatures(norm, numbers, EVENTS, EVENT_WORDS, PLACE_WORDS).alias("signature"))


_STOPS = "[" + ", ".join(f"'{v}'" for v in K.STOP_WORDS) + "]"
_GENERIC = "[" + ", ".join(f"'{v}'" for v in K.GENERIC_WORDS) + "]"
_KEYS = f"""list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(norm, '\\p{{L}}{{3,}}'), lambda w: NOT list_contains({_STOPS}, w)),
    lambda w: substr(w, 1, 1) || regexp_replace(substr(regexp_replace(w, '^(.{{3,}}?)({"|".join(K.SUFFIXES)})$', '\\1'), 2), '{K.VOWELS}', '', 'g'))), lambda k: length(k) >= 2)"""
_SETS = f"""norms AS (SELECT min(doc_id) AS id, norm FROM (SELECT doc_id, lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))) AS norm FROM documents) GROUP BY norm),
    toks AS (SELECT id, norm, list_filter(list_distinct(string_split(regexp_replace(norm, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), lambda w: length(w) >= 2 AND NOT list_contains({_STOPS}, w)) AS tokens, {_KEYS} AS keys, list_distinct(regexp_extract_all(norm, '[0-9]+')) AS numbers FROM norms),
    sets AS (SELECT *, list_filter(tokens, lambda w: NOT list_contains({_GENERIC}, w)) AS story FROM toks)"""
_HITS = [" + ".join(f"({' OR '.join(_has(w) for w in g)})::INT" for g in groups) for groups in EVENTS]
_SIGNED = f"""signed AS (SELECT id, '' AS key FROM sets WHERE false {' '.join(f"UNION ALL SELECT id, 'event {k}' FROM sets WHERE {h} >= 2" for k, h in enumerate(_HITS))}
    UNION ALL SELECT id, n || ' ' || e || ' ' || p FROM (SELECT id, norm, unnest(numbers) AS n FROM sets), (VALUES {', '.join(f"('{e}')" for e in EVENT_WORDS)}) x(e), (VALUES {', '.join(f"('{p}')" for p in PLACE_WORDS)}) y(p) WHERE contains(norm, e) AND contains(norm, p)),
    stars AS (SELECT DISTINCT min(id) OVER (PARTITION BY key) AS a, id AS b FROM signed)"""
_JAC = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_CON = "CASE WHEN least(len({0}), len({1})) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / least(len({0}), len({1})) END"
_SIM = f"CASE WHEN len(a.story) = 0 OR len(b.story) = 0 THEN {_JAC.format('a.tokens', 'b.tokens')} ELSE 0.45 * {_JAC.format('a.story', 'b.story')} + 0.55 * {_CON.format('a.story', 'b.story')} END"
_SAME = f"({_SIM} >= 0.72 OR (len(list_intersect(a.story, b.story)) >= 4 AND {_SIM} >= 0.5) OR (least(len(a.story), len(b.story)) <= 3 AND {_JAC.format('a.tokens', 'b.tokens')} >= 0.8) OR (list_has_any(a.numbers, b.numbers) AND {_SIM} >= 0.45 AND len(list_intersect(a.story, b.story)) >= 3))"


@query(f"WITH {_SETS}, {_SIGNED} SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id < b.id AND list_has_any(a.tokens, b.tokens) WHERE {_SAME} UNION SELECT a, b FROM stars WHERE a < b")
def same_story_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.story_pairs(title_sets(spark, sf), "story")


@query(f"WITH {_SETS}, {_SIGNED} SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id < b.id AND list_has_any(a.tokens, b.tokens) WHERE {_SAME} OR (len(list_intersect(a.story, b.story)) >= 3 AND ({_CON.format('a.story', 'b.story')} >= 0.78 OR ({_CON.format('a.story', 'b.story')} >= 0.62 AND list_has_any(a.numbers, b.numbers)))) UNION SELECT a, b FROM stars WHERE a < b")
def same_event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.story_pairs(title_sets(spark, sf), "event")


@query(f"WITH {_SETS} SELECT a.id AS a, b.id AS b, len(list_intersect(a.keys, b.keys))::INT AS shared FROM sets a JOIN sets b ON a.id < b.id AND list_has_any(a.keys, b.keys) WHERE (len(list_intersect(a.keys, b.keys)) >= 6 AND {_CON.format('a.keys', 'b.keys')} >= 0.4) OR (len(list_intersect(a.keys, b.keys)) >= 4 AND {_CON.format('a.keys', 'b.keys')} >= 0.6)")
def fp_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.overlap_pairs(title_sets(spark, sf).select("id", "keys"))


@query(f"WITH {_SETS} SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id <> b.id AND list_has_any(a.keys, b.keys) WHERE len(a.keys) >= 5 AND len(list_intersect(a.keys, b.keys)) = len(a.keys) AND len(b.keys) - len(a.keys) <= 2")
def containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.containment_pairs(title_sets(spark, sf).select("id", "keys")).select("a", "b")


@query(f"WITH {_SETS} SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id <> b.id AND list_has_any(a.keys, b.keys) WHERE (len(a.keys) >= 5 AND len(list_intersect(a.keys, b.keys)) = len(a.keys) AND len(b.keys) - len(a.keys) <= 2) OR (len(list_intersect(a.keys, b.keys)) >= 4 AND {_CON.format('a.keys', 'b.keys')} >= 0.5)")
def same_headline_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier and later headlines (in either order of ids) that repeat each other by containment or by half of the words."""
    return similarity.headline_pairs(title_sets(spark, sf).select("id", "keys")).select("a", "b")


@query(
    f"""WITH {_SETS}, df AS (SELECT key, count(*) AS df FROM (SELECT unnest(keys) AS key FROM sets) GROUP BY key),
    p AS (SELECT a.id AS a, b.id AS b, unnest(list_intersect(a.keys, b.keys)) AS key FROM sets a JOIN sets b ON a.id < b.id AND list_has_any(a.keys, b.keys))
    SELECT a, b, count(*) AS shared, count_if(df <= 2)::BIGINT AS rare FROM p JOIN df USING (key) GROUP BY a, b HAVING count(*) >= 6 AND count_if(df <= 2) >= 5"""
)
def rare_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.rare_follow_up(title_sets(spark, sf).select("id", "keys"))


_AT = f"(TIMESTAMP '{ASOF}' - to_seconds((id * 613) % 129600 * 3))"


def timed_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Title sets as stories spread over four and a half days."""
    at = F.timestamp_seconds(F.unix_timestamp(asof()) - (F.col("id") * 613) % 129_600 * 3)
    return checkpointed(title_sets(spark, sf).select("id", "keys", at.alias("t")))


@query(
    f"""WITH {_SETS}, timed AS (SELECT id, keys, {_AT} AS t FROM sets), k AS (SELECT id, t, unnest(keys) AS key FROM timed),
    p AS (SELECT a.id AS a, b.id AS b, CASE WHEN (a.t, a.id) > (b.t, b.id) THEN a.id ELSE b.id END AS later, unnest(list_intersect(a.keys, b.keys)) AS key FROM timed a JOIN timed b ON a.id < b.id AND list_has_any(a.keys, b.keys)
        WHERE len(list_intersect(a.keys, b.keys)) >= 6 AND abs(epoch(a.t) - epoch(b.t)) <= 36 * 3600),
    c AS (SELECT a, b, later, key, (SELECT count(*) FROM k WHERE k.key = p.key AND k.t <= l.t AND k.t >= l.t - INTERVAL 36 HOURS) AS df FROM p JOIN timed l ON l.id = later)
    SELECT a, b, later, count(*) AS shared, count_if(df <= 3)::BIGINT AS rare FROM c GROUP BY ALL HAVING count(*) >= 6 AND count_if(df <= 3) >= 3"""
)
def rare_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Follow-ups by words that are rare in the 36 hours before the later story."""
    return similarity.rare_in_window(timed_sets(spark, sf), 36, rarest=3, least_rare=3)


_LATER = "(a.t, a.id) > (b.t, b.id) AND list_has_any(a.keys, b.keys) AND epoch_us(a.t) - epoch_us(b.t)"


@query(
    f"""WITH {_SETS}, timed AS (SELECT id, keys, {_AT} AS t FROM sets)
    SELECT a.id AS later, b.id AS earlier, len(list_intersect(a.keys, b.keys))::INT AS shared FROM timed a JOIN timed b ON {_LATER} <= 36 * 3600000000
    WHERE (len(list_intersect(a.keys, b.keys)) >= 6 AND {_CON.format('a.keys', 'b.keys')} >= 0.4) OR (len(list_intersect(a.keys, b.keys)) >= 4 AND {_CON.format('a.keys', 'b.keys')} >= 0.6)"""
)
def overlaps_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Stories told again within 36 hours, by the keys of their titles."""
    return similarity.overlap_within(timed_sets(spark, sf)).select(F.col("a").alias("later"), F.col("b").alias("earlier"), "shared")


# Lines of a post that are story text, the first two of them, written out apart from the library.
_HEAD = """array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT regexp_matches(x, '^[━─—-]{3,}$')
    AND NOT regexp_matches(x, '(?i)\\bhttps?://\\S|\\bwww\\.\\S|\\bt\\.me/\\S') AND NOT (contains(x, '·') AND length(x) < 40) AND NOT (regexp_matches(x, '^[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}]') AND length(x) < 30))[:2], ' ')"""
_HEADS = f"""firsts AS (SELECT min(doc_id) AS id, norm, arg_min(coalesce(text, ''), doc_id) AS text, nullif(arg_min(coalesce(source, ''), doc_id), '') AS speaker
        FROM (SELECT *, lower(trim(regexp_replace({_HEAD}, '\\s+', ' ', 'g'))) AS norm FROM documents) GROUP BY norm),
    heads AS (SELECT id, speaker, {_KEYS} AS keys, {_AT} AS t, list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda n: length(n) >= 3 AND NOT regexp_full_match(n, '(13|14|19|20)[0-9]{{2}}') AND NOT ends_with(n, '00')) AS numbers FROM firsts)"""


def timed_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The first two lines of story text of each document, one row for each wording, with the numbers and the source of its first."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    rows = d.select("doc_id", F.lower(normal_space(story_head(F.col("text")))).alias("norm"), K.distinctive_numbers(F.col("text")).alias("numbers"), "source")
    first = lambda c: F.min_by(c, "doc_id").alias(c)
    one = rows.groupBy("norm").agg(F.min("doc_id").alias("id"), first("numbers"), first("source"))
    at = F.timestamp_seconds(F.unix_timestamp(asof()) - (F.col("id") * 613) % 129_600 * 3)
    return checkpointed(one.select("id", K.fingerprint(F.col("norm")).alias("keys"), at.alias("t"), "numbers", F.nullif("source", F.lit("")).alias("speaker")))


@query(
    f"""WITH {_HEADS} SELECT a.id AS later, b.id AS earlier, len(list_intersect(a.keys, b.keys))::INT AS shared FROM heads a JOIN heads b ON {_LATER} <= 12 * 3600000000
    WHERE least(len(a.keys), len(b.keys)) >= 5 AND len(list_intersect(a.keys, b.keys)) >= 6 AND {_CON.format('a.keys', 'b.keys')} >= 0.5"""
)
def heads_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose first lines tell the same within twelve hours."""
    return similarity.heads_within(timed_heads(spark, sf)).select(F.col("a").alias("later"), F.col("b").alias("earlier"), "shared")


#: Keys too common to tell two posts of one number apart.
COMMON_KEYS = ["tn", "tht", "ths", "dr", "lcns"]
_RARE = "list_filter(list_intersect(a.keys, b.keys), lambda k: k NOT IN ('tn', 'tht', 'ths', 'dr', 'lcns'))"


@query(
    f"""WITH {_HEADS} SELECT a.id AS later, b.id AS earlier FROM heads a JOIN heads b ON {_LATER} <= 36 * 3600000000
    WHERE (list_has_any(a.numbers, b.numbers) AND len({_RARE}) >= 2) OR (a.speaker = b.speaker AND epoch_us(a.t) - epoch_us(b.t) <= 2 * 3600000000 AND len({_RARE}) >= 3)"""
)
def anchored_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of one number within 36 hours, or of one source within two, with uncommon keys in common."""
    return similarity.anchored(timed_heads(spark, sf), COMMON_KEYS).select(F.col("a").alias("later"), F.col("b").alias("earlier"))


@query(f"WITH {_SETS}, k AS (SELECT id, {_AT} AS t, unnest(keys) AS key FROM sets) SELECT a.id, a.key, count(*) AS df FROM k a JOIN k b ON a.key = b.key AND b.t <= a.t AND b.t >= a.t - INTERVAL 36 HOURS GROUP BY a.id, a.key")
def windowed_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """In how many stories of the 36 hours up to a story each of its keys occurs."""
    return similarity.windowed_frequency(timed_sets(spark, sf), 36)


@query(f"SELECT doc_id FROM documents WHERE lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))) NOT IN (SELECT lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))) FROM benchmark)")
def history_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.lower(normal_space(title_of())).alias("norm")
    return without_seen(table(spark, sf, "documents").select("doc_id", norm), table(spark, sf, "benchmark").select(norm), "norm").select("doc_id")


@query(
    f"""WITH {_SETS}, old AS (SELECT item_id AS id, list_filter(list_distinct(string_split(regexp_replace(lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), lambda w: length(w) >= 2 AND NOT list_contains({_STOPS}, w)) AS tokens FROM benchmark)
    SELECT id FROM sets a WHERE NOT EXISTS (SELECT 1 FROM old b WHERE len(list_intersect(a.tokens, b.tokens)) >= 3 AND {_CON.format('a.tokens', 'b.tokens')} >= 0.5)"""
)
def semantic_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = title_sets(spark, sf).select("id", "tokens")
    old = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), K.title_tokens(F.lower(normal_space(title_of()))).alias("tokens"))
    test = (K.shared(F.col("a_tokens"), F.col("b_tokens")) >= 3) & (K.containment(F.col("a_tokens"), F.col("b_tokens")) >= 0.5)
    met = similarity.decided(similarity.candidate_pairs(rows, old, "tokens", 3), rows, old, test)
    return rows.join(met.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("id")


def _clusters(spark: SparkSession, sf: str, heads_only: bool) -> DataFrame:
    rows = checkpointed(title_sets(spark, sf).select("id", "keys"))
    pairs = similarity.overlap_pairs(rows).select("a", "b")
    return clusters.greedy_clusters(rows.select("id", F.col("id").alias("seq")), pairs, heads_only)


_FP = f"fp AS (SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id < b.id AND list_has_any(a.keys, b.keys) WHERE (len(list_intersect(a.keys, b.keys)) >= 6 AND {_CON.format('a.keys', 'b.keys')} >= 0.4) OR (len(list_intersect(a.keys, b.keys)) >= 4 AND {_CON.format('a.keys', 'b.keys')} >= 0.6))"
_REACHED = "reached(id, cur) AS (SELECT id, id FROM sets UNION SELECT reached.id, fp.a FROM reached JOIN fp ON fp.b = cur)"


@query(f"WITH RECURSIVE {_SETS}, {_FP}, {_REACHED} SELECT id, min(cur) AS cluster_id FROM reached GROUP BY id")
def clusters_single_link(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf, False)


@query(
    f"""WITH RECURSIVE {_SETS}, {_FP}, placed AS (SELECT sets.id, row_number() OVER (ORDER BY sets.id) AS n, coalesce(before, []) AS before FROM sets LEFT JOIN (SELECT b, list(a) AS before FROM fp GROUP BY b) ON b = sets.id),
    walk(n, heads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT placed.n, CASE WHEN list_has_any(before, heads) THEN heads ELSE list_append(heads, placed.id) END FROM walk JOIN placed ON placed.n = walk.n + 1)
    SELECT placed.id, coalesce(list_min(list_intersect(before, heads)), placed.id) AS cluster_id FROM placed, (SELECT heads FROM walk ORDER BY n DESC LIMIT 1)"""
)
def clusters_star(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf, True)


@query(f"WITH t AS (SELECT id, title, source, keyword + recency AS score, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS cluster FROM {_SCORED}) SELECT sha256(cluster) AS cluster, count(*) AS cluster_size, arg_max(id, (score, -id)) AS representative, arg_min(source, id) FILTER (coalesce(source, '') <> '') AS source FROM t GROUP BY cluster")
def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("id", F.sha2(F.lower(normal_space(F.col("title"))), 256).alias("cluster"), "source", (F.col("keyword") + F.col("recency")).alias("score"))
    return clusters.merged(rows, "cluster", "score", ["source"], "id")


_ACCEPTED = f"""ok AS (SELECT id, title, coalesce(source, '-') AS source, keyword + recency AS score, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS norm FROM {_GATED} WHERE reason IS NULL),
    keyed AS (SELECT *, list_sort({_KEYS}) AS keys FROM ok), sets AS (SELECT min(id) AS id, keys FROM keyed GROUP BY keys)"""


@query(
    f"""WITH RECURSIVE {_ACCEPTED}, {_FP}, {_REACHED}, named AS (SELECT id, min(cur) AS cluster_id FROM reached GROUP BY id),
    best AS (SELECT id, title, source, score, cluster_id FROM ok JOIN named USING (id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) = 1),
    fam AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id)::INT AS family_place FROM best), adj AS (SELECT *, score - CASE family_place WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 10 ELSE 18 END AS adjusted FROM fam)
    SELECT *, row_number() OVER (ORDER BY adjusted DESC, id)::INT AS place FROM adj ORDER BY adjusted DESC, id LIMIT 20"""
)
def front_page(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: accepted stories, one per cluster of like titles, in diverse order (a top-k report)."""
    group = clusters.greedy_clusters
    rows = gated(spark, sf).where("reason is null").select("id", "title", F.coalesce("source", F.lit("-")).alias("source"), (F.col("keyword") + F.col("recency")).alias("score"))
    rows = checkpointed(rows)
    sets = rows.select("id", F.array_sort(K.fingerprint(F.lower(normal_space(F.col("title"))))).alias("keys"))
    one = checkpointed(sets.groupBy("keys").agg(F.min("id").alias("id")))
    pairs = similarity.overlap_pairs(one).select("a", "b")
    named = group(one.select("id", F.col("id").alias("seq")), pairs)
    best = clusters.representatives(rows.join(named, "id"), "cluster_id", F.desc("score"), F.col("id"))
    return ranking.top(ranking.diverse_order(best, "source", "score", "id"), 20, F.desc("adjusted"), F.col("id"))
