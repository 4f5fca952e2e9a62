"""The gates that stories and posts pass: adverts, scope, local routine, noise, old and small events, post texts.

Each takes columns and returns a reason or null (or a flag). Term lists are arguments; the defaults are short English ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import fewer_words, is_incomplete
from newsloom.functions.tokens import magnitude, toll
from newsloom.functions.urls import host_in
from newsloom.operators.rules import Rule, count_terms, first_reason, has

# The defaults of the term lists.
MARKERS = ["sponsored", "advertisement", "advertorial", "paid content"]
BUYING = ["buy", "order now", "purchase", "shop"]
THINGS = ["phone", "ticket", "car", "apartment", "laptop"]
ACTIONS = ["call us", "sign up", "register now", "book now", "contact us"]
PRICES = ["discount", "price", "sale", "% off"]
ORDERS = ["order", "delivery", "in stock"]
COMMERCE = ["deals", "coupon", "best price", "shopping"]
RESELLER = [r"\bbest (prices?|dealers?) (for|of)\b", r"\bwhere to (buy|order)\b", r"\b(price list|buyer'?s guide)\b", r"\bfree shipping\b", r"\b(agency|representative) of [a-z]+ in\b"]
ROUNDUP = [r"\b(morning|evening|daily|weekly) (briefing|digest|roundup|headlines)\b", r"\btop (stories|headlines|news)\b", r"^(today in|this week in)\b", r"\blive updates?\b", r"\bin (pictures|photos)\b", r"\bwhat to (know|watch)\b"]
LOCAL_PLACES = ["county", "village", "municipal", "provincial", "township"]
ROUTINE = ["inaugurated", "meeting", "visited", "ceremony", "schedule", "anniversary"]
NATIONAL = ["parliament", "president", "minister", "national", "supreme court"]
STRONG = ["killed", "explosion", "earthquake", "attack", "collapsed", "evacuated"]
NOISE = {"drill": ["drill", "exercise", "maneuver"], "culture": ["film festival", "exhibition", "concert"], "sermon": ["sermon", "prayer leader"], "rhetoric": ["will never", "crushing response"], "analysis": ["analysis", "opinion", "commentary"], "ceremony": ["ceremony", "commemoration"], "mp-remark": ["lawmaker said", "mp said"], "follow-up": ["follow-up", "more details"]}


def advert(title: Column, body: Column) -> Column:
    """The first reason for which a story is an advert; a story without a title passes."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    both = F.concat_ws(" ", t, b)
    reason = first_reason([
        Rule("explicit_marker", has(both, MARKERS)),
        Rule("purchase_title", has(t, BUYING) & has(t, THINGS)),
        Rule("reseller", both.rlike("|".join(RESELLER))),
        Rule("call_to_action", (count_terms(both, ACTIONS) >= 2) & (count_terms(both, THINGS) >= 1)),
        Rule("price_and_order", (count_terms(both, PRICES) > 0) & has(both, ORDERS)),
        Rule("commerce_title", has(t, COMMERCE)),
    ])
    return F.when(t != "", reason)


def is_roundup(title: Column) -> Column:
    return F.lower(title).rlike("|".join(ROUNDUP))


def routine_local(title: Column, body: Column) -> Column:
    """A place of small reach with a routine word and no national signal, unless something strong happened."""
    t, both = F.lower(title), F.lower(F.concat_ws(" ", title, body))
    return has(t, LOCAL_PLACES) & has(t, ROUTINE) & ~has(both, NATIONAL) & ~has(both, STRONG)


def foreign_local(text: Column, countries: Sequence[str], markers: Sequence[str], *, security: Column, approved: Column) -> Column:
    """Local markers and fewer than two countries, without a security or editor's escape."""
    low = F.lower(text)
    named = F.size(F.filter(F.array(*[F.lit(c.lower()) for c in countries]), lambda c: F.contains(low, c)))
    return ~security & ~approved & has(low, markers) & (named < 2)


def blocked_publisher(hosts: Column, blocked: Sequence[str], allowed: Sequence[str], suffix: str = "") -> Column:
    """Whether any of a story's hosts is blocked by list or suffix and not allowed."""
    return F.exists(hosts, lambda h: ~host_in(h, allowed) & (host_in(h, blocked) | (h.endswith(suffix) if suffix else F.lit(False))))


def strict_source(host: Column, score: Column, strict: Sequence[str], least: int = 10, subdomains: bool = True) -> Column:
    """Whether a source with a bar of its own stays below it; with subdomains, those of a listed host have its bar."""
    return (host_in(host, strict) if subdomains else host.isin(*strict)) & (score < least)


def rescued(reason: Column, score: Column, *, critical: Column, global_critical: Column) -> Column:
    """struct<reason, score>: a critical story passes with a score of at least 13, a globally critical one with 12."""
    r = F.when(critical | global_critical, F.lit(None)).otherwise(reason)
    return F.struct(r.alias("reason"), F.when(critical, F.greatest(score, F.lit(13))).when(global_critical, F.greatest(score, F.lit(12))).otherwise(score).alias("score"))


def editor_tier(reason: Column, listed: Sequence[str], *, hard: Column, war_zone: Column, strong: Column, sport: Column) -> Column:
    """4, 3 or 0: what an editor's rescue of a listed reason is worth; sport is never rescued."""
    return F.when(sport | ~F.coalesce(reason.isin(*listed), F.lit(False)), 0).when(hard | war_zone, 4).when(strong, 3).otherwise(0)


def editor_veto(*, event: Column, hard: Column, strategic: Column, local: Column, war_zone: Column) -> Column:
    return (~event & ~hard & ~strategic) | (local & ~hard & ~war_zone)


def second_opinion(rows: DataFrame, reasons: Sequence[str], signals: Sequence[str], group: str, most: int = 5, *order: Column) -> DataFrame:
    """eligible: rejected for one of the reasons' prefixes, with a long title and a signal or a two-digit number; the first few."""
    low = F.lower("title")
    prefix = F.exists(F.array(*[F.lit(r) for r in reasons]), lambda p: F.startswith(F.coalesce("reason", F.lit("")), p))
    fits = prefix & (F.length("title") >= 15) & (has(low, signals) | low.rlike(r"(^|[^0-9])[0-9]{2,}([^0-9]|$)"))
    place = F.sum(fits.cast("int")).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("eligible", fits & (place <= most))


def noise(title: Column) -> Column:
    low = F.lower(title)
    return first_reason([Rule(f"noise:{k}", has(low, v)) for k, v in NOISE.items()])


def post_problem(title: Column, sentences: Column) -> Column:
    """The first reason for which a post's text is refused."""
    body = F.array_join(sentences, " ")
    return first_reason([
        Rule("title_short", fewer_words(title, 4)),
        Rule("unexplained_acronym", title.rlike(r"(^|[^A-Za-z])[A-Z]{5,}([^A-Za-z]|$)") & ~body.rlike(r"\([A-Z]{5,}\)")),
        Rule("body_short", (F.length(body) < 70) | fewer_words(body, 12)),
        Rule("lead_short", fewer_words(F.coalesce(F.get(sentences, 0), F.lit("")), 6)),
        Rule("noise", noise(title).isNotNull()),
        Rule("incomplete", is_incomplete(body)),
    ])


def old_event(title: Column, body: Column, year: Column, back: int = 2) -> Column:
    """A year long past in the title or lead, no current year anywhere and no word of today."""
    years = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])(19[0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    both = F.concat_ws(" ", title, body)
    past = F.exists(years(F.concat_ws(" ", title, F.substring(body, 1, 300))), lambda y: y <= year - back)
    return past & ~F.exists(years(both), lambda y: y >= year) & ~has(F.lower(both), ["today", "tonight", "this morning", "yesterday"])


def small_event(title: Column, body: Column) -> Column:
    """A weak earthquake without damage, or a road crash of few victims."""
    both = F.lower(F.concat_ws(" ", title, body))
    # Branches, so that numbers are looked for only in texts that speak of such an event.
    quake = F.when(has(both, ["earthquake", "quake"]), (F.coalesce(magnitude(both), F.lit(0.0)) < 4.5) & ~has(both, ["damage", "damaged", "killed", "injured"]))
    crash = F.when(has(both, ["crash", "collision"]), F.when(has(both, ["road", "bus", "highway"]), F.coalesce(toll(both), F.lit(0)) < 5))
    return F.when(quake, "small_quake").when(crash, "small_crash")


def keeps_quake(title: Column, neighbours: Sequence[str]) -> Column:
    """Quakes of magnitude 6 anywhere, or near; everything that is no quake."""
    low = F.lower(title)
    return ~has(low, ["earthquake", "quake"]) | (F.coalesce(magnitude(low), F.lit(0.0)) >= 6) | has(low, neighbours)


def is_list_post(caption: Column) -> Column:
    return F.size(F.filter(F.split(caption, "\n"), lambda x: x.rlike(r"^\s*[0-9۰-۹]{1,2}[.)\-]"))) >= 3


def major_sports(text: Column, sports: Sequence[str], stages: Sequence[str], results: Sequence[str], derbies: Sequence[str]) -> Column:
    """3 for a decided stage or derby, 2 for a team's result, 0 for anything else and for noise."""
    low = F.lower(text)
    result = has(low, results)
    return F.when(~has(low, sports) | noise(text).isNotNull(), 0).when(result & (has(low, stages) | has(low, derbies)), 3).when(result, 2).otherwise(0)


def incident_signature(text: Column, kinds: Sequence[tuple[str, str]], places: dict[str, str] | Column, anchors: Column) -> Column:
    """struct<kind, regions, places, toll, anchors>; null for ceremonies, without a kind, or with no region and under two anchors.

    places maps a place name to its region; the longest names are found first, with a suffix allowed. A large gazetteer is searched
    before, by dictionary.find_terms (term: place, value: region; whole words), and its column given here.
    """
    low = F.lower(text)
    kind = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in kinds])
    if isinstance(places, Column):
        found, regions = F.array_distinct(places["term"]), F.array_distinct(places["value"])
    else:
        names = "|".join("\\Q" + n.lower() + "\\E" for n in sorted(places, key=len, reverse=True))
        found = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?<!\p{{L}})({names})"), F.lit(1)))
        table = F.create_map(*[x for n, r in places.items() for x in (F.lit(n.lower()), F.lit(r))])
        regions = F.array_distinct(F.transform(found, lambda n: F.element_at(table, n)))
    empty = (F.size(regions) == 0) & (F.size(anchors) < 2)
    return F.when(kind.isNotNull() & ~has(low, ["ceremony", "anniversary", "commemoration"]) & ~empty, F.struct(kind.alias("kind"), regions.alias("regions"), found.alias("places"), toll(low).alias("toll"), anchors.alias("anchors")))


def match_strength(a: Column, b: Column) -> Column:
    """2 for two shared anchors, 1 for a shared place or region, 0 for other kinds, other known places or nothing shared."""
    apart = (F.size(a.places) > 0) & (F.size(b.places) > 0) & ~F.arrays_overlap(a.places, b.places)
    return F.when((a.kind != b.kind) | apart, 0).when(F.size(F.array_intersect(a.anchors, b.anchors)) >= 2, 2).when(F.arrays_overlap(a.places, b.places) | F.arrays_overlap(a.regions, b.regions), 1).otherwise(0)


def toll_update(new: Column, old: Column) -> Column:
    """Whether a later count is news: at least three, three more than before, and three tenths more."""
    return F.coalesce((new >= 3) & (new >= old + 3) & (new >= old * 1.3), F.lit(False))


def security_kind(text: Column, energy: Sequence[str] = ("refinery", "pipeline", "power plant"), attack: Sequence[str] = ("attack", "strike", "drone")) -> Column:
    low = F.lower(text)
    return F.when((F.coalesce(toll(low), F.lit(0)) >= 10) | has(low, ["dozens", "hundreds"]), "mass-casualty").when(has(low, energy) & has(low, attack), "energy-attack")


def rejection_record(stage: str, *flags: str) -> list[Column]:
    """The columns of an audit row for a rejected story."""
    return [F.col("id"), F.col("title"), F.col("source"), F.col("published_at"), F.col("score"), F.col("reason"), F.lit(stage).alias("stage"), F.struct(*[F.col(f) for f in flags]).alias("overrides") if flags else F.lit(None).cast("struct<none: boolean>").alias("overrides")]
