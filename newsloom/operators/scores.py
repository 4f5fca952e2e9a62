"""Scores, tiers and labels of stories, as column functions over lower-cased text and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.urls import host_in
from newsloom.operators.rules import count_terms


def recency_score(age_hours: Column) -> Column:
    """12, 10, 8, 5, 3 and 1 points up to 1, 3, 6, 12, 24 and 36 hours; 0 beyond and without a time."""
    out = F.when(age_hours.isNull(), 0)
    for limit, points in ((1, 12), (3, 10), (6, 8), (12, 5), (24, 3)):
        out = out.when(age_hours < limit, points)
    return out.when(age_hours <= 36, 1).otherwise(0)


def keyword_importance(text: Column, very: Sequence[str], plain: Sequence[str], actors: Sequence[str], critical: Sequence[str]) -> Column:
    """8 per very important and 3 per important term, 14 for an actor with a critical term; at most 55."""
    both = (count_terms(text, actors) > 0) & (count_terms(text, critical) > 0)
    return F.least(8 * count_terms(text, very) + 3 * count_terms(text, plain) + F.when(both, 14).otherwise(0), F.lit(55))


def publisher_quality(url_host: Column, high: Sequence[str], medium: Sequence[str], aggregators: Sequence[str], social: Sequence[str]) -> Column:
    return (
        F.when(F.coalesce(url_host, F.lit("")) == "", 0).when(host_in(url_host, social), -40).when(host_in(url_host, aggregators), -50)
        .when(host_in(url_host, high), 25).when(host_in(url_host, medium), 15).otherwise(5)
    )


def reliability(quality: Column) -> Column:
    return F.when(quality >= 25, 10).when(quality >= 15, 8).when(quality >= 5, 6).when(quality >= 0, 4).otherwise(2)


def importance(keyword: Column, recency: Column, quality: Column, *, video: Column, image: Column, resolved: Column, social: Column, aggregator: Column, roundup: Column, cluster_size: Column) -> Column:
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return (
        keyword + recency + quality + flag(video, 3) + flag(image, 2) + flag(resolved, 8) - flag(social, 30) - flag(aggregator, 20) - flag(roundup, 25)
        + F.when(cluster_size >= 2, 2 * F.least(cluster_size, F.lit(4))).otherwise(0)
    )


def event_score(text: Column, terms: dict[str, Sequence[str]], reliable: Column, cluster_size: Column) -> Column:
    """Points for what happened: terms has high, medium, actions, entities, concrete, routine and low."""
    n = {k: count_terms(text, v) for k, v in terms.items()}
    flag = lambda c, p: F.when(c, p).otherwise(0)
    return (
        F.least(5 * n["high"], F.lit(20)) + F.least(2 * n["medium"], F.lit(4)) + F.least(2 * n["actions"], F.lit(6)) + flag((n["entities"] > 0) & (n["actions"] > 0), 1)
        + flag(n["concrete"] > 0, 2) + F.floor(reliable / 3) + flag(cluster_size >= 2, 1) - F.least(2 * n["routine"], F.lit(6)) - F.least(8 * n["low"], F.lit(16))
    ).cast("int")


def quality_bonus(title: Column, body: Column, terms: dict[str, Sequence[str]]) -> Column:
    """Added to the event score: 9 for mass events, else 5 or 2 for breaking words in title or body; 4, 2, 2 and -5 for others."""
    text = F.concat_ws(" ", title, body)
    flag = lambda c, p: F.when(c, p).otherwise(0)
    some = lambda t, k: count_terms(t, terms[k]) > 0
    strong = F.when(some(text, "mass"), 9).when(some(title, "breaking"), 5).when(some(body, "breaking"), 2).otherwise(0)
    routine = some(text, "routine") & (strong == 0) & ~some(text, "decision")
    return strong + flag(some(text, "decision"), 4) + flag(text.rlike("[0-9]"), 2) + flag(some(text, "countries"), 2) - flag(routine, 5)


def publication_tier(*, ceremonial: Column, rescued: Column, security: Column, critical: Column, major: Column, sports_level: Column, editor_tier: Column) -> Column:
    base = F.when(ceremonial, 1).when(rescued | security, 4).when(critical, 3).when(major, 2).otherwise(1)
    return F.greatest(base, sports_level, editor_tier)


def post_level(*, breaking: Column, age_minutes: Column, tier: Column, calm: Column, score: Column) -> Column:
    """5 urgent, 4 strong, 3 ordinary."""
    urgent = breaking & (age_minutes <= 90) & (tier >= 3) & ~calm
    return F.when(urgent, 5).when(((tier >= 4) & (score >= 12)) | (score >= 16), 4).otherwise(3)


def first_label(text: Column, lists: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first list with a term in the text."""
    return F.coalesce(*[F.when(count_terms(text, terms) > 0, F.lit(label)) for label, terms in lists], F.lit(default))


def mapped(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A code or category looked up in a small table, itself (or the default) when absent."""
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(pairs, key), key if default is None else default)
