"""Queries over documents as drafts: gates for posts and line editing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import editing as E
from newsloom.functions import text as T
from newsloom.operators import gates as G
from newsloom.operators.rules import any_of
from newsloom.plans.base import TITLE, query, table, title_of


def _sentences() -> Column:
    return F.filter(F.transform(F.split("text", T.SENTENCE_END), lambda s: T.collapsed(s)), lambda s: s != "")


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", title_of().alias("title"), "text", _sentences().alias("s"))


def _count(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


@query(
    f"""WITH d AS (SELECT doc_id, lower({TITLE}) AS t, lower({TITLE}) || ' ' || lower(coalesce(text, '')) AS x FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN regexp_matches(x, '{any_of(G.MARKERS)}') THEN 'explicit_marker' WHEN regexp_matches(t, '{any_of(G.BUYING)}') AND regexp_matches(t, '{any_of(G.THINGS)}') THEN 'purchase_title'
        WHEN regexp_matches(x, '{"|".join(p.replace("'", "''") for p in G.RESELLER)}') THEN 'reseller' WHEN {_count("x", G.ACTIONS)} >= 2 AND {_count("x", G.THINGS)} >= 1 THEN 'call_to_action'
        WHEN {_count("x", G.PRICES)} > 0 AND regexp_matches(x, '{any_of(G.ORDERS)}') THEN 'price_and_order' WHEN regexp_matches(t, '{any_of(G.COMMERCE)}') THEN 'commerce_title' END AS reason FROM d"""
)
def advert_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", G.advert(title_of(), F.col("text")).alias("reason"))


@query(
    f"""WITH d AS (SELECT doc_id, lower({TITLE}) AS t, lower({TITLE}) || ' ' || lower(coalesce(text, '')) AS x FROM documents)
    SELECT doc_id, regexp_matches(t, '{"|".join(G.ROUNDUP)}') AS roundup, regexp_matches(t, '{any_of(G.LOCAL_PLACES)}') AND regexp_matches(t, '{any_of(G.ROUTINE)}') AND NOT regexp_matches(x, '{any_of(G.NATIONAL)}') AND NOT regexp_matches(x, '{any_of(G.STRONG)}') AS routine_local,
        CASE {" ".join(f"WHEN regexp_matches(t, '{any_of(v)}') THEN 'noise:{k}'" for k, v in G.NOISE.items())} END AS noise FROM d"""
)
def scope_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", G.is_roundup(title_of()).alias("roundup"), G.routine_local(title_of(), F.lower(F.coalesce("text", F.lit("")))).alias("routine_local"), G.noise(title_of()).alias("noise"))


@query()
def post_problems(spark: SparkSession, sf: str) -> DataFrame:
    return drafts(spark, sf).select("doc_id", G.post_problem(F.col("title"), F.col("s")).alias("reason"), G.small_event(F.col("title"), F.col("text")).alias("small"), G.old_event(F.col("title"), F.col("text"), F.lit(2024)).alias("old"))


@query()
def on_topic_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = drafts(spark, sf).select("doc_id", F.size("s").alias("before"), E.on_topic(F.col("title"), F.col("s")).alias("kept"))
    return rows.select("doc_id", "before", F.size("kept").alias("after"), F.get("kept", 0).alias("lead"))


@query()
def redundant_lines(spark: SparkSession, sf: str) -> DataFrame:
    return drafts(spark, sf).select("doc_id", F.size(E.without_redundant(F.col("title"), F.col("s"))).alias("news"), F.size(E.without_near_copies(F.col("s"))).alias("unlike"))


@query()
def lead_reselect(spark: SparkSession, sf: str) -> DataFrame:
    rows = drafts(spark, sf).where(F.size("s") > 0).select("doc_id", F.get("s", 0).alias("first"), F.get(E.best_lead(F.col("title"), F.col("s")), 0).alias("lead"))
    return rows.select("doc_id", "lead", (F.col("lead") != F.col("first")).alias("moved"))


@query()
def scored_summary(spark: SparkSession, sf: str) -> DataFrame:
    score = lambda s: E.sentence_score(s, ["license", "released"], ["with", "from", "pour"], ["said"])
    return drafts(spark, sf).select("doc_id", E.summary(F.col("s"), score).alias("summary"))
