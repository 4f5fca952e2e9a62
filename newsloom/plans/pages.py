"""Queries over web pages: addresses, links, audits, main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import urls as U
from newsloom.operators import audit, scores
from newsloom.plans.base import query, table
from newsloom.sources.html_text import main_text

_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '^([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '')"
_PATH = "regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '^[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|^//', ''), '^[^?#]*\\?([^#]*)', 1)"
# Written out, not taken from the library that they hold.
_TRACK = "['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_name', 'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'ref', 'referrer', 'source', 'output']"
_AGGREGATOR = r"regexp_matches(h, '(^|\.)(google\.com|googleusercontent\.com|gstatic\.com)$')"
_SOCIAL = r"regexp_matches(h, '(^|\.)(facebook\.com|fb\.com|fbcdn\.net|x\.com|twitter\.com|twimg\.com|youtube\.com|youtu\.be|tiktok\.com|instagram\.com|telegram\.me|t\.me)$')"
_TRACKER = r"regexp_matches(h, '(^|\.)(doubleclick\.net|google-analytics\.com|googletagmanager\.com|scorecardresearch\.com)$')"


@query(
    f"""WITH u AS (SELECT page_id, lower(coalesce(nullif(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'https')) AS s, {_HOST} AS h, regexp_replace({_PATH}, '/+$', '') AS p,
        list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains({_TRACK}, lower(split_part(x, '=', 1))))) AS q FROM pages)
    SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM u"""
)
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


_HIGH, _MEDIUM = ["example.org"], ["blog.ththth.example.net", "example.net"]


def _in(hosts: list[str]) -> str:
    return "(" + " OR ".join(f"h = '{x}' OR ends_with(h, '.{x}')" for x in hosts) + ")"


@query(
    f"""WITH u AS (SELECT page_id, {_HOST} AS h FROM pages), q AS (SELECT page_id, h AS host, CASE WHEN h = '' THEN 0 WHEN {_SOCIAL} THEN -40 WHEN {_AGGREGATOR} THEN -50 WHEN {_in(_HIGH)} THEN 25 WHEN {_in(_MEDIUM)} THEN 15 ELSE 5 END AS quality FROM u)
    SELECT page_id, host, quality, CASE WHEN quality >= 25 THEN 10 WHEN quality >= 15 THEN 8 WHEN quality >= 5 THEN 6 WHEN quality >= 0 THEN 4 ELSE 2 END AS reliability FROM q"""
)
def host_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    rows = rows.withColumn("quality", scores.publisher_quality(F.col("host"), _HIGH, _MEDIUM, U.AGGREGATORS, U.SOCIAL))
    return rows.withColumn("reliability", scores.reliability(F.col("quality")))


@query(f"WITH u AS (SELECT page_id, {_HOST} AS h, lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) AS e FROM pages) SELECT page_id, {_AGGREGATOR} AS aggregator, {_SOCIAL} AS social, {_TRACKER} AS tracker, e IN ('mp4', 'webm', 'mov', 'm4v') AS video FROM u")
def url_kind_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "pages").select("page_id", U.kinds(F.col("url")).alias("k"))
    return k.select("page_id", "k.aggregator", "k.social", "k.tracker", "k.video")


@query(f"SELECT suffix, count(*) AS pages FROM (SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) AS suffix FROM (SELECT string_split({_HOST}, '.') AS p FROM pages)) GROUP BY suffix")
def host_suffix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.explode(U.host_suffixes(U.host(F.col("url")))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("pages"))


_TITLE = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"


@query(f"SELECT page_id, {_TITLE} AS title, sha256(html) AS sha256, strlen(html)::INT AS bytes FROM pages")
def html_titles(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_pages(table(spark, sf, "pages")).select("page_id", "title", "sha256", "bytes")


@query(
    f"""WITH c AS (SELECT regexp_matches(html, '(?i)<meta[^>]*noindex') AS gone, starts_with(lower(html), '<!doctype html') AS a, {_TITLE} <> '' AS b, contains(lower(html), 'charset=') AS c, regexp_matches(html, '(?i)<html[^>]*lang=') AS d, ends_with(lower(rtrim(html)), '</html>') AS e FROM pages)
    SELECT count(*) AS pages, count_if(NOT gone)::BIGINT AS active, count_if(gone)::BIGINT AS retired, count_if(NOT (a AND b AND c AND d AND e))::BIGINT AS failed, count(*) - 200 AS drift,
        count_if(NOT a)::BIGINT AS no_doctype, count_if(NOT b)::BIGINT AS no_title, count_if(NOT c)::BIGINT AS no_charset, count_if(NOT d)::BIGINT AS no_lang, count_if(NOT e)::BIGINT AS no_closed FROM c"""
)
def corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_summary(audit.audit_pages(table(spark, sf, "pages")), baseline=200)


@query("SELECT page_id, len(l)::INT AS links, l[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href=[\"'']([^\"''#][^\"'']*)[\"'']', 1) AS l FROM pages)")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*href=["']([^"'#][^"']*)["']"""), F.lit(1)).alias("l"))
    return rows.select("page_id", F.size("l").alias("links"), F.get("l", 0).alias("first_link"))


@query()
def html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text(table(spark, sf, "pages"))


@query()
def publisher_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", U.publisher_link(F.col("html"), F.col("url")).alias("link"), U.image_link(F.col("html")).alias("image"), U.video_link(F.col("html")).alias("video"))


@query(f"SELECT a.page_id FROM pages a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE {_HOST.replace('url', 'b.url')} = {_HOST.replace('url', 'a.url')} AND b.page_id < a.page_id)")
def first_page_of_host(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return rows.groupBy("host").agg(F.min("page_id").alias("page_id")).select("page_id")
