"""Registration of named queries, and the views of the driver's tables that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import first_line

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Every age is measured against this moment.
ASOF = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def asof() -> Column:
    return F.lit(ASOF).cast("timestamp")


def title_of(text: str = "text") -> Column:
    """The whole first line."""
    return first_line(F.coalesce(F.col(text), F.lit("")))


#: The same in SQL.
TITLE = "split_part(coalesce(text, ''), chr(10), 1)"


def stories(spark: SparkSession, sf: str) -> DataFrame:
    """documents as stories: title, lower-cased text, and a publication time spread over the days before ASOF."""
    d = table(spark, sf, "documents")
    at = F.timestamp_seconds(F.unix_timestamp(asof()) - (F.col("doc_id") * 613) % 129_600)
    return d.select(F.col("doc_id").alias("id"), title_of().alias("title"), F.lower("text").alias("low"), "source", "lang", at.alias("published_at"))


STORIES = f"(SELECT doc_id AS id, {TITLE} AS title, lower(text) AS low, source, lang, TIMESTAMP '{ASOF}' - to_seconds((doc_id * 613) % 129600) AS published_at FROM documents)"
