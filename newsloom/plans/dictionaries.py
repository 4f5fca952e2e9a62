"""Queries with large term lists taken from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import dictionary as D
from newsloom.plans.base import query, table

_WORDS = "list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x))"
# Words that follow each other, two or three of them, and the places of those that benchmark texts hold.
_PLACES = f"""sizes(n) AS (VALUES (2), (3)),
    items AS (SELECT item_id, {_WORDS} AS w FROM benchmark), texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    terms AS (SELECT term, min(item_id::VARCHAR) AS value FROM (SELECT item_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items, sizes)) GROUP BY term),
    cut AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, sizes)),
    best AS (SELECT doc_id, i, max(n) AS n, arg_max(term, n) AS term, arg_max(value, n) AS value FROM cut JOIN terms USING (term) GROUP BY doc_id, i),
    following AS (SELECT a.*, b.i AS j FROM best a ASOF LEFT JOIN best b ON a.doc_id = b.doc_id AND a.i + a.n <= b.i),
    places AS (
        SELECT * FROM following QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1
        UNION ALL SELECT f.* FROM places p JOIN following f ON f.doc_id = p.doc_id AND f.i = p.j)"""


def phrases_of(rows: DataFrame, value: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(term, value): all sequences of as many words in the rows' texts."""
    w = D.words_of(F.col("text"))

    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array())

    return rows.select(F.explode(F.flatten(F.array(*[cut(n) for n in sizes]))).alias("term"), F.col(value).cast("string").alias("value"))


def _found(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    return D.find_terms(table(spark, sf, "documents").select("doc_id", "text"), phrases_of(table(spark, sf, "benchmark"), "item_id"), **limits)


def _summed(found: DataFrame) -> DataFrame:
    f = F.col("found")
    digest = F.md5(F.array_join(F.transform(f, lambda x: F.concat_ws(",", x["start"], x["size"], x["term"], x["value"])), ";"))
    lists = F.size(D.counted_by_value(f))
    return found.select("doc_id", F.size(f).cast("long").alias("places"), F.coalesce(F.aggregate(f, F.lit(0), lambda s, x: s + x["size"]), F.lit(0)).cast("long").alias("words"), lists.cast("long").alias("items"), digest.alias("digest"))


_SUMMED = f"""WITH RECURSIVE {_PLACES}
    SELECT doc_id, count(i) AS places, coalesce(sum(n), 0)::BIGINT AS words, count(DISTINCT value) AS items,
        md5(coalesce(string_agg(concat_ws(',', i - 1, n, term, value), ';' ORDER BY i), '')) AS digest FROM documents LEFT JOIN places USING (doc_id) GROUP BY doc_id"""


@query(_SUMMED)
def dictionary_places(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's phrases in every document, by one automaton in each worker."""
    return _summed(_found(spark, sf))


@query(_SUMMED)
def dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a join, as for term lists that no worker could hold."""
    return _summed(_found(spark, sf, most_terms=0))


@query()
def dictionary_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the benchmark's phrases replaced by the smallest item that holds them, in brackets."""
    terms = phrases_of(table(spark, sf, "benchmark"), "item_id").withColumn("value", F.concat(F.lit("["), "value", F.lit("]")))
    out = D.rewrite_terms(table(spark, sf, "documents").select("doc_id", "text"), terms)
    return out.select("doc_id", F.md5("rewritten").alias("digest"), F.length("rewritten").alias("chars"))
