"""Queries over document texts: cleaning, sentences, tokens, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import tokens as K
from newsloom.plans.base import TITLE, query, table, title_of


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    norm = T.normal_space(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(norm).alias("chars"), F.sha2(F.lower(norm), 256).alias("digest"))


@query(
    """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(10))), lambda x: length(x) >= 15) AS s FROM documents)
    SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest, sha256(coalesce(s[1], '')) AS first_digest FROM s"""
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.filter(F.transform(F.split("text", T.SENTENCE_END), lambda s: F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")), lambda s: F.length(s) >= 15).alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"), F.sha2(F.coalesce(F.get("s", 0), F.lit("")), 256).alias("first_digest"))


@query(
    """WITH s AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)),
    r AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS total FROM s WHERE n <= 5)
    SELECT doc_id, count(*)::INT AS taken, string_agg(s, ' ' ORDER BY n) AS summary FROM r WHERE total <= 900 GROUP BY doc_id"""
)
def extractive_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first sentences, five at most, that fit 900 characters together."""
    s = F.filter(F.transform(F.split("text", T.SENTENCE_END), lambda x: T.collapsed(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc, x):
        longer = F.concat(acc.t, F.when(acc.n == 0, "").otherwise(" "), x)
        fits = acc.open & (F.length(longer) <= 900)
        return F.struct(F.when(fits, longer).otherwise(acc.t).alias("t"), (acc.n + fits.cast("int")).alias("n"), fits.alias("open"))

    out = table(spark, sf, "documents").select("doc_id", F.aggregate(F.slice(s, 1, 5), start, step).alias("x"))
    return out.where("x.n > 0").select("doc_id", F.col("x.n").alias("taken"), F.col("x.t").alias("summary"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), lambda w: length(w) >= 2 AND NOT list_contains({_list(K.STOP_WORDS)}, w))), ' ') AS tokens FROM documents")
def title_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(K.title_tokens(title_of())), " ").alias("tokens"))


_KEYS = f"""list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(lower({TITLE}), '\\p{{L}}{{3,}}'), lambda w: NOT list_contains({_list(K.STOP_WORDS)}, w)),
    lambda w: substr(w, 1, 1) || regexp_replace(substr(regexp_replace(w, '^(.{{3,}}?)({"|".join(K.SUFFIXES)})$', '\\1'), 2), '{K.VOWELS}', '', 'g'))), lambda k: length(k) >= 2)"""


@query(f"SELECT doc_id, array_to_string(list_sort({_KEYS}), ' ') AS keys FROM documents")
def fingerprint_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(K.fingerprint(title_of())), " ").alias("keys"))


@query(f"SELECT key, count(*) AS df FROM (SELECT unnest({_KEYS}) AS key FROM documents) GROUP BY key")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.similarity import document_frequency as df

    return df(table(spark, sf, "documents").select(K.fingerprint(title_of()).alias("keys")))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ' ') AS numbers,
    len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda n: length(n) >= 3 AND NOT regexp_full_match(n, '(13|14|19|20)[0-9]{2}') AND NOT ends_with(n, '00')))::INT AS distinctive FROM documents"""
)
def numeric_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(K.numbers_in(F.col("text"))), " ").alias("numbers"), F.size(K.distinctive_numbers(F.col("text"))).alias("distinctive"))


_REDACT = "text"
for _p in T.SECRET_PATTERNS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, substr({_REDACT}, 1, 500) AS shown, ((length({_REDACT}) - length(replace({_REDACT}, '[REDACTED]', ''))) / 10)::INT AS secrets FROM documents")
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    clean = F.col("text")
    for p in T.SECRET_PATTERNS:
        clean = F.regexp_replace(clean, p, "[REDACTED]")
    return table(spark, sf, "documents").select("doc_id", T.redacted(F.col("text")).alias("shown"), ((F.length(clean) - F.length(F.replace(clean, F.lit("[REDACTED]"), F.lit("")))) / 10).cast("int").alias("secrets"))


_WIDE, _LETTERS = "[\\x{00C0}-\\x{024F}]", "[A-Za-z\\x{00C0}-\\x{024F}]"


@query(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{_LETTERS}')) = 0 THEN 1.0 ELSE len(regexp_extract_all(text, '{_WIDE}'))::DOUBLE / len(regexp_extract_all(text, '{_LETTERS}')) END AS ratio FROM documents")
def script_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.script_ratio(F.col("text"), _WIDE, _LETTERS).alias("ratio"))


@query(
    """WITH t AS (SELECT doc_id, trim(text, chr(32) || chr(10)) AS t FROM documents)
    SELECT doc_id, t = '' OR regexp_matches(t, '(…|\\.\\.\\.|[,،:؛])$') OR lower(list_last(string_split_regex(t, '\\s+'))) IN ('and', 'or', 'of', 'the', 'with', 'to', 'و', 'که', 'از', 'با', 'به', 'در') AS incomplete FROM t"""
)
def incomplete_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.is_incomplete(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", "")).alias("incomplete"))


@query(
    """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents)
    SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) >= 6)) > 0 AS repeats FROM w"""
)
def adjacent_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", K.adjacent_repeat(F.col("text")).alias("repeats"))


@query("SELECT text AS key_text, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, sha256(text) AS text FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dup_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.audit import duplicate_groups

    return duplicate_groups(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id").withColumnRenamed("key", "key_text")


@query(f"SELECT lower(trim(regexp_replace({TITLE}, '\\s+', ' ', 'g'))) AS key_title, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_title_groups(spark: SparkSession, sf: str) -> DataFrame:
    from newsloom.operators.audit import duplicate_groups

    return duplicate_groups(table(spark, sf, "documents"), F.lower(T.normal_space(title_of())), "doc_id").withColumnRenamed("key", "key_title")


@query(
    f"""WITH k AS (SELECT doc_id, lower({TITLE}) || '|' || coalesce(source, '') AS k FROM documents)
    SELECT min(doc_id) AS doc_id, sha256(k) AS history_key, count(*) AS copies FROM k GROUP BY k"""
)
def exact_story_dedup(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("|", F.lower(title_of()), F.coalesce("source", F.lit("")))
    return table(spark, sf, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", F.sha2("k", 256).alias("history_key"), "copies")
