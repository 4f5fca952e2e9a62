"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import align, bpe_fst, decontaminate, exact_dedup, katz_lm, license_scan, near_dedup, packing, periodic, quality_crf, url_filter, wavelet, winnow
from newsloom.llm.runtime import shared_folder, shuffle_partitions

#: (verdict, host and path)
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
QUALITY_THRESHOLD = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = quality_crf.train(docs, labels.where(~held_out))
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"), "n_lines", "good_share")


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.half_edited(table(spark, sf_dir, "documents"), ranges=4 * shuffle_partitions(spark))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    places = F.filter("found", lambda x: x.kind == "phrase")
    starts = F.transform(places, lambda x: x.start)
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.label))), ",")
    # whole wording accepted by a template: 1, only a phrase or a licence's first sentence: 0.5
    score = F.when(F.exists("found", lambda x: x.kind == "template"), 1.0).when(F.size("found") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(places).alias("base_labels"), labels(F.col("found")).alias("labels"), score.alias("score"),
    )


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op6_bpe_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_documents(spark.read.parquet(path))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), edited=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_line_crf, op3_winnow, op4_license_scan, op5_katz, op6_bpe_fst, op7_wavelet, op8_url_filter, op9_exact_dedup, op10_best_fit, op11_align, op12_periodic, op13_decontaminate)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_near_dedup": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
        ), items AS (SELECT doc_id, unnest(s) AS item FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, label FROM reached JOIN ways ON node = a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, label AS component_id, doc_id = label AS kept
        FROM sets JOIN (SELECT node, min(label) AS label FROM reached GROUP BY node) ON node = doc_id
    """,
    "op8_url_filter": f"""
        WITH rules(verdict, rule, h, p) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)}),
        urls AS (
            SELECT row_number() OVER () AS row, page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC NULLS LAST, verdict DESC, rule DESC) = 1
    """,
    "op9_exact_dedup": f"""
        WITH low AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM low WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op13_decontaminate": f"""
        WITH docs AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        items AS (SELECT item_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS span
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)),
        hits AS (SELECT doc_id, i, places.n AS n, item_id FROM places JOIN windows ON places.n = windows.n AND places.span = windows.span),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
