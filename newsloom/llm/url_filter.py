"""URL filtering against host and path rules, through hashed lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.runtime import broadcast_if_small, lower_ascii

#: Hexadecimal characters of the digest on which expressions and rules meet (32 bits); the full digest confirms.
SHORT = 8
#: Rules up to this many are broadcast; a longer list is joined by a shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: int, folders: int) -> Column:
    """array<string>: host suffixes of at most `labels` labels with path prefixes of at most `folders` folders that end in '/'.

    Suffixes are cut at dots, prefixes at slashes ('/' alone is no folder). A host of more labels and a path of more folders than
    any rule has can be met by no rule with more of them, so longer expressions are not built.
    """
    parts = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    names = F.split(path, "/", folders + 2)  # what follows the last folder stays in one part
    paths = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/")))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) from ('allow' or 'block', 'host/path') pairs."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest fitting rule (host and path
    together) wins; of equal lengths block wins over allow, then the greater text. Without a fitting rule: rule null, the
    default verdict. Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?',
    '#' or the end. A null url or one without '://' has both empty, and no rule fits an empty path. Repeated rows are returned
    as often as they come; extra columns of either table are not read. An empty rule table gives the default to all.

    Each url gives its host suffixes times its path prefixes, as deep as the rules go, whatever the length of the url. Expressions
    and rules meet by equality on the first 32 bits of their SHA-256; the full digest and then the rest of the rule's path are
    confirmed after it. The strongest match of a url is chosen by an aggregation that starts before the shuffle, where a url's
    expressions still lie together.
    """
    url = F.col(url_column)
    base = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    deep = rules.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("path", "/", -1)) - 2).alias("folders")).first()
    found = expressions(F.col("host"), F.col("path"), deep.labels or 1, max(0, deep.folders or 0))
    looked = base.select("*", F.posexplode_outer(F.when((F.col("host") != "") & F.col("path").startswith("/"), found)).alias("nth", "expression"))
    looked = looked.withColumn("first", F.coalesce(F.col("nth") == 0, F.lit(True))).withColumn("digest", F.sha2("expression", 256))
    looked = looked.withColumn("short", F.substring("digest", 1, SHORT))
    folder = F.regexp_extract(F.col("path"), r"(?s)^(.*/)", 1)
    # among equal lengths the largest of (blocks, rule) wins
    entry = F.struct(F.length(F.concat("host", "path")).alias("length"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict", F.col("path").alias("path"))
    digest = F.sha2(F.concat("host", folder), 256)
    table = rules.withColumn("digest", digest).where("digest is not null").groupBy(F.substring("digest", 1, SHORT).alias("r_short"))
    table = table.agg(F.collect_set(F.struct("digest", entry.alias("entry"))).alias("entries"))
    met = looked.join(broadcast_if_small(table, BROADCAST_RULES), F.col("short") == F.col("r_short"), "left")
    confirmed = F.filter("entries", lambda e: (e.digest == F.col("digest")) & F.col("path").startswith(e.entry.path))
    fitting = F.array_max(F.transform(confirmed, lambda e: e.entry))
    best = met.groupBy("id", "host", "path").agg(F.max(fitting).alias("best"), F.count_if("first").alias("rows"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("rows", F.lit(1)))))
    return best.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
