"""Landed files as tables: feeds, histories, state documents and page corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM_SCHEMA = "title string, link string, description string, pubDate string, enclosure struct<_url: string, _type: string>"


def feed_items(spark: SparkSession, path: str, first: int = 20) -> DataFrame:
    """Items of landed RSS files: the first of each file, with a title and a link; published_at null when it does not parse."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM_SCHEMA).load(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("feed")).withColumn("seq", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("feed").orderBy("seq"))
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"))
    image = F.when(F.col("enclosure._type").contains("image"), F.col("enclosure._url"))
    return rows.withColumn("place", place).where(F.col("place") <= first).select("feed", "place", F.trim("title").alias("title"), F.trim("link").alias("link"), F.col("description").alias("summary"), at.alias("published_at"), image.alias("image_url")).where("title <> '' and link <> ''")


def catalogue(spark: SparkSession, *lists: list[tuple[str, str]]) -> DataFrame:
    """(category, url) of all lists, each pair once."""
    rows = [spark.createDataFrame(x or [("", "")], "category string, url string").where("url <> ''") for x in lists]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["category", "url"])


def search_feed(base: str, words):
    return F.concat(F.lit(base), F.url_encode(words))


def mixed_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(titles, keys) from a file of lines 'TITLE|epoch|title' or a hash; other lines count for nothing."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    parts = F.split("line", r"\|", 3)
    titles = lines.where(F.col("line").startswith("TITLE|") & (F.size(parts) == 3)).select(F.timestamp_seconds(F.coalesce(F.get(parts, 1).try_cast("long"), F.lit(0))).alias("t"), F.get(parts, 2).alias("title"))
    keys = lines.where(F.col("line").rlike("^[0-9a-fA-F]{32,64}$")).select(F.lower("line").alias("key"))
    return titles, keys


def state_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt): JSON lines of a schema; lines that do not parse are set aside as they are."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"), F.try_parse_json("value").isNotNull().alias("good"))
    return parsed.where("good").select("d.*"), parsed.where("not good").select("value")


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html, bytes, sha256) of a folder of pages."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return rows.select("path", F.decode("content", "UTF-8").alias("html"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish_version(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> str:
    """Writes a version beside the others and returns its path; readers change over when they are told of it."""
    target = f"{path}/version={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return target


def site_exports(items: DataFrame, quarantined: DataFrame, most: int = 300) -> dict[str, DataFrame]:
    """Newest items without the quarantined: index (60), feed (50) and sitemap (all that are kept)."""
    kept = items.join(quarantined.select("id").distinct(), "id", "left_anti")
    newest = kept.orderBy(F.desc("t"), "id").limit(most)
    named = newest.withColumn("page_id", F.concat(F.date_format("t", "yyyyMMddHHmm"), F.lit("-"), F.substring(F.sha2("title", 256), 1, 6)))
    return {"index": named.orderBy(F.desc("t"), "id").limit(60), "feed": named.orderBy(F.desc("t"), "id").limit(50), "sitemap": named}
