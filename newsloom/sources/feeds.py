"""Readers of feed, sitemap and snapshot dumps, and the snapshot writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import parse_published_at
from newsloom.functions.urls import canonical_url, title_from_url, usable_keywords

_ITEM = "title string, link string, description string, `content:encoded` string, pubDate string, `media:content` struct<_url: string>, enclosure struct<_url: string>"
_URL = "loc string, lastmod string, `news:news` struct<`news:title`: string, `news:publication_date`: string, `news:keywords`: string, `news:publication`: struct<`news:language`: string>>, `image:image` struct<`image:loc`: string>"


def _located(raw: DataFrame) -> DataFrame:
    """Rows with their feed (the file) and their place in it: the start of the split and the number of the row inside it."""
    return raw.select("*", F.col("_metadata.file_path").alias("feed"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_n"))


def _first(items: DataFrame, limit: int) -> DataFrame:
    """The first items of each dump in file order, however its splits are scheduled."""
    order = Window.partitionBy("feed").orderBy("_split", "_n")
    return items.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).drop("_n", "_split")


def read_rss_items(spark: SparkSession, path: str, limit: int = 10) -> DataFrame:
    """(feed, position, title, url, summary, image, published_at): the first items of each feed dump that have a title and a link."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    items = _first(_located(raw), limit).select(
        "feed", "position", F.trim("title").alias("title"), canonical_url(F.col("link")).alias("url"), F.coalesce("description", "`content:encoded`").alias("summary"),
        F.coalesce("`media:content`._url", "enclosure._url").alias("image"), parse_published_at(F.col("pubDate")).alias("published_at"),
    )
    return items.where("title <> '' AND url <> ''")


def read_sitemap_items(spark: SparkSession, path: str, limit: int = 20, languages: tuple[str, ...] = ("en", "eng"), children: DataFrame | None = None) -> DataFrame:
    """(feed, position, title, url, summary, image, published_at): the first urls of each sitemap dump, titles from the url where absent.

    With the children that child_sitemaps chose (feed, loc), only dumps whose file name is the last part of a chosen address are read."""
    raw = _located(spark.read.format("xml").option("rowTag", "url").schema(_URL).load(path))
    if children is not None:
        last = lambda c: F.substring_index(F.col(c), "/", -1)
        raw = raw.join(children.select(last("loc").alias("_name")).distinct(), last("feed") == F.col("_name"), "left_semi")
    news = F.col("`news:news`")
    language = F.lower(news["news:publication"]["news:language"])
    items = _first(raw.where(language.isNull() | language.isin(*languages)), limit)
    title = F.coalesce(F.nullif(F.trim(news["news:title"]), F.lit("")), title_from_url(F.col("loc")))
    keywords = news["news:keywords"]
    items = items.select(
        "feed", "position", title.alias("title"), canonical_url(F.col("loc")).alias("url"), F.when(usable_keywords(keywords, title), keywords).alias("summary"),
        F.col("`image:image`")["image:loc"].alias("image"), parse_published_at(F.coalesce(news["news:publication_date"], "lastmod")).alias("published_at"),
    )
    return items.where("title IS NOT NULL AND url <> ''")


def child_sitemaps(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """(feed, loc): of each index file the sitemaps to read, those named news or latest first."""
    raw = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).withColumn("feed", F.col("_metadata.file_path"))
    order = Window.partitionBy("feed").orderBy(F.desc(F.rlike("loc", F.lit("(?i)news|latest"))), "loc")
    return raw.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("feed", "loc")


_STORY = "slug string, title string, dek string, latest_at string, articles array<struct<url: string, title: string, source: string>>"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stories, articles) of a snapshot of nested stories, one story a line."""
    raw = spark.read.schema(_STORY).json(path)
    return raw.drop("articles"), raw.select("slug", F.posexplode("articles").alias("position", "a")).select("slug", "position", "a.*")


def write_snapshot(stories: DataFrame, articles: DataFrame, path: str, top: int = 10) -> None:
    """The ``top`` stories by (size, latest), each with its articles in order, one JSON story a line."""
    nested = articles.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("position", "url", "title", "source"))).alias("_a"))
    nested = nested.withColumn("articles", F.transform("_a", lambda a: F.struct(a["url"].alias("url"), a["title"].alias("title"), a["source"].alias("source"))))
    chosen = stories.join(nested.select("slug", "articles"), "slug").orderBy(F.desc(F.size("articles")), F.desc("latest_at"), "slug").limit(top)
    chosen.select("slug", "title", "dek", "latest_at", "articles").write.mode("overwrite").json(path)
