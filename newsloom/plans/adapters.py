"""The driver's tables in the shape of the news tables, as DataFrames and as the same views in DuckDB text.

pages stand for discovered urls, documents for articles, lineitem for story memberships, orders for revisions,
events for fetch and reader logs, conversations for briefs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("discovered_url"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.trim("text"), r"\s+", 41)  # the rest of the text stays whole
    return table(spark, sf_dir, "documents").withColumn("words", words).select(
        F.col("doc_id").alias("article_id"),
        F.array_join(F.slice("words", 1, 12), " ").alias("headline"),
        F.array_join(F.slice("words", 1, 40), " ").alias("summary"),
        F.col("text").alias("body_text"),
        F.col("source").alias("outlet"),
        F.col("lang"),
        F.col("doc_id").alias("minute"),
        F.when(F.col("n_chars") >= 1000, "article_body").when(F.col("n_chars") >= 200, "metadata_description").otherwise("rss_only").alias("extraction_quality"),
        F.element_at(F.array(F.lit("open"), F.lit("likely_paywalled"), F.lit("unknown")), (F.col("doc_id") % 3 + 1).cast("int")).alias("access_signal"),
    )


ARTICLES_SQL = r"""articles AS (
  SELECT doc_id AS article_id, array_to_string(string_split_regex(trim(text), '\s+')[1:12], ' ') AS headline,
         array_to_string(string_split_regex(trim(text), '\s+')[1:40], ' ') AS summary, text AS body_text, source AS outlet, lang, doc_id AS minute,
         CASE WHEN n_chars >= 1000 THEN 'article_body' WHEN n_chars >= 200 THEN 'metadata_description' ELSE 'rss_only' END AS extraction_quality,
         CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'likely_paywalled' ELSE 'unknown' END AS access_signal
  FROM documents)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    framing = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "right").otherwise("center")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("article_id"), F.col("l_linenumber").alias("rank_in_story"),
        F.col("l_suppkey").alias("outlet"), framing.alias("framing_group"), F.col("l_quantity").cast("int").alias("quality"),
        (F.col("l_linestatus") == "O").alias("is_open"), F.col("l_extendedprice").cast("long").alias("body_length"),
    )


MEMBERS_SQL = """members AS (
  SELECT l_orderkey AS story_id, l_partkey AS article_id, l_linenumber AS rank_in_story, l_suppkey AS outlet,
         CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'right' ELSE 'center' END AS framing_group,
         trunc(l_quantity)::INTEGER AS quality, l_linestatus = 'O' AS is_open, trunc(l_extendedprice)::BIGINT AS body_length
  FROM lineitem)"""


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("wire", "publication", "broadcaster", "public_media", "regional", "specialist")))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("outlet"), F.col("s_name").alias("name"), F.element_at(kinds, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("outlet_type"), F.col("s_nationkey").alias("country")
    )


OUTLETS_SQL = """outlets AS (
  SELECT s_suppkey AS outlet, s_name AS name, ['wire', 'publication', 'broadcaster', 'public_media', 'regional', 'specialist'][s_suppkey % 6 + 1] AS outlet_type, s_nationkey AS country
  FROM supplier)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").cast("string").alias("created"),
        F.col("o_orderpriority").alias("status"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").cast("long").alias("size"),
    )


REVISIONS_SQL = """revisions AS (
  SELECT o_custkey AS story_id, o_orderkey AS revision, CAST(o_orderdate AS VARCHAR) AS created, o_orderpriority AS status, o_orderstatus AS state, trunc(o_totalprice)::BIGINT AS size
  FROM orders)"""


def fetch_status() -> Column:
    return F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "fetched").when(F.col("event_type") == "view", "pending").otherwise("normalized")


def reader_action() -> Column:
    return F.create_map(*(F.lit(x) for x in ("view", "view", "purchase", "save", "signup", "follow", "click", "evidence", "error", "unsave")))[F.col("event_type")]


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = fetch_status()
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("user_id").alias("source_id"), status.alias("status"), (F.col("value") * 10).alias("body_length")
    )


FETCH_SQL = """fetches AS (
  SELECT event_id, ts AS at, floor(epoch(ts))::BIGINT AS second, user_id AS source_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'fetched' WHEN 'view' THEN 'pending' ELSE 'normalized' END AS status, value * 10 AS body_length
  FROM events)"""


def reader_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = reader_action()
    return table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("ts").cast("timestamp").alias("at"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("story_id"), action.alias("action")
    )


READER_SQL = """reader AS (
  SELECT event_id, floor(epoch(ts))::BIGINT AS second, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS story_id,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'follow' WHEN 'click' THEN 'evidence' WHEN 'error' THEN 'unsave' END AS action
  FROM events)"""
