"""Queries that write dumps from the tables and read them back, and that run the streams to their end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.tables import last_by_key
from newsloom.plans import adapters as A
from newsloom.plans import page_plans as P
from newsloom.plans.catalog import query
from newsloom.sources import feeds
from newsloom.sources.scratch import new_path
from newsloom.streaming import jobs as L

_PLAIN_URLS = P.CANONICAL_SQL.replace(P._ALIASED.format(P._NET), P._NET)
_TITLE = "replace(trim(regexp_extract(html, '<title>([^<]*)', 1)), '&', 'and')"
EVERY = 2_000_000_000


def _pages(spark: SparkSession, d: str) -> DataFrame:
    title = F.replace(F.trim(F.regexp_extract("html", "<title>([^<]*)", 1)), F.lit("&"), F.lit("and"))
    at = F.timestamp_seconds(F.unix_seconds(F.expr("timestamp'2024-01-01 00:00:00Z'")) + 60 * F.col("page_id"))
    return A.table(spark, d, "pages").select("page_id", title.alias("title"), F.col("url").alias("link"), at.alias("at"))


@query("a1_read_rss_items", f"WITH {_PLAIN_URLS} SELECT canonical AS url, {_TITLE} AS title, (page_id * 60 + 1704067200)::BIGINT AS published FROM urls WHERE {_TITLE} <> ''")
def a1(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a feed item, written as dumps and read again."""
    path = new_path(spark, "rss")
    items = _pages(spark, d).select("title", "link", F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return feeds.read_rss_items(spark, path, EVERY).select("url", "title", F.unix_seconds("published_at").alias("published"))


@query("a4_snapshot", f"""
WITH {A.MEMBERS_SQL}, s AS (SELECT story_id, count(*) AS n, max(body_length) AS latest FROM members GROUP BY 1), t AS (SELECT * FROM s ORDER BY n DESC, lpad(latest::VARCHAR, 12, '0') DESC, 's' || story_id LIMIT 10)
SELECT 's' || story_id AS slug, n AS articles, latest FROM t""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest stories as a nested snapshot, written and read again."""
    m = A.members(spark, d).withColumn("slug", F.concat(F.lit("s"), "story_id"))
    stories = m.groupBy("slug").agg(F.max("body_length").alias("l")).select("slug", F.lit("title").alias("title"), F.lit("dek").alias("dek"), F.lpad(F.col("l").cast("string"), 12, "0").alias("latest_at"))
    articles = m.select("slug", F.col("rank_in_story").alias("position"), F.concat(F.lit("u"), "article_id").alias("url"), F.lit("t").alias("title"), F.col("outlet").cast("string").alias("source"))
    path = new_path(spark, "snapshot")
    feeds.write_snapshot(stories, articles, path)
    back, nested = feeds.read_snapshot(spark, path)
    return back.join(nested.groupBy("slug").agg(F.count("*").alias("articles")), "slug").select("slug", "articles", F.col("latest_at").cast("long").alias("latest"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("l1_stream_discoveries", "SELECT DISTINCT user_id, event_type FROM events")
def l1(spark: SparkSession, d: str) -> DataFrame:
    """First sighting of each source and kind in the event stream."""
    rows = _event_stream(spark, d).select(F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", F.concat_ws(":", "user_id", "event_type").alias("key"))
    return L.finished(L.stream_discoveries(rows, "at", "key", "400 days"), "append", new_path(spark, "stream")).select("user_id", "event_type")


@query("l4_stream_tracking_state", f"""
WITH {A.READER_SQL}, f AS (SELECT user_id, story_id, coalesce(arg_max(action <> 'unsave', (second, event_id)) FILTER (action IN ('save', 'follow', 'unsave')), FALSE) AS saved, coalesce(arg_max(action = 'follow', (second, event_id)) FILTER (action = 'follow'), FALSE) AS followed, max(second) FILTER (action = 'view') AS viewed_at FROM reader GROUP BY 1, 2)
SELECT * FROM f WHERE saved OR followed OR viewed_at IS NOT NULL""")
def l4(spark: SparkSession, d: str) -> DataFrame:
    """Tracking state after the whole event stream; each key's last output counts."""
    action = F.create_map(*(F.lit(x) for x in ("view", "view", "purchase", "save", "signup", "follow", "click", "evidence", "error", "unsave")))[F.col("event_type")]
    rows = _event_stream(spark, d).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("story_id"), action.alias("action"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "event_id")
    out = L.finished(L.stream_tracking_state(rows), "update", new_path(spark, "stream"))
    return out.groupBy("user_id", "story_id").agg(F.max_by(F.struct("saved", "followed", "viewed_at"), "batch").alias("x")).select("user_id", "story_id", "x.*")


#: Files that each slice of the event stream arrives in, and that a micro-batch takes.
FILES = 4
_LATE = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-11'"
_SLICE = f"CASE WHEN {_LATE} THEN 3 WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END"


def _sliced_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of three slices in order of time; some of the first slice come late, with the third."""
    path, events = new_path(spark, "slices"), A.table(spark, d, "events")
    for k in (1, 2, 3):
        events.where(F.expr(_SLICE.replace("TIMESTAMP '", "TIMESTAMP_NTZ'")) == k).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)


#: A batch drops rows by the watermark of the batch before it: the third slice is judged by an hour before the last event of the first. At the end the watermark stands an
#: hour before the last event of all.
_MARKS = f"wm AS (SELECT (max(ts) FILTER (({_SLICE}) = 1)) - INTERVAL 1 HOUR AS second, max(ts) - INTERVAL 1 HOUR AS last FROM events)"


@query("l2_stream_source_health", f"""
WITH {A.FETCH_SQL}, {_MARKS}, e AS (SELECT source_id, status, ts, ({_SLICE}) AS slice, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM (SELECT *, "at" AS ts FROM fetches))
SELECT source_id, epoch(s)::BIGINT AS start, count(*) AS fetches, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'fetched') AS fetched FROM e, wm
WHERE s + INTERVAL 2 DAY <= last AND (NOT (slice = 3 AND ts < TIMESTAMP '2024-01-11') OR s + INTERVAL 2 DAY > second) GROUP BY 1, 2""")
def l2(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days by one; those that the watermark has passed are put out, and rows that come later change nothing."""
    rows = _sliced_events(spark, d).select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("source_id"), A.fetch_status().alias("status"))
    return L.finished(L.stream_source_health(rows, "48 hours", "24 hours"), "append", new_path(spark, "stream")).drop("batch").withColumn("start", F.unix_seconds("start"))


@query("l3_stream_reader_sessions", f"""
WITH {A.READER_SQL}, {_MARKS}, r AS (SELECT user_id, action, ts, event_id, epoch(ts)::BIGINT AS second FROM reader JOIN (SELECT event_id, ts FROM events) USING (event_id), wm WHERE NOT ({_LATE}) OR ts + INTERVAL 30 MINUTE > wm.second),
n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS n FROM r), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM n),
g AS (SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, max(ts) AS m, count(*) AS events, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'evidence') AS evidence FROM s GROUP BY user_id, s)
SELECT user_id, start, events, views, evidence FROM g, wm WHERE m + INTERVAL 30 MINUTE <= wm.last""")
def l3(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has passed, with rows that came late but in time."""
    rows = _sliced_events(spark, d).select(F.col("ts").cast("timestamp").alias("at"), "user_id", A.reader_action().alias("action"))
    found = L.joined_sessions(L.finished(L.stream_reader_sessions(rows), "append", new_path(spark, "stream")).drop("batch"))
    return found.drop("end").withColumn("start", F.unix_seconds("start"))


@query("l5_stream_publish", f"SELECT user_id, arg_max(event_type, ({_SLICE}, event_id)) AS event_type, arg_max(event_id, ({_SLICE}, event_id)) AS event_id FROM events GROUP BY user_id")
def l5(spark: SparkSession, d: str) -> DataFrame:
    """The stream's events upserted by reader, batch by batch, into a table of buckets; the later slice wins, in it the later event."""
    path = new_path(spark, "published")
    rows = _sliced_events(spark, d).select("user_id", "event_type", "event_id")
    done = L.stream_publish(rows, f"{path}/table", f"{path}/state", ["user_id"], L.upsert(["user_id"], ["event_id"]))
    done.awaitTermination()
    return L.published(spark, f"{path}/table", done.lastProgress["batchId"]).select("user_id", "event_type", "event_id")


@query("l5_stream_revisions", f"""
WITH g AS (SELECT user_id AS story_id, {_SLICE} AS slice, arg_max(event_type, event_id) AS signature, max(event_id) AS tag FROM events GROUP BY 1, 2), f AS (SELECT story_id, signature, arg_min(tag, slice) AS tag, max(slice) AS latest FROM g GROUP BY 1, 2)
SELECT story_id, tag, signature, latest = max(latest) OVER (PARTITION BY story_id) AS is_current FROM f""")
def l5_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Each batch's last kind of event of a reader published as the reader's current revision; a kind seen before is taken up again."""
    path = new_path(spark, "revised")
    rows = _sliced_events(spark, d).select(F.col("user_id").alias("story_id"), F.col("event_id").alias("tag"), F.col("event_type").alias("signature"))
    done = L.stream_publish(rows, f"{path}/table", f"{path}/state", ["story_id"], L.revise(["tag"]))
    done.awaitTermination()
    return L.published(spark, f"{path}/table", done.lastProgress["batchId"]).select("story_id", "tag", "signature", "is_current")


def _within(lines: DataFrame, root: str) -> DataFrame:
    """Lines of XML with a root element around those of each file."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"<{root}>"]})
        yield from batches
        yield pd.DataFrame({"value": [f"</{root}>"]})

    return lines.mapInPandas(wrap, "value string")


@query("a2_read_sitemap_items", f"""
WITH {_PLAIN_URLS}, k AS (SELECT urls.page_id, canonical, pages.html, pages.url, urls.page_id % 5 AS m, urls.page_id % 8 AS file FROM urls JOIN pages ON pages.page_id = urls.page_id), t AS (SELECT *, CASE WHEN m <> 1 THEN nullif({_TITLE}, '') END AS news FROM k),
p AS (SELECT page_id, canonical AS url, coalesce(news, {P.TITLE_FROM_URL_SQL}) AS title, page_id * 60 + 1704067200 AS published FROM t WHERE m <> 3 AND file < 6)
SELECT url, title, published::BIGINT AS published, CASE WHEN page_id % 2 = 0 THEN 'https://img.example/' || page_id || '.jpg' END AS image FROM p WHERE title IS NOT NULL AND url <> ''""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """Every page as an entry of a news sitemap, written as eight dumps of XML text with an index, and read again through the six that the index chose."""
    path, c, m = new_path(spark, "sitemaps"), F.col, F.col("page_id") % 5
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    when = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    news = F.concat(
        tag("news:publication", tag("news:language", F.when(m == 3, "fr").when(m == 2, "eng").otherwise("en"))), F.when(m != 4, tag("news:publication_date", when)).otherwise(""), F.when(m != 1, tag("news:title", safe(c("title")))).otherwise(""),
    )
    image = F.when(c("page_id") % 2 == 0, tag("image:image", tag("image:loc", F.concat(F.lit("https://img.example/"), c("page_id").cast("string"), F.lit(".jpg"))))).otherwise("")
    lines = _pages(spark, d).select(tag("url", F.concat(tag("loc", safe(c("link"))), F.when(m == 4, tag("lastmod", when)).otherwise(""), tag("news:news", news), image)).alias("value"), (c("page_id") % 8).alias("file"))
    names = []
    for k in range(8):  # eight dumps, whatever the table
        _within(lines.where(c("file") == k).select("value"), "urlset").write.text(f"{path}/{'news' if k < 6 else 'archive'}-{k}")
        names.append(f"{'news' if k < 6 else 'archive'}-{k}")
    index = [(f"<sitemap><loc>https://site.example/{n}</loc></sitemap>",) for n in sorted(names)]
    _within(spark.createDataFrame(index, "value string").coalesce(1), "sitemapindex").write.text(f"{path}/index")
    chosen = feeds.child_sitemaps(spark, f"{path}/index").select(F.substring_index("loc", "/", -1).alias("name"))
    dumps = [f"{path}/{r.name}" for r in chosen.collect()]  # six names at most
    out = None
    for dump in dumps:
        rows = feeds.read_sitemap_items(spark, dump, EVERY)
        out = rows if out is None else out.unionByName(rows)
    return out.select("url", "title", F.unix_seconds("published_at").alias("published"), "image")
