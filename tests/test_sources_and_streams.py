"""Readers of dumps, the snapshot round trip, and streams against their batch forms."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import reader
from newsloom.plans import adapters as A
from newsloom.sources import feeds
from newsloom.streaming import jobs


def test_rss(spark, tmp_path):
    items = "".join(f"<item><title>Story {i}</title><link>http://www.n.example/{i}?utm_a=1</link><description>About {i}</description><pubDate>Tue, 05 Mar 2024 08:00:00 GMT</pubDate></item>" for i in range(12))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}<item><title></title><link>x</link></item></channel></rss>")
    rows = feeds.read_rss_items(spark, str(tmp_path), 10).orderBy("position").collect()
    assert [r.url for r in rows] == [f"http://n.example/{i}" for i in range(10)] and rows[0].published_at is not None


def test_sitemap(spark, tmp_path):
    urls = "<url><loc>https://n.example/big-story-of-today.html</loc><lastmod>2024-03-05T08:00:00Z</lastmod></url><url><loc>https://n.example/2</loc><news:news><news:publication><news:language>de</news:language></news:publication><news:title>Nein</news:title></news:news></url>"
    (tmp_path / "s.xml").write_text(f'<urlset xmlns:news="n">{urls}</urlset>')
    rows = feeds.read_sitemap_items(spark, str(tmp_path)).collect()
    assert [(r.title, r.url) for r in rows] == [("Big story of today", "https://n.example/big-story-of-today.html")]


def test_snapshot_round_trip(spark, tmp_path):
    stories = spark.createDataFrame([(f"s{i}", f"Title {i}", "dek", "2024-01-01") for i in range(12)], "slug string, title string, dek string, latest_at string")
    articles = spark.createDataFrame([(f"s{i}", k, f"u{i}-{k}", "t", "src") for i in range(12) for k in range(i + 1)], "slug string, position int, url string, title string, source string")
    feeds.write_snapshot(stories, articles, str(tmp_path / "snap"), 10)
    back, nested = feeds.read_snapshot(spark, str(tmp_path / "snap"))
    assert {r.slug for r in back.collect()} == {f"s{i}" for i in range(2, 12)}
    assert nested.where("slug = 's4'").orderBy("position").toPandas().url.tolist() == [f"u4-{k}" for k in range(5)]


@pytest.fixture()
def event_files(spark, small, tmp_path):
    events = A.reader_events(spark, small).withColumn("source_id", F.col("user_id")).withColumn("status", F.when(F.col("action") == "evidence", "fetched").otherwise("failed"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))


def drained(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return stream.sparkSession.table(name)


def test_first_sightings(spark, event_files, tmp_path):
    events, stream = event_files
    got = drained(jobs.stream_discoveries(stream, "at", "user_id", "400 days"), "append", tmp_path, "first_sightings")
    assert got.count() == events.select("user_id").distinct().count()


def test_health(spark, event_files, tmp_path):
    events, stream = event_files
    got = drained(jobs.stream_source_health(stream, "48 hours", "24 hours", "400 days"), "complete", tmp_path, "health")
    want = jobs.stream_source_health(events, "48 hours", "24 hours", "400 days")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_tracking_state(spark, event_files, tmp_path):
    events, stream = event_files
    got = drained(jobs.stream_tracking_state(stream.select("user_id", "story_id", "action", "second", "event_id")), "update", tmp_path, "tracking")
    last = got.groupBy("user_id", "story_id").agg(F.count("*").alias("n"))
    want = reader.fold_tracking_events(events)
    assert last.count() == want.count()
    joined = got.alias("g").join(want.alias("w"), ["user_id", "story_id"]).where("g.saved <=> w.saved AND g.followed <=> w.followed AND g.viewed_at <=> w.viewed_at")
    assert joined.select("user_id", "story_id").distinct().count() == want.count()


def test_late_rows_join_sessions_that_were_put_out(spark, tmp_path):
    source = str(tmp_path / "clicks")
    for minutes in ([0, 10, 100, 300], [310], [20, 110, 800], [1000]):  # at 310 the watermark is 240: 20 is too late; 215 and 228 are not
        minutes = [215, 228, *minutes] if 800 in minutes else [190, *minutes] if 0 in minutes else minutes
        rows = spark.createDataFrame([(7, "view", m) for m in minutes], "user_id long, action string, m long")
        rows.select("user_id", "action", F.timestamp_seconds(1704067200 + 60 * F.col("m")).alias("at")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("user_id long, action string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    pieces = jobs.finished(jobs.stream_reader_sessions(stream), "append", str(tmp_path / "sessions"))
    start = lambda r: (int(r.start.timestamp()) - 1704067200) // 60
    assert sorted((start(r), r.events) for r in pieces.collect()) == [(0, 2), (100, 1), (190, 1), (215, 2), (300, 2), (800, 1)]
    assert sorted((start(r), r.events, r.views) for r in jobs.joined_sessions(pieces.drop("batch")).collect()) == [(0, 2, 2), (100, 1, 1), (190, 3, 3), (300, 2, 2), (800, 1, 1)]


def test_tracking_state_is_kept_by_aggregates(event_files):
    """Without a time to live no Python runs for each pair of reader and story."""
    _, stream = event_files
    rows = stream.select("user_id", "story_id", "action", "second", "event_id")
    assert "FlatMapGroupsInPandasWithState" not in jobs.stream_tracking_state(rows)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in jobs.stream_tracking_state(rows, 60_000)._jdf.queryExecution().analyzed().toString()


def test_publish(spark, event_files, tmp_path):
    events, stream = event_files
    path = str(tmp_path / "table")
    q = jobs.stream_publish(stream.select("event_id", "user_id"), path, str(tmp_path / "ck"), ["event_id"], jobs.upsert(["event_id"], ["user_id"]), buckets=4)
    q.awaitTermination(180)
    done = jobs.published(spark, path, q.lastProgress["batchId"])
    assert done.count() == done.select("event_id").distinct().count() == events.count()


def test_publish_rewrites_only_touched_buckets(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    spark.createDataFrame([(i, i) for i in range(40)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(3, 99), (3, 98), (77, 7)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    q = jobs.stream_publish(stream, path, str(tmp_path / "ck"), ["k"], jobs.upsert(["k"], ["v"]), buckets=8)
    q.awaitTermination(180)
    assert {r.k: r.v for r in jobs.published(spark, path, 1).collect()} == {**{i: i for i in range(40)}, 3: 99, 77: 7}
    versions = [r.version for r in spark.read.parquet(f"{path}/manifest/v1").collect()]
    assert 1 <= versions.count(1) <= 2 and set(versions) == {0, 1}


def test_sitemap_entries(spark, tmp_path):
    """Prefixed titles, dates, language and keywords; titles from the url; other languages go; the index picks the news."""
    entry = lambda loc, rest: f"<url><loc>{loc}</loc>{rest}</url>"
    news = lambda title, language, date: f"<news:news><news:publication><news:language>{language}</news:language></news:publication><news:publication_date>{date}</news:publication_date>{title}</news:news>"
    rows = [
        entry("https://site.example/a/one", news("<news:title>First title</news:title>", "en", "2024-01-02T03:04:05Z") + "<image:image><image:loc>https://i.example/1.jpg</image:loc></image:image>"),
        entry("https://site.example/a/deux", news("<news:title>Second</news:title>", "fr", "2024-01-02T03:04:05Z")), entry("https://site.example/a/the-long-bridge-story", "<lastmod>2024-01-03T00:00:00Z</lastmod>"), entry("https://site.example/12", ""),
        entry("https://site.example/a/last", news("<news:title>Past the limit</news:title>", "eng", "2024-01-02T03:04:05Z")),
    ]
    (tmp_path / "map.xml").write_text("<urlset>" + "\n".join(rows) + "</urlset>")
    got = feeds.read_sitemap_items(spark, str(tmp_path / "map.xml"), limit=3).orderBy("position").collect()
    assert [(r.title, r.url, r.image) for r in got] == [("First title", "https://site.example/a/one", "https://i.example/1.jpg"), ("The long bridge story", "https://site.example/a/the-long-bridge-story", None)]
    assert [str(r.published_at) for r in got] == ["2024-01-02 03:04:05", "2024-01-03 00:00:00"]
    locs = [f"https://site.example/part-{i}.xml" for i in range(6)] + ["https://site.example/news.xml", "https://site.example/latest.xml", "https://site.example/map.xml"]
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>")
    chosen = feeds.child_sitemaps(spark, str(tmp_path / "index.xml"), most=3)
    assert {r.loc for r in chosen.collect()} == {"https://site.example/news.xml", "https://site.example/latest.xml", "https://site.example/map.xml"}
    assert feeds.read_sitemap_items(spark, str(tmp_path / "map.xml"), children=chosen).count() == 3
    assert feeds.read_sitemap_items(spark, str(tmp_path / "map.xml"), children=chosen.where("loc LIKE '%news%'")).count() == 0


def test_durable_tables_go_with_clean_up(spark):
    import os

    from newsloom.sources import scratch

    frame = scratch.durable(spark.range(5), "five")
    path = scratch._KEPT[-1][1].removeprefix("file://")
    assert frame.count() == 5 and os.path.isdir(path)
    assert scratch.clean_up(spark) >= 1 and not os.path.exists(path) and scratch.clean_up(spark) == 0
