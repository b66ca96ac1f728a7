"""Queries on tables as stores: discoveries, upserts, set operations, rules, and outlets joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import outlets as O
from newsloom.operators import tables as T
from newsloom.plans import adapters as A
from newsloom.plans.catalog import query


@query("a3_active_feeds", """
WITH f AS (SELECT o_orderkey AS feed_id, o_custkey AS source_id, ['rss', 'atom', 'news_sitemap', 'sitemap', 'api'][o_orderkey % 5 + 1] AS feed_type, o_orderstatus <> 'F' AS is_active FROM orders),
r AS (SELECT c_custkey AS source_id, c_acctbal > 0 AS is_active, ['active', 'onboarding', 'paused'][c_custkey % 3 + 1] AS ingestion_status FROM customer)
SELECT f.feed_id, f.source_id, f.feed_type FROM f JOIN r USING (source_id)
WHERE f.is_active AND r.is_active AND r.ingestion_status IN ('active', 'onboarding') AND f.feed_type IN ('rss', 'atom', 'news_sitemap', 'sitemap')""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("rss", "atom", "news_sitemap", "sitemap", "api")))
    feeds = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("feed_id"), F.col("o_custkey").alias("source_id"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("feed_type"), (F.col("o_orderstatus") != "F").alias("is_active"))
    states = F.array(*map(F.lit, ("active", "onboarding", "paused")))
    registry = A.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_acctbal") > 0).alias("is_active"), F.element_at(states, (F.col("c_custkey") % 3 + 1).cast("int")).alias("ingestion_status"))
    return O.active_feeds(feeds, registry).select("feed_id", "source_id", "feed_type")


@query("a5_new_discoveries", """
SELECT DISTINCT o_custkey AS source_id, o_orderpriority AS kind FROM orders
WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = orders.o_custkey AND p.o_orderpriority = orders.o_orderpriority AND p.o_orderstatus = 'F')""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")
    return T.new_discoveries(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'F'"), ["source_id", "kind"])


_BATCH = "SELECT o_orderkey + 3 AS o_orderkey, o_custkey, 'merged' AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0"


def _stored_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stored = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    batch = stored.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 3).alias("o_orderkey"), "o_custkey", F.lit("merged").alias("o_orderstatus"))
    return stored, batch


@query("a6_upsert_by_key", f"""
WITH b AS ({_BATCH})
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return T.upsert_by_key(*_stored_and_batch(spark, d), ["o_orderkey"])


@query("a7_replace_children", """
WITH b AS (SELECT l_orderkey, 0::BIGINT AS l_linenumber, max(l_partkey) AS l_partkey FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b) UNION ALL SELECT * FROM b""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    child = A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")
    new = child.where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.lit(0).cast("long").alias("l_linenumber"), F.max("l_partkey").alias("l_partkey"))
    return T.replace_children(child, new, "l_orderkey")


_WANTED = "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_quantity >= 10"


def _prune(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stored = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    wanted = stored.where("l_orderkey % 3 = 0 AND l_quantity >= 10")
    return T.prune_children(stored.drop("l_quantity"), wanted, "l_orderkey", ["l_orderkey", "l_partkey"])


@query("a8_prune_children_kept", f"""
WITH w AS ({_WANTED}) SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = l.l_orderkey) OR EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = l.l_orderkey AND w.l_partkey = l.l_partkey)""")
def a8_kept(spark: SparkSession, d: str) -> DataFrame:
    return _prune(spark, d)[0].select("l_orderkey", "l_partkey", "l_linenumber")


@query("a8_prune_children_deleted", f"""
WITH w AS ({_WANTED}) SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l
WHERE EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = l.l_orderkey) AND NOT EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = l.l_orderkey AND w.l_partkey = l.l_partkey)""")
def a8_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _prune(spark, d)[1].select("l_orderkey", "l_partkey", "l_linenumber")


@query("a9_retire_stale_stories", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    stories = A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    current = A.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.retire_stale(stories, current, "o_orderkey", F.col("o_orderpriority").startswith("1"))[1].select("o_orderkey", "o_orderstatus")


@query("b6_map_outlets_unmapped", "SELECT l_suppkey % 170 AS outlet, count(*) AS n FROM lineitem WHERE l_suppkey % 170 NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1")
def b6(spark: SparkSession, d: str) -> DataFrame:
    articles = A.table(spark, d, "lineitem").select((F.col("l_suppkey") % 170).alias("outlet"))
    return O.map_outlets(articles, A.outlets(spark, d).where("outlet % 2 = 0"), "outlet")[1].select("outlet", F.col("count").alias("n"))


@query("b6_map_outlets_mapped", f"WITH {A.OUTLETS_SQL} SELECT outlet_type, country, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM outlets WHERE outlet % 2 = 0) o ON l_suppkey = outlet GROUP BY 1, 2")
def b6_mapped(spark: SparkSession, d: str) -> DataFrame:
    articles = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("outlet"))
    return O.map_outlets(articles, A.outlets(spark, d).where("outlet % 2 = 0"), "outlet")[0].groupBy("outlet_type", "country").agg(F.count("*").alias("n"))


@query("b7_coverage_counts", f"""
WITH {A.MEMBERS_SQL}, u AS (SELECT DISTINCT story_id, outlet, framing_group FROM members)
SELECT story_id, count(*) FILTER (framing_group = 'left') AS "left", count(*) FILTER (framing_group = 'center') AS center, count(*) FILTER (framing_group = 'right') AS "right" FROM u GROUP BY story_id""")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return O.coverage_counts(A.members(spark, d))


@query("b12_rights_class", """
WITH p AS (SELECT s_suppkey AS outlet, CASE WHEN s_suppkey % 4 = 0 THEN 'full_text' ELSE 'excerpt' END AS c FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT coalesce(c, 'no_reuse') AS rights_class, count(*) AS n FROM lineitem LEFT JOIN p ON l_suppkey = outlet GROUP BY 1""")
def b12(spark: SparkSession, d: str) -> DataFrame:
    policies = A.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("outlet"), F.when(F.col("s_suppkey") % 4 == 0, "full_text").otherwise("excerpt").alias("rights_class_default"))
    return O.rights_class(A.members(spark, d), policies, "outlet").groupBy("rights_class").agg(F.count("*").alias("n"))


@query("x1_story_membership", f"WITH {A.MEMBERS_SQL} SELECT story_id, count(DISTINCT outlet) AS outlets, count(*) AS articles, max(body_length) AS latest FROM members GROUP BY story_id")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return A.members(spark, d).groupBy("story_id").agg(F.countDistinct("outlet").alias("outlets"), F.count("*").alias("articles"), F.max("body_length").alias("latest"))


@query("x2_run_summary", """
SELECT (SELECT count(*) FROM events) AS polled, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT url) FROM pages) AS synced, (SELECT count(*) FROM documents WHERE n_chars < 200) AS dropped""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    counts = [
        A.table(spark, d, "events").agg(F.count("*").alias("polled"), F.count_if(F.col("event_type") == "error").alias("errors")),
        A.table(spark, d, "pages").agg(F.countDistinct("url").alias("synced")),
        A.table(spark, d, "documents").agg(F.count_if(F.col("n_chars") < 200).alias("dropped")),
    ]
    one = [c.withColumn("_one", F.lit(1)) for c in counts]
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


@query("x3_preview_merge", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P')")
def x3(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    pick = lambda s: rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return T.preview_merge(pick("O"), pick("P"), ["o_custkey", "o_orderpriority"])


@query("x4_saved_or_followed", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def x4(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("user_id").union(e.where("event_type = 'signup'").select("user_id")).distinct()


@query("x5_stored_not_wanted", "SELECT l_orderkey, l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 20")
def x5(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem")
    return T.stored_not_wanted(rows, rows.where("l_quantity >= 20"), ["l_orderkey", "l_partkey"])


@query("x6_constraint_violations", """
SELECT 'enum:o_orderstatus' AS rule, o_orderstatus AS key, count(*) AS "rows" FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 2
UNION ALL SELECT 'unique:o_custkey,o_orderpriority', concat_ws(',', o_custkey, o_orderpriority), count(*) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1
UNION ALL SELECT 'current:o_custkey', o_custkey::VARCHAR, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1""")
def x6(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders").withColumn("current", F.col("o_orderstatus") == "P")
    return T.constraint_violations(rows, {"o_orderstatus": ["O", "F"]}, [["o_custkey", "o_orderpriority"]], ("o_custkey", "current"))
