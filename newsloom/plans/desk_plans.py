"""Queries on enrichment, perspective, revisions, reader state and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import marked_sentences, overlap_tokens, squeeze, token_overlap
from newsloom.operators import audits as M
from newsloom.operators import enrich as G
from newsloom.operators import perspective as I
from newsloom.operators import reader as K
from newsloom.operators import revisions as J
from newsloom.plans import adapters as A
from newsloom.plans.catalog import query
from newsloom.sources.scratch import durable

AS_OF = 1706659200  # 2024-01-31 00:00 UTC

_G1_A = "a AS (SELECT page_id AS article_id, url AS canonical_url, 'x:' || page_id % 50 AS original_url FROM pages)"
_G1_D = "d AS (SELECT page_id AS discovery_id, CASE WHEN page_id % 3 = 0 THEN url END AS canonical_url, 'x:' || page_id % 70 AS discovered_url, page_id % 9 AS second FROM pages)"


@query("g1_latest_discovery", f"""
WITH {_G1_A}, {_G1_D}, f AS (SELECT discovery_id, second, canonical_url AS url FROM d WHERE canonical_url IS NOT NULL UNION SELECT discovery_id, second, discovered_url FROM d), n AS (SELECT url, arg_max(discovery_id, (second, discovery_id)) AS x FROM f GROUP BY url)
SELECT article_id, coalesce(c.x, o.x) AS discovery_id FROM a LEFT JOIN n c ON c.url = canonical_url LEFT JOIN n o ON o.url = original_url""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages")
    x = lambda n: F.concat(F.lit("x:"), (F.col("page_id") % n).cast("string"))
    articles = p.select(F.col("page_id").alias("article_id"), F.col("url").alias("canonical_url"), x(50).alias("original_url"))
    found = p.select(F.col("page_id").alias("discovery_id"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("canonical_url"), x(70).alias("discovered_url"), (F.col("page_id") % 9).alias("second"))
    return G.latest_discovery(articles, found)


_G2 = f"""{A.FETCH_SQL}, ga AS (SELECT event_id AS article_id, source_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'u' || event_id END AS url, CASE WHEN body_length > 500 THEN 'article_body' WHEN body_length > 200 THEN 'metadata_description' ELSE 'rss_only' END AS extraction_quality, event_id % 7 = 0 AS mismatch, status AS fetch_status, second AS attempted FROM fetches)"""
_NEEDS = f"coalesce(url, '') <> '' AND NOT (extraction_quality = 'article_body' AND NOT mismatch) AND NOT (fetch_status = 'fetched' AND extraction_quality = 'article_body') AND NOT (fetch_status = 'failed' AND attempted > {AS_OF - 86400})"


def fetch_articles(spark: SparkSession, d: str) -> DataFrame:
    f = A.fetch_log(spark, d)
    quality = F.when(F.col("body_length") > 500, "article_body").when(F.col("body_length") > 200, "metadata_description").otherwise("rss_only")
    return f.select(F.col("event_id").alias("article_id"), "source_id", F.when(F.col("event_id") % 13 == 0, "").otherwise(F.concat(F.lit("u"), "event_id")).alias("url"), quality.alias("extraction_quality"), (F.col("event_id") % 7 == 0).alias("mismatch"), F.col("status").alias("fetch_status"), F.col("second").alias("attempted"))


@query("g2_needs_enrichment", f"WITH {_G2} SELECT article_id, extraction_quality, fetch_status FROM ga WHERE {_NEEDS}")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return G.needs_enrichment(fetch_articles(spark, d), AS_OF, 86400).select("article_id", "extraction_quality", "fetch_status")


@query("g3_enrichment_queue", f"""WITH {_G2} SELECT article_id FROM ga WHERE {_NEEDS} ORDER BY source_id % 2 = 0 DESC, source_id % 5 = 0 DESC, source_id % 3 = 0 DESC, article_id % 2 = 0 DESC, extraction_quality <> 'article_body' DESC, extraction_quality = 'rss_only' DESC,
 CASE fetch_status WHEN 'pending' THEN 0 WHEN 'normalized' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, attempted, attempted DESC, article_id LIMIT 24""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = G.needs_enrichment(fetch_articles(spark, d), AS_OF, 86400).select(
        "*", (c("source_id") % 2 == 0).alias("story_active"), (c("source_id") % 5 == 0).alias("one_source"), (c("source_id") % 3 == 0).alias("thin_story"), (c("article_id") % 2 == 0).alias("paywalled"),
        (c("extraction_quality") != "article_body").alias("needs_body"), (c("extraction_quality") == "rss_only").alias("thin_summary"), c("attempted").alias("queued"), c("attempted").alias("published"),
    )
    return G.enrichment_queue(rows).select("article_id")


_OT = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{4,}}'))"


@query("g4_body_mismatch", f"""
WITH {A.ARTICLES_SQL}, x AS (SELECT article_id, extraction_quality, body_text, {_OT.format("headline || ' ' || summary")} AS a, {_OT.format("array_to_string((regexp_extract_all(trim(regexp_replace(coalesce(body_text, ''), '[[:space:]]+', ' ', 'g')), '[^.!?]+[.!?]'))[1:2], ' ')")} AS b FROM articles)
SELECT article_id, extraction_quality = 'article_body' AND (contains(body_text, '!! ') OR (CASE WHEN least(len(a), len(b)) < 4 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END) < 0.16) AS mismatch FROM x""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    first_two = F.array_join(F.slice(marked_sentences(squeeze(F.col("body_text"))), 1, 2), " ")
    a, b = overlap_tokens(F.concat_ws(" ", "headline", "summary")), overlap_tokens(first_two)
    return A.articles(spark, d).select("article_id", G.body_mismatch(token_overlap(a, b, "alignment", 0.0), F.contains(F.col("body_text"), F.lit("!! ")), F.col("extraction_quality") == "article_body").alias("mismatch"))


_NEW = "ne AS (SELECT doc_id AS article_id, CASE WHEN doc_id % 4 = 1 THEN 'new ' || doc_id END AS new_summary, CASE WHEN doc_id % 4 = 2 THEN 'body ' || doc_id END AS new_body, CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 4 = 2 THEN 'article_body' ELSE 'metadata_description' END AS new_quality, doc_id % 5 = 0 AS mismatch, CASE WHEN doc_id % 11 = 0 THEN 'timeout' END AS error FROM documents WHERE doc_id % 3 <> 0)"


@query("g5_merge_enrichment", f"""
WITH {A.ARTICLES_SQL}, {_NEW}, j AS (SELECT a.*, n.new_summary, n.new_body, n.new_quality, coalesce(n.mismatch, FALSE) AS reset, n.error, (n.error IS NOT NULL OR n.new_quality IS NULL) AS keep FROM articles a LEFT JOIN ne n USING (article_id))
SELECT article_id, CASE WHEN keep THEN summary WHEN reset THEN headline ELSE coalesce(new_summary, summary) END AS summary, CASE WHEN keep THEN body_text WHEN reset THEN NULL ELSE coalesce(new_body, body_text) END AS body_text,
 CASE WHEN keep THEN extraction_quality WHEN reset THEN 'rss_only' ELSE new_quality END AS extraction_quality, CASE WHEN error IS NOT NULL THEN 'failed' WHEN new_quality IS NULL THEN 'pending' WHEN reset OR new_quality <> 'article_body' THEN 'normalized' ELSE 'fetched' END AS fetch_status, error,
 CASE WHEN keep OR reset THEN 'old' ELSE coalesce(CASE WHEN article_id % 6 = 1 THEN 'new' END, 'old') END AS image, NOT keep AND reset AS body_mismatch, CASE WHEN error IS NULL AND new_quality IS NOT NULL THEN 77 END AS enriched_at FROM j""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("article_id")
    new = A.articles(spark, d).where(i % 3 != 0).select(
        i, F.when(i % 4 == 1, F.concat(F.lit("new "), i)).alias("new_summary"), F.when(i % 4 == 2, F.concat(F.lit("body "), i)).alias("new_body"),
        F.when(i % 8 == 0, None).when(i % 4 == 2, "article_body").otherwise("metadata_description").alias("new_quality"), (i % 5 == 0).alias("mismatch"), F.when(i % 11 == 0, "timeout").alias("error"), F.when(i % 6 == 1, "new").alias("new_image"),
    )
    return G.merge_enrichment(A.articles(spark, d).withColumn("feed_summary", F.col("headline")).withColumn("image", F.lit("old")), new, 77)


_GRADE = "CASE {0} WHEN 'rss_only' THEN 0 WHEN 'metadata_description' THEN 1 ELSE 2 END"


@query("g6_keep_better_enrichment", f"""
WITH {A.ARTICLES_SQL}, s AS (SELECT * FROM articles WHERE article_id % 2 = 0), i AS (SELECT article_id, 'incoming' AS summary, CASE WHEN article_id % 3 = 0 THEN 'article_body' ELSE 'metadata_description' END AS extraction_quality FROM articles),
j AS (SELECT i.*, s.summary AS os, s.extraction_quality AS oq, coalesce({_GRADE.format('s.extraction_quality')} > {_GRADE.format('i.extraction_quality')} AND s.article_id IS NOT NULL, FALSE) AS better FROM i LEFT JOIN s USING (article_id))
SELECT article_id, CASE WHEN better THEN os ELSE summary END AS summary, CASE WHEN better THEN oq ELSE extraction_quality END AS extraction_quality FROM j""")
def g6(spark: SparkSession, d: str) -> DataFrame:
    rows = A.articles(spark, d)
    incoming = rows.select("article_id", F.lit("incoming").alias("summary"), F.when(F.col("article_id") % 3 == 0, "article_body").otherwise("metadata_description").alias("extraction_quality"))
    return G.keep_better_enrichment(rows.where("article_id % 2 = 0"), incoming, "article_id", ["summary"])


_COVER = f"""{A.MEMBERS_SQL}, cv AS (SELECT *, quality >= 20 AS is_substantive, body_length >= 20000 AS has_body, ['wire', 'local', 'national'][outlet % 3 + 1] AS family, ['local', 'national', 'international'][article_id % 3 + 1] AS scope, CASE WHEN is_open THEN 'open' WHEN article_id % 2 = 0 THEN 'likely_paywalled' ELSE 'unknown' END AS access,
  CASE WHEN body_length >= 20000 THEN 'article_body' WHEN body_length >= 5000 THEN 'metadata_description' ELSE 'rss_only' END AS extraction_quality, article_id % 5 = 0 AS local_words FROM members)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % 3 + 1).cast("int"))
    return A.members(spark, d).select("*", (F.col("quality") >= 20).alias("is_substantive"), (F.col("body_length") >= 20000).alias("has_body"), pick(["wire", "local", "national"], "outlet").alias("family"), pick(["local", "national", "international"], "article_id").alias("scope"),
        F.when(F.col("is_open"), "open").when(F.col("article_id") % 2 == 0, "likely_paywalled").otherwise("unknown").alias("access"), F.when(F.col("body_length") >= 20000, "article_body").when(F.col("body_length") >= 5000, "metadata_description").otherwise("rss_only").alias("extraction_quality"),
        (F.col("article_id") % 5 == 0).alias("local_words"))


@query("i1_presence_counts", f"WITH {_COVER} SELECT story_id, 'framing' AS kind, framing_group AS label, count(*) AS n FROM cv GROUP BY ALL UNION ALL SELECT story_id, 'family', family, count(*) FROM cv GROUP BY ALL UNION ALL SELECT story_id, 'scope', scope, count(*) FROM cv GROUP BY ALL")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return I.presence_counts(coverage(spark, d), {"framing": "framing_group", "family": "family", "scope": "scope"})


@query("i2_perspective_status", f"""
WITH {_COVER}, c AS (SELECT story_id, count(*) FILTER (is_substantive) AS s, count(DISTINCT outlet) FILTER (is_substantive) AS so, count(DISTINCT outlet) AS outlets, count(DISTINCT framing_group) AS framings, count(DISTINCT family) AS families FROM cv GROUP BY story_id)
SELECT story_id, CASE WHEN s >= 2 AND so >= 2 THEN 'ready' ELSE 'early' END AS status, outlets, framings, families, concat_ws(',', CASE WHEN framings = 1 THEN 'one_framing' END, CASE WHEN families = 1 THEN 'one_family' END, CASE WHEN outlets = 1 THEN 'one_outlet' END) AS review FROM c""")
def i2(spark: SparkSession, d: str) -> DataFrame:
    return I.perspective_status(coverage(spark, d))


#: The lenses by their rules: the pool of each, then why it can't be offered.
_STATUS = f"""{_COVER}, l0 AS (SELECT story_id, count(*) FILTER (is_substantive) AS s, count(DISTINCT outlet) FILTER (is_substantive) AS so, count(DISTINCT framing_group) AS f, count(DISTINCT family) AS m, count(*) FILTER (is_substantive AND scope = 'local') AS l, count(*) FILTER (is_substantive AND scope = 'international') AS i, count(*) FILTER (is_substantive AND scope <> 'international') AS o FROM cv GROUP BY 1),
l1 AS (SELECT story_id, 'balanced' AS lens, s AS n, CASE WHEN s < 2 OR so < 2 THEN 'few_outlets' WHEN f < 2 AND m < 2 THEN 'one_lane' ELSE 'ready' END AS reason FROM l0 UNION ALL SELECT story_id, 'evidence', s, CASE WHEN s = 0 THEN 'nothing_read' WHEN s < 2 THEN 'thin' ELSE 'ready' END FROM l0
  UNION ALL SELECT story_id, 'local', l, CASE WHEN s < 2 OR so < 2 THEN 'few_outlets' WHEN l = 0 THEN 'no_local' ELSE 'ready' END FROM l0 UNION ALL SELECT story_id, 'international', i, CASE WHEN s < 2 OR so < 2 THEN 'few_outlets' WHEN i = 0 THEN 'no_international' WHEN o = 0 THEN 'no_counterpart' ELSE 'ready' END FROM l0),
ls AS (SELECT story_id, lens, CASE WHEN reason IN ('ready', 'thin') THEN n ELSE 0 END AS n, CASE reason WHEN 'ready' THEN 'ready' WHEN 'thin' THEN 'limited' ELSE 'unavailable' END AS status, reason FROM l1)"""


@query("i3_lens_status", f"WITH {_STATUS} SELECT * FROM ls")
def i3(spark: SparkSession, d: str) -> DataFrame:
    return I.lens_status(coverage(spark, d))


_BASE = "CASE WHEN is_substantive THEN 14 ELSE 0 END + CASE access WHEN 'open' THEN 4 WHEN 'likely_paywalled' THEN -2 ELSE 0 END + CASE extraction_quality WHEN 'article_body' THEN 8 WHEN 'metadata_description' THEN 3 ELSE 0 END + least(body_length, 800) / 200"
LENS_SQL = f"""{_STATUS}, n AS (SELECT *, count(*) OVER (PARTITION BY story_id, framing_group) AS nf, count(*) OVER (PARTITION BY story_id, family) AS ns FROM cv),
t AS (SELECT *, 'balanced' AS lens, 10.0::DOUBLE / nf + 8.0::DOUBLE / ns AS x FROM n UNION ALL SELECT *, 'evidence', CASE WHEN is_substantive THEN 10 ELSE 0 END + CASE WHEN family IN ('wire', 'public_media') THEN 6 ELSE 0 END FROM n
  UNION ALL SELECT *, 'local', CASE WHEN scope = 'local' THEN 14 ELSE -4 END + CASE WHEN local_words THEN 8 ELSE 0 END FROM n UNION ALL SELECT *, 'international', CASE WHEN scope = 'international' THEN 14 ELSE -4 END + CASE WHEN family IN ('wire', 'national') THEN 2 ELSE 0 END FROM n),
s AS (SELECT t.*, round({_BASE} + x, 6) AS score FROM t JOIN ls USING (story_id, lens) WHERE ls.status <> 'unavailable' AND is_substantive AND (lens NOT IN ('local', 'international') OR scope = lens)), r0 AS (SELECT *, row_number() OVER o AS r, first_value(framing_group) OVER o AS ff FROM s WINDOW o AS (PARTITION BY story_id, lens ORDER BY score DESC, rank_in_story, article_id)),
r AS (SELECT *, min(CASE WHEN framing_group <> ff THEN r END) OVER (PARTITION BY story_id, lens) AS sec FROM r0),
li AS (SELECT story_id, lens, article_id, row_number() OVER (PARTITION BY story_id, lens ORDER BY score DESC, rank_in_story, article_id) AS rank, score FROM r WHERE NOT (lens = 'balanced' AND sec IS NOT NULL AND r > 1 AND r < sec) QUALIFY rank <= CASE WHEN lens IN ('balanced', 'evidence') THEN 3 ELSE 2 END)"""


@query("i4_lens_items", f"WITH {LENS_SQL} SELECT story_id, lens, rank, score FROM li")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return I.lens_items(coverage(spark, d)).select("story_id", "lens", "rank", "score")


_LISTED = "SELECT story_id, string_agg(label || ' ' || n, ', ' ORDER BY n DESC, label) AS {0}, string_agg(label, ' and ' ORDER BY n DESC, label) FILTER (k <= 1) AS {0}1, string_agg(label, ' and ' ORDER BY n DESC, label) FILTER (k <= 2) AS {0}2 FROM (SELECT story_id, {1} AS label, count(*) AS n, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, {1}) AS k FROM cv GROUP BY 1, 2) GROUP BY 1"


@query("i5_build_perspective", f"""
WITH {LENS_SQL}, c AS (SELECT story_id, count(*) AS articles, count(*) FILTER (is_substantive) AS s, count(DISTINCT outlet) FILTER (is_substantive) AS so, count(DISTINCT outlet) AS outlets, count(DISTINCT framing_group) AS f, count(*) FILTER (is_substantive AND has_body) AS e, count(*) FILTER (scope = 'local') AS l, count(*) FILTER (scope = 'international') AS i,
  string_agg(article_id::VARCHAR, ',' ORDER BY rank_in_story, article_id) AS snapshot FROM cv GROUP BY story_id), fl AS ({_LISTED.format('framing', 'framing_group')}), ml AS ({_LISTED.format('family', 'family')}), sl AS ({_LISTED.format('scope', 'scope')}),
sw AS (SELECT story_id, max(status) FILTER (lens = 'balanced') AS sb, max(status) FILTER (lens = 'evidence') AS se, max(status) FILTER (lens = 'local') AS sc, max(status) FILTER (lens = 'international') AS si FROM ls GROUP BY 1),
st AS (SELECT c.*, CASE WHEN s >= 2 AND so >= 2 THEN 'ready' ELSE 'early' END AS status, sb, se, sc, si FROM c JOIN sw USING (story_id)),
n2 AS (SELECT story_id, count(*) FILTER (lens = 'balanced') AS nb, count(*) FILTER (lens = 'evidence') AS ne, count(*) FILTER (lens = 'local') AS nl, count(*) FILTER (lens = 'international') AS ni FROM li GROUP BY 1)
SELECT story_id, status, CASE WHEN status = 'early' THEN 'The desk has few sources to compare yet, mostly ' || family2 || '; what shows is ' || framing1 || '.' ELSE 'The desk compares ' || outlets || ' outlets here: ' || framing1 || ' leads, ' || family2 || ' carry most of it.' END AS summary,
 CASE WHEN status = 'early' THEN 'Mostly read through ' || family2 || '.|Only ' || framing1 || ' shows clearly.|Another full report of a different kind would widen it.' ELSE s || ' full reports stand behind the same event.|Framings seen: ' || framing2 || '.|Seen as ' || scope2 || '.' END AS takeaways, framing, family, scope,
 'balanced ' || sb || ' ' || coalesce(nb, 0) || ', evidence ' || se || ' ' || coalesce(ne, 0) || ', international ' || si || ' ' || coalesce(ni, 0) || ', local ' || sc || ' ' || coalesce(nl, 0) AS lenses,
 concat_ws(',', CASE WHEN status = 'ready' AND sb <> 'ready' THEN 'balanced_not_ready' END, CASE WHEN status = 'ready' AND se <> 'ready' THEN 'evidence_not_ready' END, CASE WHEN status = 'ready' AND l > 0 AND sc = 'unavailable' THEN 'local_missing' END, CASE WHEN status = 'ready' AND i > 0 AND si = 'unavailable' THEN 'international_missing' END) AS review, snapshot, articles, s AS substantive FROM st JOIN fl USING (story_id) JOIN ml USING (story_id) JOIN sl USING (story_id) LEFT JOIN n2 USING (story_id)""")
def i5(spark: SparkSession, d: str) -> DataFrame:
    p = I.build_perspective(coverage(spark, d), "The desk")
    listed = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws(" ", x["label"], x["n"].cast("string"))), ", ").alias(name)
    lenses = F.array_join(F.transform("lenses", lambda x: F.concat_ws(" ", x["lens"], x["status"], x["count"].cast("string"))), ", ").alias("lenses")
    ids = F.array_join(F.transform("snapshot", lambda x: x["article_id"].cast("string")), ",").alias("snapshot")
    return p.select("story_id", "status", "summary", F.array_join("takeaways", "|").alias("takeaways"), *map(listed, ("framing", "family", "scope")), lenses, F.array_join("review", ",").alias("review"), ids, "articles", "substantive")


_READY = f"""{LENS_SQL}, p AS (SELECT story_id, count(*) FILTER (lens = 'balanced') AS balanced, count(*) FILTER (lens = 'evidence') AS evidence, count(*) FILTER (lens = 'local') AS "local", count(*) FILTER (lens = 'international') AS international FROM li WHERE story_id % 2 = 0 GROUP BY story_id),
re AS (SELECT o_orderkey AS story_id, o_orderstatus = 'O' AS has_current, o_orderstatus = 'O' AND o_orderkey % 4 = 0 AS review_required, coalesce(balanced, 0) AS balanced, coalesce(evidence, 0) AS evidence, coalesce("local", 0) AS "local", coalesce(international, 0) AS international FROM orders LEFT JOIN p ON story_id = o_orderkey),
rx AS (SELECT *, concat_ws(',', CASE WHEN balanced > 0 THEN 'balanced' END, CASE WHEN evidence > 0 THEN 'evidence' END, CASE WHEN "local" > 0 THEN 'local' END, CASE WHEN international > 0 THEN 'international' END) AS available, balanced > 0 AND evidence > 0 AND "local" > 0 AND international > 0 AS all_lenses FROM re)"""


def readiness(spark: SparkSession, d: str) -> DataFrame:
    stories = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), "o_orderstatus")
    review = F.when(F.col("story_id") % 4 == 0, F.array(F.lit("balanced_not_ready"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    packs = I.lens_items(coverage(spark, d)).where("story_id % 2 = 0")
    return I.perspective_readiness(stories, stories.where("o_orderstatus = 'O'").withColumn("review", review), packs)


@query("i6_perspective_readiness", f"WITH {_READY} SELECT * FROM rx")
def i6(spark: SparkSession, d: str) -> DataFrame:
    return readiness(spark, d).select("story_id", "has_current", "review_required", *I.LENSES, F.array_join("available", ",").alias("available"), "all_lenses")


@query("i6_readiness_totals", f"WITH {_READY} SELECT count(*) AS stories, count(*) FILTER (has_current) AS with_current, count(*) FILTER (review_required) AS with_review, count(*) FILTER (all_lenses) AS with_all_lenses, count(*) FILTER (available = 'evidence') AS evidence_only FROM rx")
def i6_totals(spark: SparkSession, d: str) -> DataFrame:
    return I.readiness_totals(readiness(spark, d))


@query("i7_context_packs_basic", f"""
WITH {_COVER}, f AS (SELECT *, least(row_number() OVER (PARTITION BY story_id, framing_group ORDER BY rank_in_story, article_id), 2) AS f1 FROM cv),
b AS (SELECT story_id, 'balanced' AS lens, article_id, row_number() OVER (PARTITION BY story_id ORDER BY f1, rank_in_story, article_id) AS rank FROM f), e AS (SELECT story_id, 'evidence' AS lens, article_id, row_number() OVER (PARTITION BY story_id ORDER BY body_length DESC, article_id) AS rank FROM cv),
l AS (SELECT story_id, 'local' AS lens, article_id, row_number() OVER (PARTITION BY story_id ORDER BY rank_in_story, article_id) AS rank FROM cv WHERE scope = 'local'), n AS (SELECT story_id, 'international' AS lens, article_id, row_number() OVER (PARTITION BY story_id ORDER BY rank_in_story, article_id) AS rank FROM cv WHERE scope = 'international')
SELECT * FROM b WHERE rank <= 3 UNION ALL SELECT * FROM e WHERE rank <= 3 UNION ALL SELECT * FROM l WHERE rank <= 2 UNION ALL SELECT * FROM n WHERE rank <= 2""")
def i7(spark: SparkSession, d: str) -> DataFrame:
    return I.context_packs_basic(coverage(spark, d))


@query("i7_context_only_articles", f"""
WITH {LENS_SQL}, o AS (SELECT li.story_id + 1 AS story_id, article_id, lens FROM li), x AS (SELECT DISTINCT story_id, article_id FROM members)
SELECT story_id, article_id, string_agg(DISTINCT lens, ',' ORDER BY lens) AS lenses FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.story_id = o.story_id AND x.article_id = o.article_id) GROUP BY 1, 2""")
def i7_context(spark: SparkSession, d: str) -> DataFrame:
    """Packs of each story held against the members of the story after it."""
    packs = I.lens_items(coverage(spark, d)).withColumn("story_id", F.col("story_id") + 1)
    return I.context_only_articles(packs, A.members(spark, d))


_HIST = f"{A.REVISIONS_SQL}, hist AS (SELECT story_id, 'r' || revision AS tag, status AS signature, revision = max(revision) OVER (PARTITION BY story_id) AS is_current FROM revisions), gen AS (SELECT c_custkey AS story_id, 'g' || c_custkey AS tag, ['1-URGENT', '2-HIGH', '3-MEDIUM', 'NEW'][c_custkey % 4 + 1] AS signature FROM customer)"
_DECIDED = """cur AS (SELECT story_id, signature FROM hist WHERE is_current), st AS (SELECT story_id, signature, min(tag) AS stored FROM hist GROUP BY 1, 2),
dec AS (SELECT g.story_id, g.signature, coalesce(st.stored, g.tag) AS tag, CASE WHEN cur.signature = g.signature THEN 'unchanged' WHEN st.stored IS NOT NULL THEN 'reuse' WHEN cur.signature IS NULL THEN 'create' ELSE 'update' END AS change FROM gen g LEFT JOIN cur USING (story_id) LEFT JOIN st ON st.story_id = g.story_id AND st.signature = g.signature)"""


def published(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = A.revisions(spark, d)
    newest = r.groupBy("story_id").agg(F.max("revision").alias("m"))
    history = r.join(newest, "story_id").select("story_id", F.concat(F.lit("r"), "revision").alias("tag"), F.col("status").alias("signature"), (F.col("revision") == F.col("m")).alias("is_current"))
    signature = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "NEW"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    generated = A.table(spark, d, "customer").select(F.col("c_custkey").alias("story_id"), F.concat(F.lit("g"), "c_custkey").alias("tag"), signature.alias("signature"))
    return J.publish_revisions(history, generated)


@query("j1_publish_revisions", f"""
WITH {_HIST}, {_DECIDED}, mv AS (SELECT story_id, tag AS now FROM dec WHERE change <> 'unchanged'), al AS (SELECT * FROM hist UNION ALL SELECT story_id, tag, signature, FALSE FROM dec WHERE change IN ('create', 'update'))
SELECT story_id, tag, signature, CASE WHEN now IS NULL THEN is_current ELSE tag = now END AS is_current FROM al LEFT JOIN mv USING (story_id)""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    return published(spark, d)[0]


@query("j2_version_events", f"WITH {_HIST}, {_DECIDED} SELECT 'brief' AS scope, story_id AS scope_id, tag, CASE WHEN change = 'create' THEN 'create' ELSE 'update' END AS kind FROM dec WHERE change <> 'unchanged'")
def j2(spark: SparkSession, d: str) -> DataFrame:
    return J.version_events(published(spark, d)[1], "brief")


_VIEWS = f"{A.REVISIONS_SQL}, fl AS (SELECT *, state = 'P' AS is_current FROM revisions), best AS (SELECT story_id, arg_max(revision, (is_current, created, revision)) AS current FROM fl GROUP BY story_id), vw AS (SELECT best.story_id, current, (SELECT arg_max(revision, (created, revision)) FROM fl WHERE fl.story_id = best.story_id AND revision <> current) AS previous FROM best)"


def views(spark: SparkSession, d: str) -> DataFrame:
    return J.revision_views(A.revisions(spark, d).withColumn("is_current", F.col("state") == "P"), ["created", "revision"])


@query("j3_revision_views", f"WITH {_VIEWS} SELECT story_id, current, previous FROM vw")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d)


_PAIRS = f"{_VIEWS}, pa AS (SELECT vw.story_id, c.status AS status, p.status AS o_status, c.size // 50000 AS outlets, p.size // 50000 AS o_outlets, c.size % 5 AS paragraphs, p.size % 5 AS o_paragraphs, [c.state, 'x' || c.size % 3] AS sec, [p.state, 'x' || p.size % 3] AS o_sec FROM vw JOIN revisions c ON c.revision = current LEFT JOIN revisions p ON p.revision = previous)"


def revision_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = A.revisions(spark, d)
    lists = F.array("state", F.concat(F.lit("x"), F.col("size") % 3))
    plain = r.select("revision", "status", F.expr("size div 50000").alias("outlets"), (F.col("size") % 5).alias("paragraphs"), lists.alias("sections"), lists.alias("points"))
    other = plain.select(F.col("revision").alias("previous"), *(F.col(c).alias(f"other_{c}") for c in plain.columns[1:]))
    return views(spark, d).join(plain.withColumnRenamed("revision", "current"), "current").join(other, "previous", "left")


_LIST_MINUS = "list_filter({0}, lambda x: NOT list_contains({1}, x))"
_FEW = "list_filter([{0}], lambda x: x IS NOT NULL)[1:3]"
_BRIEF = _FEW.format(f"CASE WHEN status <> o_status THEN 'status is now ' || status END, CASE WHEN outlets > o_outlets THEN 'more outlets' WHEN outlets < o_outlets THEN 'fewer outlets' END, CASE WHEN paragraphs > o_paragraphs THEN 'longer text' WHEN paragraphs < o_paragraphs THEN 'shorter text' END, CASE WHEN len({_LIST_MINUS.format('sec', 'o_sec')}) > 0 THEN 'rewritten: ' || array_to_string({_LIST_MINUS.format('sec', 'o_sec')}, ', ') END, CASE WHEN len({_LIST_MINUS.format('sec', 'o_sec')}) > 0 THEN 'new supporting points' END")


@query("j4_brief_changes", f"WITH {_PAIRS}, ch AS (SELECT story_id, o_status, {_BRIEF} AS c FROM pa) SELECT story_id, CASE WHEN o_status IS NULL THEN 'first' WHEN len(c) = 0 THEN 'same' ELSE 'changed' END AS state, CASE WHEN o_status IS NULL THEN '' ELSE array_to_string(c, '; ') END AS changes FROM ch")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return J.brief_changes(revision_pairs(spark, d)).select("story_id", "state", F.array_join("changes", "; ").alias("changes"))


_GAIN, _LOST = _LIST_MINUS.format("sec", "o_sec"), _LIST_MINUS.format("o_sec", "sec")
_PERSP = _FEW.format(f"CASE WHEN status <> o_status THEN 'status is now ' || status END, CASE WHEN len({_GAIN}) > 0 AND len({_LOST}) > 0 THEN 'source mix shifted' WHEN len({_GAIN}) > 0 THEN 'source mix widened' WHEN len({_LOST}) > 0 THEN 'source mix narrowed' END, CASE WHEN len({_GAIN}) > 0 THEN 'gained: ' || array_to_string(list_sort({_GAIN}), ', ') END, CASE WHEN len({_LOST}) > 0 THEN 'lost: ' || array_to_string(list_sort({_LOST}), ', ') END, CASE WHEN paragraphs <> o_paragraphs THEN 'review flag changed' END, CASE WHEN outlets <> o_outlets THEN 'source mix refreshed' END")


@query("j5_perspective_changes", f"WITH {_PAIRS}, ch AS (SELECT story_id, o_status, {_PERSP} AS c FROM pa) SELECT story_id, CASE WHEN o_status IS NULL THEN 'first' WHEN len(c) = 0 THEN 'same' ELSE 'changed' END AS state, CASE WHEN o_status IS NULL THEN '' ELSE array_to_string(c, '; ') END AS changes FROM ch")
def j5(spark: SparkSession, d: str) -> DataFrame:
    r = revision_pairs(spark, d)
    for new, old in (("framings", "sections"), ("lenses", "points"), ("review", "paragraphs")):
        r = r.withColumn(new, F.col(old)).withColumn(f"other_{new}", F.col(f"other_{old}"))
    return J.perspective_changes(r).select("story_id", "state", F.array_join("changes", "; ").alias("changes"))


_TRACK = "tr AS (SELECT c_nationkey AS user_id, c_custkey AS story_id, CASE WHEN c_custkey % 3 = 0 THEN (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) END AS seen FROM customer)"


def tracking(spark: SparkSession, d: str) -> DataFrame:
    last = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("story_id")).agg(F.max("o_orderkey").alias("m"))
    c = A.table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("story_id"))
    return c.join(last, "story_id", "left").select("user_id", "story_id", F.when(F.col("story_id") % 3 == 0, F.col("m")).alias("seen"))


_TH = f"{_VIEWS}, {_TRACK}, th AS (SELECT user_id, story_id, current, coalesce(seen, previous) AS compared_to, CASE WHEN current IS NULL THEN 'pending' WHEN coalesce(seen, previous) IS NULL OR coalesce(seen = current, FALSE) THEN 'current' ELSE 'updated' END AS state FROM tr LEFT JOIN vw USING (story_id))"


@query("j6_tracked_history", f"WITH {_TH} SELECT user_id, story_id, current, compared_to, state, state = 'updated' AS has_updates FROM th")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return J.tracked_history(views(spark, d), tracking(spark, d))


@query("j7_change_timeline", f"""
WITH {A.REVISIONS_SQL}, r AS (SELECT story_id, status, row_number() OVER (PARTITION BY story_id ORDER BY created DESC, revision DESC) AS k FROM revisions)
SELECT story_id, string_agg(status, '|' ORDER BY k) AS timeline, string_agg(status, '|' ORDER BY k) FILTER (k <= 3) AS latest FROM r WHERE k <= 8 GROUP BY story_id""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    t = J.change_timeline(A.revisions(spark, d).withColumnRenamed("status", "label"), ["created", "revision"])
    return t.select("story_id", F.array_join("timeline", "|").alias("timeline"), F.array_join("latest", "|").alias("latest"))


def _actions(spark: SparkSession, d: str, action: str, name: str) -> DataFrame:
    return A.reader_events(spark, d).where(F.col("action") == action).groupBy("user_id", "story_id").agg(F.max("second").alias(name))


_ST = f"{A.READER_SQL}, sv AS (SELECT user_id, story_id, max(second) AS saved_at FROM reader WHERE action = 'save' GROUP BY 1, 2), fo AS (SELECT user_id, story_id, max(second) AS followed_at FROM reader WHERE action = 'follow' GROUP BY 1, 2), vi AS (SELECT user_id, story_id, max(second) AS viewed_at FROM reader WHERE action = 'view' GROUP BY 1, 2), stt AS (SELECT user_id, story_id, saved_at, followed_at, viewed_at FROM sv FULL JOIN fo USING (user_id, story_id) FULL JOIN vi USING (user_id, story_id) WHERE story_id % 2 = 0)"


def state(spark: SparkSession, d: str) -> DataFrame:
    stories = A.reader_events(spark, d).where("story_id % 2 = 0").select("story_id").distinct()
    return K.tracking_state(stories, _actions(spark, d, "save", "saved_at"), _actions(spark, d, "follow", "followed_at"), _actions(spark, d, "view", "viewed_at"))


@query("k1_tracking_state", f"WITH {_ST} SELECT * FROM stt")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return state(spark, d)


@query("k2_fold_tracking_events", f"""
WITH {A.READER_SQL}, f AS (SELECT user_id, story_id, coalesce(arg_max(action <> 'unsave', (second, event_id)) FILTER (action IN ('save', 'follow', 'unsave')), FALSE) AS saved, coalesce(arg_max(action = 'follow', (second, event_id)) FILTER (action = 'follow'), FALSE) AS followed,
 max(second) FILTER (action = 'view') AS viewed_at, arg_max('t' || event_id % 9, (second, event_id)) FILTER (action = 'view' AND event_id % 2 = 0) AS seen FROM reader GROUP BY 1, 2)
SELECT * FROM f WHERE saved OR followed OR viewed_at IS NOT NULL""")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return K.fold_tracking_events(A.reader_events(spark, d).withColumn("tag", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), F.col("event_id") % 9))))


@query("k3_import_tracking", f"""
WITH {_ST}, i AS (SELECT user_id + 1 AS user_id, story_id, coalesce(saved_at, viewed_at) AS saved_at, followed_at, viewed_at + 60 AS viewed_at, 'imported' AS seen FROM stt WHERE story_id % 4 = 0)
SELECT user_id, story_id, coalesce(s.saved_at, i.saved_at) AS saved_at, coalesce(s.followed_at, i.followed_at) AS followed_at, CASE WHEN s.viewed_at IS NULL THEN i.viewed_at WHEN i.viewed_at IS NULL THEN s.viewed_at ELSE greatest(s.viewed_at, i.viewed_at) END AS viewed_at, coalesce(CASE WHEN s.viewed_at % 2 = 0 THEN 'stored' END, i.seen) AS seen FROM stt s FULL JOIN i USING (user_id, story_id)""")
def k3(spark: SparkSession, d: str) -> DataFrame:
    s = state(spark, d)
    imported = s.where("story_id % 4 = 0").select((F.col("user_id") + 1).alias("user_id"), "story_id", F.coalesce("saved_at", "viewed_at").alias("saved_at"), "followed_at", (F.col("viewed_at") + 60).alias("viewed_at"), F.lit("imported").alias("seen"))
    return K.import_tracking(s.withColumn("seen", F.when(F.col("viewed_at") % 2 == 0, "stored")), imported)


@query("k4_tracked_stories", f"""
WITH {_ST}, ch AS (SELECT story_id, count(*) AS changes, max(second) AS latest_change FROM reader WHERE action = 'evidence' GROUP BY story_id), h AS (SELECT DISTINCT user_id, story_id, TRUE AS u FROM reader WHERE action = 'unsave')
SELECT user_id, story_id, coalesce(changes, 0) AS changes, latest_change, coalesce(u, FALSE) AS has_updates, coalesce(followed_at, saved_at, viewed_at) AS sort_at FROM stt LEFT JOIN ch USING (story_id) LEFT JOIN h USING (user_id, story_id) WHERE saved_at IS NOT NULL OR followed_at IS NOT NULL""")
def k4(spark: SparkSession, d: str) -> DataFrame:
    e = A.reader_events(spark, d)
    history = e.where("action = 'unsave'").select("user_id", "story_id", F.lit(True).alias("has_updates")).distinct()
    return K.tracked_stories(state(spark, d), e.where("action = 'evidence'").select("story_id", "second"), history).select("user_id", "story_id", "changes", "latest_change", "has_updates", "sort_at")


@query("k4_preview_state", f"""
WITH {_ST}, so AS (SELECT DISTINCT story_id, 's' || story_id AS slug FROM reader WHERE story_id % 7 <> 0), rc AS (SELECT user_id, CASE WHEN story_id % 3 = 0 THEN NULL WHEN story_id % 5 = 0 THEN story_id + 1000000 ELSE story_id END AS asked, CASE WHEN story_id % 11 = 0 THEN '' ELSE 's' || (story_id // 4 * 4) END AS slug, saved_at, followed_at, viewed_at FROM stt),
f AS (SELECT rc.user_id, coalesce(a.story_id, b.story_id) AS story_id, saved_at, followed_at, viewed_at FROM rc LEFT JOIN so a ON a.story_id = rc.asked LEFT JOIN so b ON b.slug = rc.slug WHERE rc.slug <> '')
SELECT user_id, story_id, 's' || story_id AS slug, min(saved_at) AS saved_at, min(followed_at) AS followed_at, max(viewed_at) AS viewed_at FROM f WHERE story_id IS NOT NULL GROUP BY user_id, story_id""")
def k4_preview(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("story_id")
    stories = A.reader_events(spark, d).where("story_id % 7 <> 0").select("story_id").distinct().withColumn("slug", F.concat(F.lit("s"), "story_id"))
    slug = F.when(s % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.expr("story_id div 4 * 4")))
    records = state(spark, d).select("user_id", F.when(s % 3 == 0, None).when(s % 5 == 0, s + 1000000).otherwise(s).alias("story_id"), slug.alias("slug"), "saved_at", "followed_at", "viewed_at")
    return K.preview_state(records, stories)


@query("k5_story_detail", f"""
WITH {LENS_SQL}, f AS (SELECT o_orderkey AS story_id, ['live', 'editorial', 'seed'][o_orderkey % 3 + 1] AS origin FROM orders), fa AS (SELECT l_orderkey AS story_id, string_agg('fact ' || l_linenumber || ' ' || l_shipdate, '|' ORDER BY l_linenumber, 'fact ' || l_linenumber || ' ' || l_shipdate) AS facts FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
p AS (SELECT story_id, count(*) FILTER (lens = 'local') AS n_local, count(*) FILTER (lens = 'balanced') AS n_balanced FROM li WHERE story_id % 5 <> 0 GROUP BY 1), ar AS (SELECT story_id, string_agg(article_id::VARCHAR, '|' ORDER BY rank_in_story, article_id) AS articles FROM members GROUP BY 1),
ev AS (SELECT l_orderkey AS story_id, string_agg(l_returnflag, '|' ORDER BY l_linenumber, l_returnflag) AS evidence FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), co AS (SELECT o_custkey AS story_id, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderdate DESC, o_orderkey DESC) AS corrections FROM orders GROUP BY 1)
SELECT story_id, coalesce(facts, '') AS facts, coalesce(articles, '') AS articles, coalesce(evidence, '') AS evidence, coalesce(corrections, '') AS corrections, CASE WHEN story_id % 4 = 0 THEN 'b' || story_id END AS brief, CASE WHEN story_id % 6 = 0 THEN 'p' || story_id END AS perspective, coalesce(n_local, 0) AS n_local, coalesce(n_balanced, 0) AS n_balanced
FROM f LEFT JOIN fa USING (story_id) LEFT JOIN p USING (story_id) LEFT JOIN ar USING (story_id) LEFT JOIN ev USING (story_id) LEFT JOIN co USING (story_id) WHERE origin <> 'seed'""")
def k5(spark: SparkSession, d: str) -> DataFrame:
    c, orders, lines = F.col, A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    stories = orders.select(c("o_orderkey").alias("story_id"), F.element_at(F.array(*map(F.lit, ("live", "editorial", "seed"))), (c("o_orderkey") % 3 + 1).cast("int")).alias("origin"))
    facts = lines.where("l_quantity > 30").select(c("l_orderkey").alias("story_id"), c("l_linenumber").alias("sort_order"), F.concat_ws(" ", F.lit("fact"), "l_linenumber", c("l_shipdate").cast("string")).alias("fact_text"))
    evidence = lines.where("l_linestatus = 'O'").select(c("l_orderkey").alias("story_id"), c("l_linenumber").alias("sort_order"), c("l_returnflag").alias("label"))
    corrections = orders.select(c("o_custkey").alias("story_id"), F.struct(F.unix_date(c("o_orderdate").cast("date")), "o_orderkey").alias("at"), c("o_orderkey").cast("string").alias("label"))
    tagged = lambda letter, n: stories.where(c("story_id") % n == 0).select("story_id", F.struct(F.concat(F.lit(letter), "story_id").alias("tag")).alias("revision"))
    detail = K.story_detail(stories, facts, A.members(spark, d), I.lens_items(coverage(spark, d)).where("story_id % 5 <> 0"), evidence, corrections, tagged("b", 4), tagged("p", 6), I.LENSES, ["seed"])
    flat = lambda name: F.array_join(name, "|").alias(name)
    return detail.select("story_id", flat("facts"), F.array_join(F.transform("articles", lambda x: x["article_id"].cast("string")), "|").alias("articles"), flat("evidence"), flat("corrections"), c("brief.tag").alias("brief"), c("perspective.tag").alias("perspective"), F.size(c("packs")["local"]).cast("long").alias("n_local"), F.size(c("packs")["balanced"]).cast("long").alias("n_balanced"))


STOP = ["that", "with", "from"]
_T = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{4,}}')), lambda x: x NOT IN ('that', 'with', 'from'))"
_SECT = f"""se AS (SELECT conv_id AS brief_id, turn AS section, ['paragraph', 'why', 'agree', 'differ', 'watch'][turn % 5 + 1] AS kind, CASE WHEN turn % 7 = 5 THEN '' ELSE text END AS text, CASE WHEN conv_id % 9 = 0 THEN 'scaffold' ELSE 'required' END AS mode, 'The' AS outlet FROM conversations WHERE role = 'assistant'),
sp AS (SELECT brief_id, list_distinct(flatten(list(t))) AS s FROM (SELECT conv_id AS brief_id, {_T.format('text')} AS t FROM conversations WHERE role <> 'assistant') GROUP BY 1),
so AS (SELECT se.*, len({_T.format('text')}) AS n_tokens, round(CASE WHEN len({_T.format('text')}) > 0 AND s IS NOT NULL THEN len(list_intersect({_T.format('text')}, s))::DOUBLE / len({_T.format('text')}) ELSE 0 END, 6) AS overlap, CASE kind WHEN 'paragraph' THEN 0.16 WHEN 'why' THEN 0.11 WHEN 'agree' THEN 0.14 WHEN 'differ' THEN 0.13 ELSE 0.10 END::DOUBLE AS lo FROM se LEFT JOIN sp USING (brief_id)),
sg AS (SELECT brief_id, section, kind, n_tokens, overlap, CASE WHEN trim(text) = '' THEN 'missing' WHEN mode = 'scaffold' THEN 'scaffold' WHEN overlap >= lo THEN 'grounded' WHEN overlap >= 0.65::DOUBLE * lo AND contains(text, outlet) THEN 'grounded' WHEN overlap >= 0.55::DOUBLE * lo THEN 'weak' ELSE 'ungrounded' END AS status FROM so)"""


def grounding(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "why", "agree", "differ", "watch"))), (F.col("turn") % 5 + 1).cast("int"))
    sections = c.where("role = 'assistant'").select(F.col("conv_id").alias("brief_id"), F.col("turn").alias("section"), kind.alias("kind"), F.when(F.col("turn") % 7 == 5, "").otherwise(F.col("text")).alias("text"), F.when(F.col("conv_id") % 9 == 0, "scaffold").otherwise("required").alias("mode"), F.lit("The").alias("outlet"))
    return M.section_grounding(sections, c.where("role <> 'assistant'").select(F.col("conv_id").alias("brief_id"), "text"), STOP)


@query("m1_section_grounding", f"WITH {_SECT} SELECT brief_id, section, kind, n_tokens, overlap, status FROM sg")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return grounding(spark, d)


@query("m2_grounding_totals", f"WITH {_SECT} SELECT count(DISTINCT brief_id) AS briefs, count(*) FILTER (status = 'grounded') AS grounded, count(*) FILTER (status = 'weak') AS weak, count(*) FILTER (status = 'ungrounded') AS ungrounded, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'scaffold') AS scaffold, 0 AS other FROM sg")
def m2_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.grounding_totals(grounding(spark, d))


@query("m2_grounding_report", f"WITH {_SECT} SELECT brief_id, count(*) AS sections, count(*) FILTER (status = 'grounded') AS grounded, round(count(*) FILTER (status = 'grounded') / nullif(count(*) FILTER (status IN ('grounded', 'weak', 'ungrounded')), 0), 6) AS ratio, coalesce(string_agg(section::VARCHAR, ',' ORDER BY section::VARCHAR) FILTER (status IN ('weak', 'ungrounded')), '') AS weak FROM sg GROUP BY brief_id")
def m2(spark: SparkSession, d: str) -> DataFrame:
    return M.grounding_report(grounding(spark, d))


_SUPPORT = f"""u1 AS (SELECT story_id, outlet, count(*) AS n FROM members GROUP BY 1, 2), u2 AS (SELECT story_id, sum(n)::BIGINT AS refs, count(*) AS outlets, arg_max(outlet, (n, -outlet)) AS dominant_outlet, max(n) AS m FROM u1 GROUP BY 1),
u3 AS (SELECT story_id, count(DISTINCT article_id) AS articles, count(DISTINCT article_id) FILTER (body_length >= 30000) AS bodies FROM members GROUP BY 1), su AS (SELECT story_id AS brief_id, refs, articles, bodies, outlets, dominant_outlet, round(m / refs, 6) AS dominant_share FROM u2 JOIN u3 USING (story_id))"""


def support(spark: SparkSession, d: str) -> DataFrame:
    return M.support_concentration(A.members(spark, d).withColumnRenamed("story_id", "brief_id").withColumn("has_body", F.col("body_length") >= 30000))


@query("m3_support_concentration", f"WITH {A.MEMBERS_SQL}, {_SUPPORT} SELECT * FROM su")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return support(spark, d)


_U = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{4,}'))"


_DUPLICATES = f"""dp AS (SELECT conv_id AS brief_id, turn AS position, {_U} AS t FROM conversations WHERE len({_U}) > 0),
du AS (SELECT x.brief_id, x.position AS i, y.position AS j, round(len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t)), 6) AS overlap FROM dp x JOIN dp y ON x.brief_id = y.brief_id AND x.position < y.position WHERE round(len(list_intersect(x.t, y.t))::DOUBLE / least(len(x.t), len(y.t)), 6) >= 0.3)"""


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return M.duplicate_paragraphs(A.table(spark, d, "conversations").select(F.col("conv_id").alias("brief_id"), F.col("turn").alias("position"), "text"), 0.3)


@query("m4_duplicate_paragraphs", f"WITH {_DUPLICATES} SELECT * FROM du")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(spark, d)


@query("m4_quote_balance", """SELECT doc_id, length(regexp_replace(text, '[^"]', '', 'g')) % 2 = 0 AND length(regexp_replace(text, '[^“]', '', 'g')) = length(regexp_replace(text, '[^”]', '', 'g')) AS balanced FROM documents""")
def m4_quotes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", M.quotes_balanced(F.col("text")).alias("balanced"))


def _flags_sql(rules: list[list[tuple[str, str, str]]]) -> tuple[str, str]:
    """CASE expressions of the flags, critical ones first, and of their number that is critical; of a group only the first that holds counts."""
    every = [("no_brief", "critical", "NOT has_brief")]
    for group in rules:
        for k, (code, severity, test) in enumerate(group):
            every.append((code, severity, " AND ".join(["has_brief", f"coalesce({test}, FALSE)", *(f"NOT coalesce({t}, FALSE)" for _, _, t in group[:k])])))
    every.sort(key=lambda r: (r[1] != "critical", r[0]))
    return ", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, _, t in every), " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for _, s, t in every if s == "critical")


_AGREES = "coalesce(agree_mode, '') <> 'scaffold' AND comparison = 0"
_LISTED, _GRAVE = _flags_sql([
    [("full_without_breadth", "critical", "status = 'full' AND NOT ready_now"), ("ready_but_early", "warning", "status <> 'full' AND ready_now")], [("readiness_stale", "warning", "stored_ready <> ready_now")],
    [("open_alternate_missing", "warning", "alternate_expected AND NOT alternate_stored")], [("stub_drives_brief", "critical", f"{_AGREES} AND (stub_shells > 0 OR snapshot_stubs > 0)"), ("context_drives_brief", "warning", f"{_AGREES} AND contextual > 0")],
    [("no_section_support", "critical", "refs = 0"), ("grounding_failures", "critical", "ratio < 0.5 OR unsupported >= 2"), ("grounding_warnings", "warning", "unsupported > 0 OR weak >= 2")],
    [("full_on_one_outlet", "critical", "status = 'full' AND outlets < 2"), ("full_with_dominant_outlet", "warning", "status = 'full' AND dominant_share >= 0.8")], [("full_on_one_article", "warning", "status = 'full' AND articles < 2")],
    [("full_on_few_bodies", "warning", "status = 'full' AND bodies < 2")], [("duplicate_paragraphs", "warning", "duplicates > 0")], [("unbalanced_quotes", "warning", "unbalanced > 0")], [("full_says_one_source", "critical", "status = 'full' AND one_source")],
    [("full_with_early_split", "warning", "status = 'full' AND early_split")], [("full_with_follow_on", "warning", "status = 'full' AND follow_on")],
])
_BALANCED = """length(regexp_replace(text, '[^"]', '', 'g')) % 2 = 0 AND length(regexp_replace(text, '[^“]', '', 'g')) = length(regexp_replace(text, '[^”]', '', 'g'))"""
_EVAL = f"""{_SECT}, {A.MEMBERS_SQL}, {_SUPPORT}, {_DUPLICATES}, gr AS (SELECT brief_id, round(count(*) FILTER (status = 'grounded') / nullif(count(*) FILTER (status IN ('grounded', 'weak', 'ungrounded')), 0), 6) AS ratio, count(*) FILTER (status IN ('ungrounded', 'missing')) AS unsupported, count(*) FILTER (status = 'weak') AS weak FROM sg GROUP BY 1),
dn AS (SELECT brief_id, count(*) AS duplicates FROM du GROUP BY 1), tx AS (SELECT conv_id AS brief_id, count(*) FILTER (NOT ({_BALANCED})) AS unbalanced, bool_or(contains(lower(text), 'one source')) AS one_source, bool_or(starts_with(trim(text), 'The')) AS early_split, bool_or(starts_with(trim(text), 'Wh')) AS follow_on FROM conversations GROUP BY 1),
mt AS (SELECT brief_id, brief_id % 11 <> 0 AS has_brief, CASE WHEN brief_id % 3 = 0 THEN 'early' ELSE 'full' END AS status, brief_id % 4 <> 1 AS ready_now, CASE WHEN brief_id % 5 <> 0 THEN brief_id % 4 <> 2 END AS stored_ready, brief_id % 6 = 0 AS alternate_expected, brief_id % 12 = 0 AS alternate_stored, CASE WHEN brief_id % 9 = 0 THEN 'scaffold' ELSE 'required' END AS agree_mode,
  brief_id % 7 AS comparison, brief_id % 2 AS stub_shells, 0 AS snapshot_stubs, 1 AS contextual, ratio, coalesce(unsupported, 0) AS unsupported, coalesce(weak, 0) AS weak, coalesce(refs, 0) AS refs, coalesce(outlets, 0) AS outlets, coalesce(articles, 0) AS articles, coalesce(bodies, 0) AS bodies, dominant_share, coalesce(duplicates, 0) AS duplicates, unbalanced, one_source, early_split, follow_on
  FROM tx LEFT JOIN gr USING (brief_id) LEFT JOIN su USING (brief_id) LEFT JOIN dn USING (brief_id)),
e0 AS (SELECT *, list_filter([{_LISTED}], lambda x: x IS NOT NULL) AS fl, {_GRAVE} AS grave FROM mt),
ev AS (SELECT *, array_to_string(fl, ',') AS flags, least(100, 30 * grave + 12 * (len(fl) - grave)) AS risk, CASE WHEN grave > 0 THEN 'critical' WHEN len(fl) > 0 THEN 'warning' ELSE 'pass' END AS priority FROM e0)"""


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each brief for the rules: its sections, support, duplicates and texts; what the tables do not hold comes from the brief's number."""
    c, b, text = F.col, F.col("brief_id"), F.col("text")
    graded = durable(grounding(spark, d).select("brief_id", "section", "status"), "graded")  # two tables are made of it
    report = M.grounding_report(graded).select("brief_id", "ratio")
    counts = graded.groupBy("brief_id").agg(F.count_if(c("status").isin("ungrounded", "missing")).alias("unsupported"), F.count_if(c("status") == "weak").alias("weak"))
    texts = A.table(spark, d, "conversations").groupBy(c("conv_id").alias("brief_id")).agg(
        F.count_if(~M.quotes_balanced(text)).alias("unbalanced"), F.bool_or(F.contains(F.lower(text), F.lit("one source"))).alias("one_source"),
        F.bool_or(F.startswith(F.trim(text), F.lit("The"))).alias("early_split"), F.bool_or(F.startswith(F.trim(text), F.lit("Wh"))).alias("follow_on"),
    )
    twice = duplicates(spark, d).groupBy("brief_id").agg(F.count("*").alias("duplicates"))
    rows = texts
    for part in (report, counts, support(spark, d).drop("dominant_outlet"), twice):
        rows = rows.join(part, "brief_id", "left")
    rows = rows.fillna(0, ["unsupported", "weak", "refs", "outlets", "articles", "bodies", "duplicates"])
    rows = rows.withColumns({
        "has_brief": b % 11 != 0, "status": F.when(b % 3 == 0, "early").otherwise("full"), "ready_now": b % 4 != 1, "stored_ready": F.when(b % 5 != 0, b % 4 != 2), "alternate_expected": b % 6 == 0, "alternate_stored": b % 12 == 0,
        "agree_mode": F.when(b % 9 == 0, "scaffold").otherwise("required"), "comparison": b % 7, "stub_shells": b % 2, "snapshot_stubs": F.lit(0), "contextual": F.lit(1),
    })
    return M.quality_flags(rows)


@query("m5_quality_flags", f"WITH {_EVAL} SELECT brief_id, flags, risk, priority FROM ev")
def m5(spark: SparkSession, d: str) -> DataFrame:
    return evaluations(spark, d).select("brief_id", F.array_join("flags", ",").alias("flags"), "risk", "priority")


@query("m6_review_sample", f"""
WITH {_EVAL}, n AS (SELECT count(*) FILTER (priority = 'critical') AS c, count(*) FILTER (priority = 'warning') AS w FROM ev),
k AS (SELECT ev.*, row_number() OVER (PARTITION BY priority ORDER BY CASE WHEN priority = 'warning' THEN risk ELSE 0 END DESC, brief_id DESC) AS k FROM ev)
SELECT brief_id, CASE priority WHEN 'pass' THEN CASE WHEN c + w = 0 THEN 'pass' ELSE 'control' END ELSE priority END AS reason FROM k, n WHERE priority = 'critical' OR (priority = 'warning' AND k <= greatest(0, 10 - least(c, 12))) OR (priority = 'pass' AND k <= CASE WHEN c + w = 0 THEN 12 ELSE 2 END)""")
def m6(spark: SparkSession, d: str) -> DataFrame:
    return M.review_sample(evaluations(spark, d).select("brief_id", "priority", "risk", F.col("brief_id").alias("newest"))).select("brief_id", "reason")


@query("m7_quality_report", f"WITH {_EVAL} SELECT count(*) AS briefs, count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (priority = 'warning') AS warning, count(*) FILTER (priority = 'pass') AS pass, count(*) FILTER (list_contains(fl, 'no_brief')) AS missing, count(*) FILTER (ready_now) AS ready, round(avg(risk), 6) AS mean_risk, round(avg(ratio), 6) AS mean_grounding FROM ev")
def m7(spark: SparkSession, d: str) -> DataFrame:
    return M.quality_report(evaluations(spark, d).withColumn("ready", F.col("ready_now")))


_SINCE = AS_OF - 3600 * 48 * 5


@query("m8_source_health", f"""
WITH {A.FETCH_SQL}, s AS (SELECT DISTINCT source_id FROM fetches), d AS (SELECT source_id, count(*) AS discoveries, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'normalized') AS normalized, count(*) FILTER (status = 'failed' AND event_id % 2 = 0) AS blocked FROM fetches WHERE second >= {_SINCE} GROUP BY 1),
a AS (SELECT source_id, count(*) AS articles, count(*) FILTER (body_length >= 400) AS substantive, count(*) FILTER (event_id % 3 = 0) AS open_articles, count(*) FILTER (event_id % 3 = 1) AS paywalled, count(*) FILTER (event_id % 3 = 1 AND NOT body_length >= 400) AS thin_paywalled, count(*) FILTER (event_id % 5 = 0) AS rendered, count(DISTINCT event_id % 17) AS stories FROM fetches WHERE second >= {_SINCE} AND status = 'fetched' GROUP BY 1),
f AS (SELECT c_custkey % 150 AS source_id, count(*) FILTER (c_mktsegment <> 'BUILDING') AS active_feeds FROM customer GROUP BY 1)
SELECT source_id, coalesce(discoveries, 0) AS discoveries, coalesce(fetched, 0) AS fetched, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending, coalesce(normalized, 0) AS normalized, coalesce(blocked, 0) AS blocked, coalesce(articles, 0) AS articles, coalesce(substantive, 0) AS substantive, coalesce(open_articles, 0) AS open_articles, coalesce(paywalled, 0) AS paywalled, coalesce(thin_paywalled, 0) AS thin_paywalled, coalesce(rendered, 0) AS rendered, coalesce(stories, 0) AS stories, coalesce(active_feeds, 0) AS active_feeds, round(substantive / articles, 6) AS substantive_rate
FROM s LEFT JOIN d USING (source_id) LEFT JOIN a USING (source_id) LEFT JOIN f USING (source_id) ORDER BY coalesce(stories, 0) DESC, coalesce(substantive, 0) DESC, coalesce(discoveries, 0) DESC, source_id LIMIT 20""")
def m8(spark: SparkSession, d: str) -> DataFrame:
    f = A.fetch_log(spark, d).withColumn("blocked", (F.col("status") == "failed") & (F.col("event_id") % 2 == 0))
    n = F.col("event_id")
    articles = f.where("status = 'fetched'").select("source_id", (n % 17).alias("story_id"), "second", (F.col("body_length") >= 400).alias("is_substantive"), (n % 3 == 0).alias("is_open"), (n % 3 == 1).alias("is_paywalled"), (n % 5 == 0).alias("rendered"))
    feeds = A.table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("source_id"), (F.col("c_mktsegment") != "BUILDING").alias("is_active"))
    return M.source_health(f.select("source_id").distinct(), f, articles, feeds, AS_OF, 48 * 5)


@query("m9_health_snapshot", f"""
WITH {A.FETCH_SQL}, w AS (SELECT source_id, second // 86400 * 86400 AS start, count(*) AS fetches, round(100.0::DOUBLE * count(*) FILTER (status <> 'failed') / count(*), 2) AS success_rate, round(100.0::DOUBLE * count(*) FILTER (status IN ('fetched', 'normalized')) / count(*), 2) AS parse_rate, second // 86400 * 86400 + 86400 - max(second) FILTER (status IN ('fetched', 'normalized')) AS freshness_lag FROM fetches GROUP BY 1, 2)
SELECT *, CASE WHEN success_rate < 50 THEN 'failing' WHEN parse_rate < 25 THEN 'unparsed' END AS degraded FROM w""")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return M.health_snapshot(A.fetch_log(spark, d), 86400)


def polls(spark: SparkSession, d: str) -> DataFrame:
    return A.fetch_log(spark, d).select(F.col("source_id").alias("feed_id"), (F.col("status") == "fetched").alias("ok"), "second", "event_id")


@query("m10_feed_state", f"""
WITH {A.FETCH_SQL}, l AS (SELECT source_id AS feed_id, max((second, event_id)) FILTER (status = 'fetched') AS l, count(*) AS polls FROM fetches GROUP BY 1)
SELECT feed_id, polls, (SELECT count(*) FROM fetches f WHERE f.source_id = feed_id AND f.status <> 'fetched' AND (l IS NULL OR (f.second, f.event_id) > l)) AS failures, (SELECT count(*) FROM fetches f WHERE f.source_id = feed_id AND f.status <> 'fetched' AND (l IS NULL OR (f.second, f.event_id) > l)) >= 3 AS degraded FROM l""")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return M.feed_state(polls(spark, d))


@query("m10_consecutive_failures", f"""
WITH {A.FETCH_SQL}, g AS (SELECT event_id, source_id, second, status, count(*) FILTER (status = 'fetched') OVER (PARTITION BY source_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING) AS g FROM fetches)
SELECT event_id, count(*) FILTER (status <> 'fetched') OVER (PARTITION BY source_id, g ORDER BY second, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g""")
def m10_runs(spark: SparkSession, d: str) -> DataFrame:
    return M.consecutive_failures(polls(spark, d)).select("event_id", "run")


@query("m11_ops_metrics", f"""
WITH {A.ARTICLES_SQL}, o AS (SELECT DISTINCT outlet, length(outlet) * 7 AS refreshed_days FROM articles WHERE outlet NOT LIKE '%1'), m AS (SELECT median(15 + article_id % 40) AS median_latency, round(avg(CASE WHEN refreshed_days IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS outlet_hit_rate, round(avg(refreshed_days), 6) AS mean_refresh_days FROM articles LEFT JOIN o USING (outlet)),
c AS (SELECT (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - 20) * 24 AS h FROM lineitem JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT median(h) AS correction_hours, count(*) AS corrections FROM c WHERE h >= 0) SELECT * FROM m, k""")
def m11(spark: SparkSession, d: str) -> DataFrame:
    a = A.articles(spark, d).withColumn("story_minute", F.col("minute") + 15 + F.col("article_id") % 40)
    known = a.select("outlet").distinct().where("outlet NOT LIKE '%1'").withColumn("refreshed_days", F.length("outlet") * 7)
    shipped = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    corrections = shipped.select(F.col("l_partkey").alias("article_id"), ((F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 20) * 24).alias("hours"))
    return M.ops_metrics(a, known, corrections)


_SESS = f"""{A.READER_SQL}, n AS (SELECT *, CASE WHEN second - lag(second) OVER (PARTITION BY user_id ORDER BY second, event_id) <= 1800 THEN 0 ELSE 1 END AS n FROM reader), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING) AS s FROM n),
ss AS (SELECT user_id, min(second) AS start, max(second) AS "end", count(*) AS events, count(*) FILTER (action = 'view') AS views, count(*) FILTER (action = 'evidence') AS evidence FROM s GROUP BY user_id, s)"""


@query("m12_reader_sessions", f'WITH {_SESS} SELECT user_id, start, "end", events, views, evidence FROM ss')
def m12_sessions(spark: SparkSession, d: str) -> DataFrame:
    return M.reader_sessions(A.reader_events(spark, d))


@query("m12_reader_metrics", f"""
WITH {_SESS}, p AS (SELECT *, start - lag("end") OVER (PARTITION BY user_id ORDER BY start) AS pause FROM ss), o AS (SELECT count(*) AS sessions, round(count(*) FILTER (views > 0 AND evidence > 0) / count(*) FILTER (views > 0), 6) AS follow_through, count(*) FILTER (pause <= 3600) AS rapid_reopens FROM p),
b AS (SELECT round(avg(CASE WHEN l > f + 1800 THEN 1.0 ELSE 0.0 END), 6) AS return_rate FROM (SELECT user_id, min(second) FILTER (action = 'follow') AS f, max(second) AS l FROM reader GROUP BY 1) WHERE f IS NOT NULL),
u AS (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM reader r WHERE r.user_id = ss.user_id AND r.action IN ('save', 'follow') AND r.second BETWEEN ss.start AND ss."end") THEN 1.0 ELSE 0.0 END), 6) AS context_usefulness FROM ss WHERE evidence > 0) SELECT * FROM o, b, u""")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return M.reader_metrics(A.reader_events(spark, d))
