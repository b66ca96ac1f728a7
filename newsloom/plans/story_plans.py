"""Queries on duplicates, neighbours and stories. Five consecutive documents stand for the articles of a story."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from newsloom.functions import text as X
from newsloom.operators import enrich as G
from newsloom.operators import grouping as GR
from newsloom.operators import neighbors as N
from newsloom.operators import similarity as E
from newsloom.operators import stories as ST
from newsloom.plans import adapters as A
from newsloom.plans import article_plans as P
from newsloom.plans.catalog import query
from newsloom.sources.scratch import durable

_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"


@query("e1_exact_duplicates", f"""
WITH {A.ARTICLES_SQL}, p AS (SELECT article_id, sha256(lower({_CLEAN.format('body_text')})) AS p FROM articles), g AS (SELECT p, min(article_id) AS canonical, count(*) AS copies FROM p GROUP BY p)
SELECT article_id, canonical, copies FROM p JOIN g USING (p)""")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_articles(A.articles(spark, d), "article_id", F.col("body_text"))


_TOKENS = "list_sort(list_distinct(regexp_extract_all(lower(headline), '[a-z0-9]{4,}')))"
NEAR_SQL = f"""{A.ARTICLES_SQL}, tk AS (SELECT min(article_id) AS k, t FROM (SELECT article_id, {_TOKENS} AS t FROM articles) WHERE len(t) > 0 GROUP BY t),
near AS (SELECT l.k AS a, r.k AS b, len(list_intersect(l.t, r.t))::DOUBLE / greatest(len(l.t), len(r.t)) AS similarity FROM tk l JOIN tk r ON l.k < r.k AND least(len(l.t), len(r.t)) >= 0.6 * greatest(len(l.t), len(r.t))
  WHERE len(list_intersect(l.t, r.t))::DOUBLE / greatest(len(l.t), len(r.t)) >= 0.6)"""


@query("e1_near_duplicates", f"WITH {NEAR_SQL} SELECT a, b, similarity FROM near")
def e1_near(spark: SparkSession, d: str) -> DataFrame:
    return E.near_pairs(A.articles(spark, d), "article_id", F.col("headline"), 0.6)


_DEDUPE = f"""{NEAR_SQL}, pr AS (SELECT article_id, 'url' AS kind, 'https://x.example/' || (article_id // 3 * 3 + article_id % 3 // 2) AS p FROM articles WHERE article_id % 10 < 4
  UNION ALL SELECT article_id, 'body', sha256(lower({_CLEAN.format('body_text')})) FROM articles WHERE {_CLEAN.format('body_text')} <> ''),
hn AS (SELECT a, b FROM near UNION SELECT b, a FROM near), hr(a, b) AS (SELECT k, k FROM tk UNION SELECT hr.a, hn.b FROM hr JOIN hn ON hn.a = hr.b), hg AS (SELECT a AS k, min(b) AS g FROM hr GROUP BY a),
hd AS (SELECT article_id, g FROM (SELECT article_id, {_TOKENS} AS t FROM articles) JOIN tk USING (t) JOIN hg USING (k)),
ls AS (SELECT kind, p, min(article_id) AS o FROM pr GROUP BY 1, 2), rel AS (SELECT article_id AS article, o AS other, kind FROM pr JOIN ls USING (kind, p) WHERE article_id <> o UNION ALL SELECT article_id, g, 'headline' FROM hd WHERE article_id <> g)"""


#: Every pair of like headlines by their smallest keys, and articles of one url, body or headline set with the smallest key of it.
_RELATIONS = f"""{NEAR_SQL}, pr AS (SELECT article_id, 'url' AS kind, 'https://x.example/' || (article_id // 3 * 3 + article_id % 3 // 2) AS p FROM articles WHERE article_id % 10 < 4
  UNION ALL SELECT article_id, 'body', sha256(lower({_CLEAN.format('body_text')})) FROM articles WHERE {_CLEAN.format('body_text')} <> '' UNION ALL SELECT article_id, 'headline', array_to_string({_TOKENS}, ' ') FROM articles WHERE len({_TOKENS}) > 0),
ls AS (SELECT kind, p, min(article_id) AS o FROM pr GROUP BY 1, 2), rel AS (SELECT article_id AS article, o AS other, kind FROM pr JOIN ls USING (kind, p) WHERE article_id <> o UNION ALL SELECT b, a, 'headline' FROM near)"""


def _with_urls(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("article_id")
    return A.articles(spark, d).withColumn("url", F.when(c % 10 < 4, F.concat(F.lit("https://x.example/"), F.expr("article_id div 3 * 3 + article_id % 3 div 2"))))


@query("e1_dedupe_articles", f"""
WITH RECURSIVE {_DEDUPE}, li AS (SELECT article AS a, other AS b FROM rel UNION SELECT other, article FROM rel), t(a, b) AS (SELECT article_id, article_id FROM articles UNION SELECT t.a, li.b FROM t JOIN li ON li.a = t.b)
SELECT a AS article_id, min(b) AS canonical FROM t GROUP BY a""")
def e1_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return E.dedupe_articles(_with_urls(spark, d), "article_id", "url", F.col("headline"), F.col("body_text"), 0.6)[0]


@query("e1_relations", f"WITH {_RELATIONS} SELECT article, other, kind FROM rel")
def e1_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.article_relations(_with_urls(spark, d), "article_id", "url", F.col("headline"), F.col("body_text"), 0.6)


@query("e2_syndication_variants", f"WITH {NEAR_SQL} SELECT a, b, x.outlet AS outlet_a, y.outlet AS outlet_b FROM near JOIN articles x ON x.article_id = a JOIN articles y ON y.article_id = b WHERE x.outlet <> y.outlet")
def e2(spark: SparkSession, d: str) -> DataFrame:
    rows = A.articles(spark, d)
    return E.syndication_variants(E.near_pairs(rows, "article_id", F.col("headline"), 0.6), rows, "article_id", "outlet").select("a", "b", "outlet_a", "outlet_b")


_E3 = f"""{A.ARTICLES_SQL}, c AS (SELECT article_id, {_CLEAN.format('headline')} AS h, {_CLEAN.format('summary')} AS s, {_CLEAN.format('body_text')} AS b FROM articles),
p AS (SELECT article_id, list_transform(list_filter(regexp_extract_all(b, '[^.!?]+[.!?]'), lambda x: length(trim(x)) >= 50)[1:3], lambda x: trim(x)) AS parts, h, s FROM c),
u AS (SELECT article_id, h, s, CASE WHEN h <> '' THEN h ELSE '' END AS t0, list_filter(CASE WHEN s <> h THEN list_concat([h, s], list_filter(parts, lambda x: x <> h AND x <> s)) ELSE list_concat([h], list_filter(parts, lambda x: x <> h)) END, lambda x: x <> '') AS l FROM p),
e AS (SELECT article_id, l, list_filter(l, lambda x, i: list_position(l, x) = i) AS once FROM u)"""


@query("e3_embedding_text", f"""
WITH {_E3}
SELECT article_id, trim(regexp_replace(regexp_replace(lower(array_to_string(once, ' ') || ' zulu alpha beta'), '[^a-z0-9 -]+', ' ', 'g'), ' +', ' ', 'g')) AS embedding_text FROM e""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    text = E.embedding_text(F.col("headline"), F.col("summary"), F.col("body_text"), F.array(F.lit("Zulu")), F.array(F.lit("beta"), F.lit("alpha")))
    return A.articles(spark, d).select("article_id", text.alias("embedding_text"))


def embedded() -> F.Column:
    """E3's text of an article."""
    return E.embedding_text(F.col("headline"), F.col("summary"), F.col("body_text"), F.expr("CAST(array() AS array<string>)"), F.expr("CAST(array() AS array<string>)"))


@query("e4_hash_embedding")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", E.hash_embedding(embedded()).alias("vector"))


@query("e4_hash_embedding_md5", f"""
WITH {_E3}, w AS (SELECT article_id, regexp_extract_all(regexp_replace(regexp_replace(lower(array_to_string(once, ' ')), '[^a-z0-9 -]+', ' ', 'g'), ' +', ' ', 'g'), '[a-z0-9]{{3,}}') AS w FROM e),
f AS (SELECT article_id, unnest(w) AS t, 1.0 AS w FROM w UNION ALL SELECT article_id, w[i] || '_' || w[i + 1], 1.75 FROM (SELECT article_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)),
n AS (SELECT article_id, w, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM f),
s AS (SELECT article_id, h % 384 AS dimension, sum(CASE WHEN (h // 65536) % 2 = 1 THEN w ELSE -w END)::DOUBLE AS w FROM n GROUP BY 1, 2 HAVING sum(CASE WHEN (h // 65536) % 2 = 1 THEN w ELSE -w END) <> 0)
SELECT article_id, dimension, w / sqrt(sum(w * w) OVER (PARTITION BY article_id)) AS weight FROM s""")
def e4_md5(spark: SparkSession, d: str) -> DataFrame:
    return E.hashed_features(A.articles(spark, d), "article_id", embedded())


_COS = "list_inner_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_inner_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_inner_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])))"


@query("e5_cosine_pairs", f"""
WITH p AS (SELECT vec_id AS a, vec_id + k AS b FROM embeddings, (SELECT unnest([1, 2, 3]) AS k))
SELECT a, b, round(coalesce({_COS}, 0), 9) AS similarity FROM p LEFT JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    v = A.table(spark, d, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select("a", (F.col("a") + F.col("k")).alias("b"))
    return E.cosine_pairs(pairs, v, "vec_id", "embedding").select("a", "b", F.round("similarity", 9).alias("similarity"))


NEIGHBORS_SQL = f"""near AS (SELECT x.vec_id AS item, y.vec_id AS neighbor, round({_COS}, 9) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id),
top AS (SELECT item, neighbor, similarity, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, neighbor) AS rank FROM near WHERE similarity >= 0.1)"""


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector whose id is divisible by 50 the neighbours among all vectors."""
    v = A.table(spark, d, "embeddings")
    return E.top_k_neighbors(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"))


_PRINTS = f"""wd AS (SELECT article_id, outlet, regexp_extract_all(lower(coalesce(body_text, '')), '[a-z0-9]+') AS w FROM articles),
gm AS (SELECT article_id, outlet, i - 1 AS p, len(w) - {E.GRAM - 1} AS n, substr(md5(array_to_string(w[i:i + {E.GRAM - 1}], ' ')), 1, 16) AS h FROM (SELECT *, unnest(generate_series(1, len(w) - {E.GRAM - 1})) AS i FROM wd WHERE len(w) >= {E.GRAM})),
wn AS (SELECT article_id, outlet, p, n, min(h || lpad((1000000000 - p)::VARCHAR, 10, '0')) OVER (PARTITION BY article_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {E.WINDOW - 1} FOLLOWING) AS m FROM gm),
fp AS (SELECT article_id, any_value(outlet) AS outlet, substr(m, 1, 16) AS h, min(1000000000 - substr(m, 17)::BIGINT) AS p FROM wn WHERE p <= greatest(n - {E.WINDOW}, 0) GROUP BY article_id, substr(m, 1, 16))"""


@query("e2_body_fingerprints", f"WITH {A.ARTICLES_SQL}, {_PRINTS} SELECT article_id, h AS print, p AS place FROM fp")
def e2_prints(spark: SparkSession, d: str) -> DataFrame:
    return E.body_fingerprints(A.articles(spark, d), "article_id", F.col("body_text"))


#: Articles of equal words are one text, by its smallest key; every pair of texts that two outlets hold, and the copies of each.
@query("e2_syndicated_bodies", f"""
WITH {A.ARTICLES_SQL}, {_PRINTS}, tx AS (SELECT article_id, outlet, md5(array_to_string(w, ' ')) AS d FROM wd WHERE len(w) >= {E.GRAM}), cl AS (SELECT d, min(article_id) AS k, min(outlet) AS o1, max(outlet) AS o2 FROM tx GROUP BY d),
f AS (SELECT k, o1, o2, h, fp.p FROM cl JOIN fp ON fp.article_id = k), sz AS (SELECT k, count(*) AS n, min(p) AS p FROM f GROUP BY k),
sh AS (SELECT a.k AS article, b.k AS other, count(*) AS shared, min(a.p) AS place, min(b.p) AS place_in_other FROM f a JOIN f b ON a.h = b.h AND a.k > b.k WHERE a.o1 <> b.o1 OR a.o1 <> b.o2 OR a.o2 <> b.o1 GROUP BY 1, 2)
SELECT article, other, shared, shared / x.n AS share, shared / y.n AS share_of_other, place, place_in_other FROM sh JOIN sz x ON x.k = article JOIN sz y ON y.k = other WHERE greatest(shared / x.n, shared / y.n) >= 0.5
UNION ALL SELECT article_id, k, n, 1::DOUBLE, 1::DOUBLE, sz.p, sz.p FROM tx JOIN cl USING (d) JOIN sz USING (k) WHERE article_id <> k""")
def e2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return E.syndicated_bodies(A.articles(spark, d), "article_id", "outlet", F.col("body_text"), own=True)


@query("e6_top_k_neighbors", f"WITH {NEIGHBORS_SQL} SELECT item, neighbor, similarity, rank FROM top WHERE rank <= 6")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return neighbors(spark, d)


@query("e6_lsh_neighbors")
def e6_lsh(spark: SparkSession, d: str) -> DataFrame:
    return E.lsh_neighbors(A.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("e6_ivf_neighbors")
def e6_ivf(spark: SparkSession, d: str) -> DataFrame:
    return N.ivf_neighbors(A.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("e7_neighbor_recall", f"""
WITH {NEIGHBORS_SQL}, m AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) - 1 AS mates FROM embeddings),
h AS (SELECT item, count(*) AS hits FROM top JOIN embeddings x ON x.vec_id = item JOIN embeddings y ON y.vec_id = neighbor AND x.label = y.label WHERE rank <= 6 GROUP BY item)
SELECT count(*) AS items, avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(coalesce(hits, 0)::DOUBLE / least(mates, 6)) AS recall FROM m LEFT JOIN h ON item = vec_id WHERE mates > 0 AND vec_id % 50 = 0""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    v = A.table(spark, d, "embeddings")
    return E.neighbor_recall(neighbors(spark, d), v, "vec_id", "label", items=v.where("vec_id % 50 = 0"))


@query("e8_cluster_audit", """
WITH c AS (SELECT vec_id % 7 + 7 * label AS s, label % 5 AS l, count(*) AS n FROM embeddings GROUP BY 1, 2)
SELECT (SELECT sum(n * (n - 1) / 2) FROM c) / (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY s)) AS precision, (SELECT sum(n * (n - 1) / 2) FROM c) / (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY l)) AS recall""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "embeddings").select((F.col("vec_id") % 7 + 7 * F.col("label")).alias("s"), (F.col("label") % 5).alias("l"))
    return E.cluster_audit(rows, "s", "l")


LOW, ANCHOR_STOP = ["thon", "andh"], ["ing", "ion"]
_SIG = P._SIGNAL
ITEM_SQL = f"""{P.SCORED_SQL}, item AS (SELECT *, article_id // 5 AS story_id, {_SIG} AS signal, list_filter(t, lambda x: starts_with(x, 'th')) AS entities, length({_CLEAN.format('body_text')}) >= 180 OR quality >= 6 AS is_substantive, access_signal = 'open' AS is_open FROM scored)"""
#: Items that preferred_members keeps, and the anchors of story_query.
PREFERRED_SQL = "pm AS (SELECT * FROM (SELECT *, CASE WHEN NOT stub AND signal >= 3 THEN 0 WHEN NOT stub AND context < 2 THEN 1 WHEN NOT stub THEN 2 ELSE 3 END AS tier FROM item) QUALIFY tier = min(tier) OVER (PARTITION BY story_id))"
ANCHORS_SQL = "an AS (SELECT * FROM (SELECT *, CASE WHEN is_substantive AND context < 2 AND NOT stub THEN 0 WHEN is_substantive AND NOT stub THEN 1 WHEN is_substantive THEN 2 ELSE 3 END AS tier FROM item) QUALIFY tier = min(tier) OVER (PARTITION BY story_id))"


def story_items(spark: SparkSession, d: str) -> DataFrame:
    rows = P.articles(spark, d).withColumn("story_id", F.expr("article_id div 5"))
    rows = rows.withColumn("signal", P.signal_column()).withColumn("entities", F.filter("tokens", lambda x: F.startswith(x, F.lit("th"))))
    return rows.withColumns({"is_substantive": (F.length(X.squeeze(F.col("body_text"))) >= 180) | (F.col("quality") >= 6), "is_open": F.col("access_signal") == "open", "has_body": F.col("extraction_quality") == "article_body"})


_IN = "list_filter({0}, lambda x: x NOT IN ({1}))"
_Q = lambda words: ", ".join(f"'{w}'" for w in words)
def _scores_sql(pairs: str, out: str) -> str:
    """CTEs from pairs (a_t, b_t, a_g, b_g, a_e, b_e, ac, bc, similarity) to ``out`` with the features, gated, bare and score."""
    return f"""{out}_0 AS (SELECT *, list_intersect(a_t, b_t) AS sh, {_IN.format('list_intersect(a_t, b_t)', _Q(P.BROAD))} AS sp, list_intersect(a_g, b_g) AS tg, len(list_intersect(a_e, b_e)) AS entities FROM {pairs}),
{out}_1 AS (SELECT *, len(sh) AS overlap, len(sp) AS specific, len({_IN.format('sp', _Q(LOW))}) AS anchored, len({_IN.format('sp', _Q([*LOW, *ANCHOR_STOP]))}) AS event_anchors, len(list_filter(tg, lambda x: x <> 'generic')) AS strong, len(list_filter(tg, lambda x: x = 'generic')) AS gen,
  len(a_t) + len(b_t) - len(sh) AS un, least(len(a_t), len(b_t)) AS sm FROM {out}_0),
{out}_2 AS (SELECT *, (gen > 0 AND strong = 0 AND entities = 0 AND anchored < 2) OR (((ac AND NOT bc) OR (NOT ac AND bc)) AND event_anchors < 2 AND entities < 2 AND similarity < 0.66) AS gated, strong + gen + entities + anchored = 0 AS bare FROM {out}_1),
{out} AS (SELECT *, CASE WHEN gated OR len(a_t) = 0 OR (overlap = 0 AND strong + gen = 0) OR (bare AND similarity < 0.42) THEN 0.0 ELSE 8 * strong + 3 * gen + 2.5 * specific + 3 * anchored + 3.5 * event_anchors + 1.25 * overlap + 4 * CASE WHEN un > 0 THEN overlap::DOUBLE / un ELSE 0 END + 5 * CASE WHEN sm > 0 THEN specific::DOUBLE / sm ELSE 0 END + 2 * entities + 12 * similarity
  + CASE WHEN strong > 0 AND specific > 0 THEN 3 ELSE 0 END + CASE WHEN gen > 0 AND anchored >= 2 THEN 1.5 ELSE 0 END + CASE WHEN similarity >= 0.42 AND (strong > 0 OR anchored > 0 OR entities > 0) THEN 3 ELSE 0 END - CASE WHEN ac THEN 4.5 ELSE 0 END - CASE WHEN ac AND NOT bc THEN 3.5 ELSE 0 END END AS score FROM {out}_2)"""


_JOINS = """(score >= 12 OR (NOT gated AND CASE WHEN bare THEN similarity >= 0.42 ELSE (similarity >= 0.42 AND (anchored > 0 OR entities > 0 OR strong > 0)) OR (similarity >= 0.32 AND (anchored >= 2 OR entities >= 1))
 OR (strong > 0 AND anchored >= 1) OR (gen > 0 AND anchored >= 2) OR event_anchors >= 2 OR anchored >= 4 OR (anchored >= 3 AND overlap >= 4) END))"""
PAIR_SQL = f"""{ITEM_SQL}, pr AS (
  SELECT x.story_id, x.article_id AS a, y.article_id AS b, x.t AS a_t, y.t AS b_t, x.tags AS a_g, y.tags AS b_g, x.entities AS a_e, y.entities AS b_e, x.context >= 2 AS ac, y.context >= 2 AS bc, ((x.article_id + y.article_id) % 10) / 20.0 AS similarity
  FROM item x JOIN item y ON x.story_id = y.story_id AND x.article_id <> y.article_id), {_scores_sql('pr', 'sc')}"""


def scored_pairs(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    rows = (durable(story_items(spark, d), "items") if items is None else items).select("story_id", "article_id", "tokens", "tags", "entities", (F.col("context") >= 2).alias("contextual"))
    side = lambda n: rows.select("story_id", F.col("article_id").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in ("tokens", "tags", "entities", "contextual")))
    pairs = side("a").join(side("b"), "story_id").where("a <> b").withColumn("similarity", ((F.col("a") + F.col("b")) % 10) / 20.0)
    return ST.match_score(ST.pair_features(pairs, broad=P.BROAD, low_signal=LOW, anchor_stop=ANCHOR_STOP, generic_tags=["generic"]))


@query("f1_match_score", f"WITH {PAIR_SQL} SELECT a, b, overlap, anchored, round(score, 6) AS score FROM sc")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return scored_pairs(spark, d).select("a", "b", "overlap", "anchored", F.round("score", 6).alias("score"))


@query("f2_should_join", f"WITH {PAIR_SQL} SELECT a, b, {_JOINS} AS joins FROM sc")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return ST.should_join(scored_pairs(spark, d)).select("a", "b", "joins")


@query("f4_recluster_changes", """
WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS item, l_suppkey AS s FROM lineitem WHERE l_quantity < 48), n AS (SELECT l_orderkey * 10 + l_linenumber AS item, CASE WHEN l_quantity > 40 THEN -l_suppkey ELSE l_suppkey // 2 END AS s FROM lineitem WHERE l_quantity > 2),
o1 AS (SELECT item, max(s) AS s FROM o GROUP BY item), n1 AS (SELECT item, max(s) AS s FROM n GROUP BY item),
b AS (SELECT o1.s AS was, n1.s AS now FROM o1 FULL JOIN n1 USING (item)), l AS (SELECT DISTINCT was, now FROM b WHERE was IS NOT NULL AND now IS NOT NULL)
SELECT 'split' AS kind, count(*) AS stories FROM (SELECT was FROM l GROUP BY was HAVING count(*) > 1) UNION ALL SELECT 'merged', count(*) FROM (SELECT now FROM l GROUP BY now HAVING count(*) > 1)
UNION ALL SELECT 'added', count(*) FROM b WHERE was IS NULL UNION ALL SELECT 'gone', count(*) FROM b WHERE now IS NULL""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), "l_suppkey", "l_quantity")
    now = F.when(F.col("l_quantity") > 40, -F.col("l_suppkey")).otherwise(F.expr("l_suppkey div 2"))
    old = rows.where("l_quantity < 48").groupBy("item").agg(F.max("l_suppkey").alias("story"))
    return ST.recluster_changes(old, rows.where("l_quantity > 2").groupBy("item").agg(F.max(now).alias("story")))


def _regrouped(spark: SparkSession, d: str, hours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The articles of the last hours grouped again; what is stored groups them by text, five to a story. Minutes are article numbers here, so an hour is sixty articles."""
    rows = grouping_items(spark, d)
    stored = rows.select("article_id", F.expr("article_id div 5 * 5").alias("story_id"))
    since = (rows.agg(F.max("minute")).first()[0] or 0) - 60 * hours
    return GR.recluster_window(rows, stored, _neighbor_graph(spark, d), since, broad=P.BROAD, low_signal=LOW, anchor_stop=ANCHOR_STOP, generic_tags=["generic"])


@query("f4_recluster_24h")
def f4_day(spark: SparkSession, d: str) -> DataFrame:
    _, changes, moved = _regrouped(spark, d, 24)
    return changes.unionByName(moved.agg(F.count("*").alias("stories")).select(F.lit("moved").alias("kind"), "stories"))


@query("f4_recluster_72h")
def f4_days(spark: SparkSession, d: str) -> DataFrame:
    return _regrouped(spark, d, 72)[2]


@query("f4_moved_items", """
WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS article_id, max(l_suppkey) AS was FROM lineitem WHERE l_quantity < 48 GROUP BY 1), n AS (SELECT l_orderkey * 10 + l_linenumber AS article_id, max(CASE WHEN l_quantity > 49 THEN -l_suppkey WHEN l_suppkey % 9 = 0 THEN l_suppkey - 1 ELSE l_suppkey + 1000000 END) AS now FROM lineitem WHERE l_quantity > 2 GROUP BY 1),
b AS (SELECT *, count(*) OVER (PARTITION BY was, now) AS c, count(*) OVER (PARTITION BY was) AS x, count(*) OVER (PARTITION BY now) AS y FROM o JOIN n USING (article_id)) SELECT article_id, was, now FROM b WHERE c < x OR c < y""")
def f4_moved(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"), "l_suppkey", "l_quantity")
    now = F.when(F.col("l_quantity") > 49, -F.col("l_suppkey")).when(F.col("l_suppkey") % 9 == 0, F.col("l_suppkey") - 1).otherwise(F.col("l_suppkey") + 1000000)
    old = rows.where("l_quantity < 48").groupBy("article_id").agg(F.max("l_suppkey").alias("story_id"))
    return GR.moved_items(old, rows.where("l_quantity > 2").groupBy("article_id").agg(F.max(now).alias("story_id")))


@query("f5_low_confidence_queue", f"WITH {PAIR_SQL} SELECT a, b, round(score, 6) AS score FROM sc WHERE abs(score - 12) <= 2")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return ST.low_confidence(scored_pairs(spark, d), 2.0).select("a", "b", F.round("score", 6).alias("score"))


_LABEL = f"""{PREFERRED_SQL}, lc AS (SELECT story_id, tk, count(*) AS n FROM (SELECT story_id, unnest(t) AS tk FROM pm) WHERE tk NOT IN ({_Q(P.BROAD)}) GROUP BY 1, 2), lr AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, tk) AS k FROM lc),
la AS (SELECT story_id, coalesce(string_agg(tk, ' ' ORDER BY k) FILTER (k <= 3), 'story') AS label FROM (SELECT DISTINCT story_id FROM item) LEFT JOIN lr USING (story_id) GROUP BY story_id)"""


@query("f6_story_label", f"WITH {ITEM_SQL}, {_LABEL} SELECT story_id, label FROM la")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return ST.story_label(story_items(spark, d), "tokens", P.BROAD)


_LEAD = f"""{PREFERRED_SQL}, nw AS (SELECT story_id, max(minute) AS newest FROM item GROUP BY 1), m AS (SELECT pm.*, newest FROM pm JOIN nw USING (story_id)),
ce AS (SELECT story_id, a AS article_id, sum(score) AS central FROM sc GROUP BY 1, 2),
ls AS (SELECT m.*, round(2 * quality + coalesce(central, 0) + CASE extraction_quality WHEN 'article_body' THEN 6 WHEN 'metadata_description' THEN 2 ELSE 0 END + 1.5 * greatest(signal, 0) - 6 * context - CASE WHEN stub THEN 9 ELSE 0 END - least((newest - minute) / 60, 12), 6) AS lead_score
  FROM m LEFT JOIN ce USING (story_id, article_id)),
le AS (SELECT story_id, article_id AS lead_id, lead_score FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY lead_score DESC, minute DESC, article_id) AS k FROM ls) WHERE k = 1)"""


@query("f7_story_lead", f"WITH {PAIR_SQL}, {_LEAD} SELECT * FROM le")
def f7(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    items = durable(story_items(spark, d), "items") if items is None else items
    return ST.story_lead(items, scored_pairs(spark, d, items).select("story_id", F.col("a").alias("article_id"), "score"))


_SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"


@query("f9_story_payload", f"""
WITH {PAIR_SQL}, {_LEAD}, {_LABEL.replace(PREFERRED_SQL + ", ", "")}, r AS (SELECT *, row_number() OVER (PARTITION BY story_id, outlet ORDER BY context, stub, signal DESC, quality DESC, minute DESC, article_id) AS o FROM item),
p AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY least(o, 2), context, stub, signal DESC, quality DESC, minute DESC, article_id) AS k FROM r),
q AS (SELECT story_id, count(*) AS articles, count(DISTINCT outlet) AS outlets, max(minute) AS newest, string_agg(article_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS picks FROM p GROUP BY story_id),
so AS (SELECT story_id, string_agg(outlet, ',' ORDER BY f) AS sources FROM (SELECT story_id, outlet, min(k) AS f FROM p WHERE k <= 3 GROUP BY 1, 2) GROUP BY 1)
SELECT q.*, sources, label, headline AS title, {_SLUG.format('headline')} AS slug FROM q JOIN so USING (story_id) JOIN la USING (story_id) JOIN le USING (story_id) JOIN item i ON i.article_id = lead_id""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    items = durable(story_items(spark, d).drop("body_text", "words"), "items")  # the features are computed once
    leads = f7(spark, d, items).select("story_id", F.col("lead_id").alias("article_id")).join(items.select("article_id", F.col("headline").alias("title")), "article_id").select("story_id", "title", ST.slug(F.col("title")).alias("slug"))
    return ST.story_payload(items, 3, [ST.story_label(items, "tokens", P.BROAD), leads])


@query("f9_story_slug", f"WITH {A.ARTICLES_SQL} SELECT article_id, {_SLUG.format('headline')} AS slug FROM articles")
def f9_slug(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", ST.slug(F.col("headline")).alias("slug"))


_QUERY = f"""{ANCHORS_SQL}, qu AS (SELECT story_id, 1 AS w, x FROM (SELECT story_id, unnest(t) AS x FROM an) WHERE x NOT IN ({_Q([*P.BROAD, *LOW])}) UNION ALL SELECT story_id, 2, x FROM (SELECT story_id, unnest(entities) AS x FROM an) WHERE length(x) >= 4),
qc AS (SELECT story_id, w, x, count(*) AS n FROM qu GROUP BY ALL), qr AS (SELECT *, row_number() OVER (PARTITION BY story_id, w ORDER BY n DESC, x) AS k FROM qc),
qq AS (SELECT story_id, list(x ORDER BY k) FILTER (w = 1 AND k <= 6) AS qt, list(x ORDER BY k) FILTER (w = 2 AND k <= 6) AS qe FROM (SELECT DISTINCT story_id FROM item) LEFT JOIN qr USING (story_id) GROUP BY story_id)"""


@query("f10_story_query", f"WITH {ITEM_SQL}, {_QUERY} SELECT story_id, array_to_string(qt, ' ') AS tokens, array_to_string(qe, ' ') AS entities FROM qq")
def f10(spark: SparkSession, d: str) -> DataFrame:
    found = ST.story_query(story_items(spark, d), "tokens", "entities", P.BROAD, LOW)
    return found.select("story_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("entities", " ").alias("entities"))


_THIN = """th AS (SELECT story_id, count(DISTINCT outlet) = 1 AS t1, count(*) FILTER (quality >= 25) <= 1 AS t2, count(*) FILTER (body_length >= 30000) <= 1 AS t3, count(*) FILTER (NOT is_open) > 0 AND count(*) FILTER (is_open AND quality >= 25) = 0 AS t4 FROM members GROUP BY story_id)"""


@query("f11_needs_augmentation", f"WITH {A.MEMBERS_SQL}, {_THIN} SELECT story_id, t1 OR t2 OR t3 OR t4 AS needed, CASE WHEN t1 THEN 4 ELSE 0 END + CASE WHEN t2 THEN 3 ELSE 0 END + CASE WHEN t3 THEN 2 ELSE 0 END + CASE WHEN t4 THEN 2 ELSE 0 END AS priority FROM th")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return ST.needs_augmentation(A.members(spark, d).withColumn("is_substantive", F.col("quality") >= 25).withColumn("is_event", F.col("body_length") >= 30000))


PRIORITY_SQL = f"""{A.MEMBERS_SQL}, pl AS (SELECT story_id, count(DISTINCT outlet) AS outlets, count(*) AS articles, CASE WHEN story_id % 3 = 0 THEN 'world' ELSE 'sport' END AS topic, max(quality) - 30 AS quality, count(*) FILTER (quality >= 25) AS substantive FROM members GROUP BY story_id),
pri AS (SELECT *, 12 * outlets + 4 * articles + CASE WHEN topic = 'world' THEN 10 ELSE -10 END + least(greatest(quality, -10), 12) + 6 * substantive + CASE WHEN outlets >= 3 THEN 8 WHEN outlets = 1 THEN -8 ELSE 0 END + CASE substantive WHEN 0 THEN -8 WHEN 1 THEN -2 ELSE 0 END + story_id % 4 AS priority FROM pl)"""


def prioritised(spark: SparkSession, d: str) -> DataFrame:
    payloads = A.members(spark, d).groupBy("story_id").agg(F.countDistinct("outlet").alias("outlets"), F.count("*").alias("articles"), (F.max("quality") - 30).alias("quality"), F.count_if(F.col("quality") >= 25).alias("substantive"))
    payloads = payloads.withColumn("topic", F.when(F.col("story_id") % 3 == 0, "world").otherwise("sport"))
    return ST.story_priority(payloads, ["world"], F.col("story_id") % 4)


@query("f13_story_priority", f"WITH {PRIORITY_SQL} SELECT story_id, priority, priority >= 18 AND outlets >= 2 AND (substantive >= 2 OR quality >= 8) AS eligible FROM pri")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return prioritised(spark, d).select("story_id", "priority", "eligible")


@query("f14_select_stories", f"""
WITH {PRIORITY_SQL}, n AS (SELECT count(*) AS n FROM pri WHERE priority >= 6), t AS (SELECT pri.* FROM pri, n WHERE priority >= 6 OR n < 10 ORDER BY priority DESC, story_id LIMIT 14)
SELECT story_id, priority FROM t WHERE NOT (outlets = 1 AND (substantive = 0 OR quality < 0))""")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return ST.select_stories(prioritised(spark, d), "story_id").select("story_id", "priority")


@query("f15_story_record", f"""
WITH {A.MEMBERS_SQL}, m AS (SELECT *, quality >= 25 AS sub, body_length % 1000 AS minute FROM members), o AS (SELECT story_id, outlet, min(rank_in_story) AS f, count(*) AS n, bool_or(sub) AS s, max((minute, article_id)) AS last FROM m GROUP BY 1, 2),
l AS (SELECT story_id, string_agg(outlet::VARCHAR, ',' ORDER BY f, outlet) AS outlets, string_agg(outlet::VARCHAR, ', ' ORDER BY f, outlet) AS named, count(*) AS n, sum(n)::BIGINT AS a, count(*) FILTER (s) AS s, arg_max(outlet, last) AS lo, max(last) AS lm FROM o GROUP BY story_id),
g AS (SELECT story_id, count(DISTINCT CASE WHEN framing_group = 'left' THEN outlet END) AS lft, count(DISTINCT CASE WHEN framing_group = 'center' THEN outlet END) AS cen, count(DISTINCT CASE WHEN framing_group = 'right' THEN outlet END) AS rgt FROM members GROUP BY story_id),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY quality DESC, rank_in_story, outlet) AS k FROM members) WHERE k = 1),
d2 AS (SELECT x.*, row_number() OVER (PARTITION BY x.story_id ORDER BY x.quality DESC, x.rank_in_story, x.outlet) AS j FROM members x JOIN d1 USING (story_id) WHERE x.is_open AND x.outlet <> d1.outlet),
op AS (SELECT d1.story_id, d1.rank_in_story AS lead, d1.quality >= 6 AS confident, CASE WHEN d2.quality >= 7 THEN d2.rank_in_story END AS alternate FROM d1 LEFT JOIN d2 ON d2.story_id = d1.story_id AND d2.j = 1)
SELECT story_id, outlets, lft AS left_outlets, cen AS center_outlets, rgt AS right_outlets, CASE WHEN s >= 2 OR n >= 3 THEN 'mixed' ELSE 'early' END AS breadth, lead, confident, alternate,
 CASE WHEN n >= 2 THEN 'The desk links ' || a || ' reports of ' || n || ' outlets.' ELSE 'The desk links one outlet so far.' END || ' The latest came from ' || lo || '. ' || CASE WHEN n >= 2 THEN 'Framings can be compared across ' || named || '.' ELSE 'There is nothing to compare with yet.' END
 || CASE WHEN alternate IS NOT NULL THEN ' An open alternative is at hand.' WHEN confident THEN ' The lead reads well by itself.' ELSE ' No report stands out yet.' END AS key_facts, 'Put together from ' || n || ' outlets|' || lo || ' added the latest turn' AS timeline, named || '|' || lm[1] || '|' || a || ' articles of ' || n || ' outlets' AS evidence FROM l JOIN g USING (story_id) JOIN op USING (story_id)""".replace("lm[1]", "struct_extract(lm, 1)"))
def f15(spark: SparkSession, d: str) -> DataFrame:
    m = A.members(spark, d).withColumn("is_substantive", F.col("quality") >= 25).withColumn("minute", F.col("body_length") % 1000)
    record = ST.story_record(m, ST.lead_and_open_alternate(A.members(spark, d)), "The desk")
    return record.withColumns({"key_facts": F.array_join("key_facts", " "), "timeline": F.array_join("timeline.label", "|"), "evidence": F.array_join("evidence.source", "|")})


RANK_SQL = f"""{PRIORITY_SQL}, st AS (SELECT story_id, quality, outlets, 10000 - (story_id * 7) % 10000 AS minute, CASE WHEN topic = 'world' THEN 10 ELSE -14 END AS section_points, ['live', 'editorial', 'seed'][story_id % 3 + 1] AS origin, priority >= 18 AS eligible FROM pri),
rk AS (SELECT *, quality + 14 * least(outlets, 4) + CASE WHEN 10000 - minute <= 30 THEN 12 WHEN 10000 - minute <= 90 THEN 9 WHEN 10000 - minute <= 240 THEN 6 WHEN 10000 - minute <= 720 THEN 3 ELSE 0 END + section_points + CASE origin WHEN 'seed' THEN -8 WHEN 'editorial' THEN 10 ELSE 0 END
  + CASE WHEN eligible THEN 18 ELSE -18 END - CASE WHEN origin = 'live' AND outlets = 1 THEN 16 ELSE 0 END AS score FROM st)"""


def ranked_stories(spark: SparkSession, d: str) -> DataFrame:
    rows = prioritised(spark, d).withColumn("minute", 10000 - (F.col("story_id") * 7) % 10000).withColumn("section_points", F.when(F.col("topic") == "world", 10).otherwise(-14))
    rows = rows.withColumn("origin", F.element_at(F.array(*map(F.lit, ("live", "editorial", "seed"))), (F.col("story_id") % 3 + 1).cast("int"))).withColumn("eligible", F.col("priority") >= 18)
    return ST.front_page_rank(rows, 10000)


@query("f16_front_page_rank", f"WITH {RANK_SQL} SELECT story_id, score FROM rk")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return ranked_stories(spark, d).select("story_id", "score")


@query("f16_front_page_top", f"WITH {RANK_SQL} SELECT story_id, score FROM rk ORDER BY score DESC, minute DESC, story_id LIMIT 12")
def f16_top(spark: SparkSession, d: str) -> DataFrame:
    return ranked_stories(spark, d).select("story_id", "score").limit(12)


#: The page as SQL: the supports are picked in a walk over the pool by rank, with the sections used so far.
_LAYOUT = f"""{RANK_SQL}, ed AS (SELECT *, story_id % 30 AS edition, 's' || (story_id % 6) AS section, coalesce((eligible AND story_id % 7 < 5) OR (origin = 'live' AND story_id % 4 = 1) OR (quality >= 17 AND outlets >= 1), false) AS fit FROM rk),
ep AS (SELECT *, fit OR (count(*) FILTER (fit) OVER (PARTITION BY edition) < 10 AND row_number() OVER (PARTITION BY edition, fit ORDER BY score DESC, minute DESC, story_id) <= 12 - count(*) FILTER (fit) OVER (PARTITION BY edition)) AS pool FROM ed),
po AS (SELECT edition, section, story_id, row_number() OVER (PARTITION BY edition ORDER BY fit DESC, score DESC, minute DESC, story_id) AS k FROM ep WHERE pool),
pk AS (WITH RECURSIVE w(edition, k, used, taken) AS (
    SELECT edition, k, [section], CAST([] AS BIGINT[]) FROM po WHERE k = 1
    UNION ALL SELECT edition, k, CASE WHEN take THEN list_append(used, section) ELSE used END, CASE WHEN take THEN list_append(taken, story_id) ELSE taken END FROM (
      SELECT w.edition, po.k, used, taken, section, story_id, len(taken) < 5 AND len(list_filter(used, lambda x: x = section)) < CASE WHEN len(taken) < 3 THEN 1 ELSE 2 END AS take FROM w JOIN po ON po.edition = w.edition AND po.k = w.k + 1))
  SELECT edition, arg_max(taken, k) AS taken FROM w GROUP BY 1),
su AS (SELECT edition, story_id, row_number() OVER (PARTITION BY edition ORDER BY CASE WHEN list_contains(taken, story_id) THEN 0 ELSE 1 END, k) AS place FROM po JOIN pk USING (edition) WHERE k > 1 QUALIFY place <= 5),
pi AS (SELECT edition, 'featured' AS slot, 1 AS place, story_id FROM po WHERE k = 1 UNION ALL SELECT edition, 'support', place, story_id FROM su), re AS (SELECT * FROM ep WHERE story_id NOT IN (SELECT story_id FROM pi)),
la AS (SELECT edition, 'latest' AS slot, row_number() OVER (PARTITION BY edition ORDER BY minute DESC, story_id) AS place, story_id FROM re QUALIFY place <= 8),
se AS (SELECT edition, 'section:' || section AS slot, row_number() OVER (PARTITION BY edition, section ORDER BY pool DESC, fit DESC, score DESC, minute DESC, story_id) AS place, story_id FROM re QUALIFY place <= 4)"""


@query("f17_home_layout", f"WITH {_LAYOUT} SELECT * FROM pi UNION ALL SELECT * FROM la UNION ALL SELECT * FROM se")
def f17(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = ranked_stories(spark, d).withColumn("edition", c("story_id") % 30).withColumn("section", F.concat(F.lit("s"), c("story_id") % 6))
    rows = rows.withColumns({"eligible": c("eligible") & (c("story_id") % 7 < 5), "origin": F.when((c("origin") == "live") & (c("story_id") % 4 == 1), "live").otherwise("seed")})
    return ST.home_layout(rows, good=17)


def _neighbor_graph(spark: SparkSession, d: str) -> DataFrame:
    """Six neighbours of every article by the hashed embedding of its text."""
    vectors = A.articles(spark, d).select("article_id", E.hash_embedding(embedded()).alias("vector"))
    return N.ivf_neighbors(vectors, "article_id", "vector")


def grouping_items(spark: SparkSession, d: str) -> DataFrame:
    return P.articles(spark, d).select("article_id", "minute", "tokens", "tags", F.filter("tokens", lambda x: F.startswith(x, F.lit("thea"))).alias("entities"), (F.col("context") >= 2).alias("contextual"))


@query("f3_build_stories")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return GR.build_stories(grouping_items(spark, d), _neighbor_graph(spark, d), broad=P.BROAD, low_signal=LOW, anchor_stop=ANCHOR_STOP, generic_tags=["generic"])


_NEEDY = """nd0 AS (SELECT story_id, count(DISTINCT outlet) = 1 AS t1, count(*) FILTER (is_substantive) <= 1 AS t2, count(*) FILTER (signal >= 3 AND NOT stub) <= 1 AS t3, count(*) FILTER (NOT is_open) > 0 AND count(*) FILTER (is_open AND is_substantive) = 0 AS t4 FROM item GROUP BY story_id),
nd AS (SELECT story_id, row_number() OVER (ORDER BY CASE WHEN t1 THEN 4 ELSE 0 END + CASE WHEN t2 THEN 3 ELSE 0 END + CASE WHEN t3 THEN 2 ELSE 0 END + CASE WHEN t4 THEN 2 ELSE 0 END DESC, story_id) AS need FROM nd0 WHERE t1 OR t2 OR t3 OR t4 QUALIFY need <= 4)"""


@query("f12_augment_stories", f"""
WITH {ITEM_SQL}, {_QUERY}, {_NEEDY}, ow AS (SELECT item.* FROM item JOIN nd USING (story_id)),
un AS (SELECT story_id, list_distinct(flatten(list(t))) AS b_t, list_distinct(flatten(list(tags))) AS b_g, list_distinct(flatten(list(entities))) AS b_e, bool_and(context >= 2) AS bc, bool_or(signal >= 3 AND NOT stub) AS ev FROM ow GROUP BY story_id),
hi AS (SELECT nd.story_id, need, x.article_id, x.outlet, x.t AS a_t, x.tags AS a_g, x.entities AS a_e, x.context >= 2 AS ac, b_t, b_g, b_e, bc, ev, coalesce((SELECT max(greatest(0, list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))) FROM embeddings p, embeddings q, ow WHERE p.vec_id = x.article_id AND q.vec_id = ow.article_id AND ow.story_id = nd.story_id), 0.0) AS similarity, x.context AS cx, x.stub AS sb, x.signal AS sg, x.quality AS ql, x.is_open AS op, x.extraction_quality = 'article_body' AS hb, len(list_intersect(x.t, coalesce(qt, []))) AS n_t, len(list_intersect(x.entities, coalesce(qe, []))) AS n_e
  FROM nd JOIN qq USING (story_id) JOIN un USING (story_id) JOIN item x ON x.story_id <> nd.story_id WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.story_id = nd.story_id AND ow.outlet = x.outlet)),
hm AS (SELECT * FROM hi WHERE (n_e > 0 OR n_t >= 2) AND NOT (ev AND (cx >= 2 OR sb) AND n_t < 2 AND n_e < 2)), {_scores_sql('hm', 'hs')},
fi AS (SELECT story_id, need, article_id, outlet, round(score + 3 * n_t + 2 * n_e + CASE WHEN {_JOINS} THEN 2 ELSE 0 END - 4 * cx - CASE WHEN sb THEN 8 ELSE 0 END + ql + CASE WHEN op THEN 3 ELSE 0 END + CASE WHEN hb THEN 4 ELSE 0 END + CASE WHEN sg >= 3 AND NOT sb THEN 5 ELSE 0 END, 6) AS points FROM hs),
f1 AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY need) = 1), f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY story_id, outlet ORDER BY points DESC, article_id) = 1),
f3 AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY points DESC, article_id) AS k FROM f2 QUALIFY k <= 2)
SELECT story_id, article_id, outlet, points AS score FROM f3 ORDER BY need, k LIMIT 8""")
def f12(spark: SparkSession, d: str) -> DataFrame:
    rows = story_items(spark, d)
    needy = ST.needs_augmentation(rows.withColumn("is_event", (F.col("signal") >= 3) & ~F.col("stub")))
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"))
    return ST.augment_stories(needy, rows, {"broad": P.BROAD, "low_signal": LOW, "anchor_stop": ANCHOR_STOP, "generic_tags": ["generic"]}, vectors=vectors)


def _fit(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) < 4 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


_SUMMARY = rf"""{ITEM_SQL}, ti AS (SELECT story_id, arg_min(headline, article_id) AS title FROM item GROUP BY 1), s0 AS (SELECT item.*, title, list_filter(list_transform(regexp_extract_all({_CLEAN.format('body_text')}, '[^.!?]+[.!?]'), lambda x: trim(x)), lambda x: length(x) >= 40) AS sents FROM item JOIN ti USING (story_id)),
s1 AS (SELECT *, array_to_string(sents[1:2], ' ') AS ex, {P._overlap_tokens("headline || ' ' || summary")} AS rt FROM s0), s2 AS (SELECT *, {P._overlap_tokens('ex')} AS et FROM s1),
s3 AS (SELECT *, CASE WHEN extraction_quality = 'article_body' AND ex <> '' AND NOT {P.non_narrative_sql('ex')} AND {_fit('rt', 'et')} >= 0.18 THEN ex ELSE summary END AS raw FROM s2),
s4 AS (SELECT *, {_CLEAN.format('raw')} AS c FROM s3), s5 AS (SELECT *, substr(c, 1, 320) AS h, regexp_extract(substr(c, 1, 320), '^(.*[.!?])\s', 1) AS sp, regexp_extract(c, '^(.+?[.!?])(?:\s|$)', 1) AS fs FROM s4),
s6 AS (SELECT *, CASE WHEN length(c) <= 320 THEN c WHEN length(sp) + 1 >= 176 THEN sp ELSE trim(regexp_replace(h, '\s+\S*$', '')) || '...' END AS kk FROM s5),
s7 AS (SELECT *, CASE WHEN NOT {P._clipped('kk')} THEN kk WHEN length(fs) >= 60 THEN fs ELSE '' END AS tx FROM s6),
s8 AS (SELECT *, {P._quality('headline', 'tx', 'extraction_quality', 'body_text')}::INTEGER AS sco, ({P._title_like('headline', 'tx')} AND NOT (extraction_quality = 'article_body' AND {P._TWO})) AS sst, {P._overlap_tokens('title')} AS tt, {P._overlap_tokens('tx')} AS xt FROM s7),
s9 AS (SELECT *, round({_fit('tt', 'xt')}, 6) AS al, lower({_CLEAN.format('headline')}) = lower({_CLEAN.format('title')}) AS own FROM s8),
sx AS (SELECT *, round(sco + 1.5 * greatest(signal, 0) + 5 * al - 4 * context - CASE WHEN sst THEN 8 ELSE 0 END, 6) AS sel, {{'id': article_id, 'text': tx, 'score': sco, 'al': al, 'access': access_signal}} AS pk FROM s9),
ag AS (SELECT story_id, any_value(title) AS title, arg_max(pk, (sel, -article_id)) FILTER (tx <> '') AS best, arg_max(pk, (al, sel, -article_id)) FILTER (tx <> '' AND al >= 0.28) AS fit, arg_max(pk, (sel, -article_id)) FILTER (tx <> '' AND is_open) AS opn, arg_max(pk, (sel, -article_id)) FILTER (tx <> '' AND own) AS ow,
  count(DISTINCT outlet) FILTER (sco >= 6) AS n_sources, array_to_string((list_sort(list_distinct(list(outlet))))[1:3], ', ') AS names FROM sx GROUP BY story_id),
rl AS (SELECT *, CASE WHEN fit.score >= 6 AND (best IS NULL OR best.al < fit.al - 0.12 OR fit.score >= best.score - 3) THEN 'fit' WHEN ow.score >= 6 AND ow.al >= 0.28 AND (best IS NULL OR best.al < ow.al OR ow.score >= best.score - 2) THEN 'own'
  WHEN best.score >= 6 THEN CASE WHEN best.access = 'likely_paywalled' AND opn.score >= greatest(6, best.score - 3) THEN 'open' ELSE 'best' END WHEN opn.score >= 4 THEN 'open' ELSE 'none' END AS role FROM ag),
us AS (SELECT *, CASE role WHEN 'fit' THEN fit WHEN 'own' THEN ow WHEN 'open' THEN opn WHEN 'best' THEN best END AS us FROM rl),
sm AS (SELECT story_id, us.id AS article_id, coalesce(us.text, regexp_replace({_CLEAN.format('title')}, '[?!.]+$', '') || ': first coverage from ' || names || '; The desk waits for fuller reports.') AS summary, coalesce(us.score, greatest(best.score, 0), 0) AS score, n_sources, role FROM us)"""


@query("f8_story_summary", f"WITH {_SUMMARY} SELECT * FROM sm")
def f8(spark: SparkSession, d: str) -> DataFrame:
    rows, titles = summarised(spark, d)
    return ST.story_summary(rows, titles, "The desk")


def summarised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Members with their sentences, and the titles of their stories."""
    found = F.transform(X.marked_sentences(X.squeeze(F.col("body_text"))), lambda x: F.trim(x))
    rows = story_items(spark, d).withColumn("sentences", F.filter(found, lambda x: F.length(x) >= 40))
    return rows, rows.groupBy("story_id").agg(F.min_by("headline", "article_id").alias("title"))


@query("g7_refresh_story", f"""
WITH {_SUMMARY}, to AS (SELECT DISTINCT story_id FROM item WHERE article_id % 4 = 0), rq AS (SELECT *, quality + CASE access_signal WHEN 'open' THEN 3 WHEN 'likely_paywalled' THEN -2 ELSE 0 END + CASE WHEN extraction_quality = 'article_body' THEN 2 ELSE 0 END AS rd FROM item),
l1 AS (SELECT * FROM rq QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY rd DESC, article_id, outlet) = 1), l2 AS (SELECT rq.* FROM rq JOIN l1 USING (story_id) WHERE rq.is_open AND rq.outlet <> l1.outlet QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY rq.rd DESC, rq.article_id, rq.outlet) = 1),
oc AS (SELECT story_id, count(DISTINCT outlet) AS outlets FROM item GROUP BY 1)
SELECT sm.*, outlets, outlets >= 2 AND (n_sources >= 2 OR sm.score >= 8) AS eligible, l1.article_id AS lead, l1.rd >= 6 AS confident, CASE WHEN l2.rd >= 7 THEN l2.article_id END AS alternate FROM sm JOIN to USING (story_id) JOIN oc USING (story_id) JOIN l1 USING (story_id) LEFT JOIN l2 USING (story_id)""".replace("to AS (SELECT", "tch AS (SELECT").replace("JOIN to USING", "JOIN tch USING"))
def g7(spark: SparkSession, d: str) -> DataFrame:
    rows, titles = summarised(spark, d)
    members = rows.withColumn("rank_in_story", F.col("article_id")).withColumn("read_quality", P.S.read_quality(F.col("quality"), F.col("access_signal"), F.col("extraction_quality")))
    return G.refresh_story(rows.where("article_id % 4 = 0"), members, titles, "The desk")
