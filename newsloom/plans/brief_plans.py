"""Queries on page extraction, briefs and streams. Text steps in Python are checked by unit tests; what follows from columns has SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import pages as PG
from newsloom.functions.text import STOPWORDS, marked_sentences, named_entities, settled, squeeze, strong_entities
from newsloom.operators import briefs as H
from newsloom.operators import revisions as J
from newsloom.plans import adapters as A
from newsloom.plans import article_plans as P
from newsloom.plans import story_plans as S
from newsloom.plans.catalog import query
from newsloom.sources.scratch import durable


@query("c3_c4_hidden_text")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", PG.hidden_text(F.col("html")).alias("x")).select("page_id", "x.*")


@query("c5_c16_enrich_page")
def c16(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "pages")
    return PG.extract_pages(p, "page_id", "html", F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1), F.when(F.col("page_id") % 50 == 0, 403))


_STOP4, _STOP5 = ([w for w in words if len(w) >= 4] for words in (STOPWORDS, [*STOPWORDS, *H.LOW_SIGNAL]))


def _ov(text: str, stop: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{4,}}')), lambda w: w NOT IN ({listed}))"


def _share(a: str, b: str, few: int, otherwise: float) -> str:
    return f"CASE WHEN least(len({a}), len({b})) < {few} THEN {otherwise} ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def _sources_sql() -> str:
    """CTEs up to sf: the flagged source rows, with the texts of source_texts."""
    own = {"snippet": "snippet", "headline": "headline", "detail": "detail", "followup": "followup"}
    story = {"h": "sh", "s": "ss"}
    tokens = ", ".join(f"{_ov(c, _STOP4)} AS o_{k}, {_ov(c, _STOP5)} AS f_{k}" for k, c in {**own, **story}.items())
    ratio = lambda o, a: f"CASE WHEN {P._SQUEEZE.format(own[o])} = '' OR {P._SQUEEZE.format(story[a])} = '' THEN 0.0 ELSE {_share(f'o_{a}', f'o_{o}', 4, 1.0)} END"
    columns = []
    for name, (texts, against) in H.ALIGNMENTS.items():
        pairs = [(o, a) for o in texts for a in against]
        columns.append(f"round(greatest({', '.join(ratio(o, a) for o, a in pairs)}), 4) AS {name}_alignment, greatest({', '.join(f'len(list_intersect(f_{a}, f_{o}))' for o, a in pairs)}) AS {name}_overlap")
    near = lambda n, r: f"({n}_alignment >= {r} AND {n}_overlap >= 2)"
    fx = _ov("x", _STOP5)
    like = lambda c: f"({c} = '' OR {P._title_like('headline', c)})"
    return f"""{S.ITEM_SQL}, st AS (SELECT story_id, arg_min(headline, article_id) AS sh, arg_min(summary, article_id) AS ss FROM item GROUP BY 1),
tx0 AS (SELECT item.*, sh, ss, ['left', 'center', 'right'][article_id % 3 + 1] AS framing, 'f' || article_id % 4 AS focus, article_id % 50 = 0 AS blocked, list_filter(list_transform(regexp_extract_all({P._SQUEEZE.format('body_text')}, '[^.!?]+[.!?]'), lambda x: trim(x)), lambda x: length(x) >= 40) AS sents,
  {_ov("headline || ' ' || summary", _STOP5)} AS ref FROM item JOIN st USING (story_id)),
tx1 AS (SELECT *, list_filter(sents[3:], lambda x: length(x) >= 50 AND len(list_intersect(ref, {fx})) >= 2 AND {_share('ref', fx, 2, 0.0)} >= 0.16) AS nr, list_filter(sents[3:], lambda x: length(x) >= 40 AND (len(list_intersect(ref, {fx})) >= 2 OR {_share('ref', fx, 2, 0.0)} >= 0.08)) AS lo FROM tx0),
tx2 AS (SELECT *, CASE WHEN len(sents) > 0 THEN array_to_string(sents[1:2], ' ') ELSE {P._SQUEEZE.format('summary')} END AS snippet, coalesce(nr[1], '') AS detail FROM tx1),
tx3 AS (SELECT *, coalesce(list_filter(lo, lambda x: x <> detail)[1], '') AS followup FROM tx2),
sr0 AS (SELECT *, {tokens} FROM tx3),
sr AS (SELECT *, {', '.join(columns)}, {P._title_like('headline', 'snippet')} AS title_like, extraction_quality = 'article_body' AS has_body, access_signal = 'open' AS is_open, (extraction_quality = 'article_body' AND length(trim(coalesce(body_text, ''))) >= 180 AND article_id % 60 <> 7) OR length(snippet) >= 110 AS substantive, {like('detail')} AND {like('followup')} AND {like('snippet')} AS repeats_title FROM sr0 WHERE {P._SQUEEZE.format('snippet')} <> ''),
sf0 AS (SELECT *, {near('story', 0.28)} OR {near('detail', 0.24)} OR {near('followup', 0.24)} AS aligned, {near('headline', 0.24)} OR {near('detail_headline', 0.22)} OR {near('followup_headline', 0.22)} AS shell, context >= 2 AS contextual FROM sr),
sf1 AS (SELECT * EXCLUDE (stub), repeats_title AND (title_like OR (contextual AND NOT has_body AND detail = '' AND followup = '')) AS stub FROM sf0),
sf2 AS (SELECT *, aligned AND shell AND NOT contextual AND NOT blocked AND NOT stub AS ready FROM sf1),
sf AS (SELECT *, round(3.0 * story_alignment + 1.8 * headline_alignment + 1.4 * detail_alignment + followup_alignment + CASE WHEN ready THEN 0.4 ELSE 0.0 END + CASE WHEN repeats_title THEN 0.0 ELSE 0.18 END + CASE WHEN shell THEN 0.18 ELSE -0.28 END + CASE WHEN has_body THEN 0.24 ELSE 0.0 END
  + CASE WHEN is_open THEN 0.06 ELSE 0.0 END - 0.34 * context - CASE WHEN blocked THEN 0.16 ELSE 0.0 END - CASE WHEN stub THEN 0.48 ELSE 0.0 END - CASE WHEN title_like THEN 0.12 ELSE 0.0 END - 0.01 * article_id, 6) + 0.0 AS priority FROM sf2), sfs AS (SELECT * FROM sf WHERE substantive)"""


ROWS_SQL = _sources_sql()


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Articles of stories as source texts."""
    found = F.transform(marked_sentences(squeeze(F.col("body_text"))), lambda x: F.trim(x))
    items = S.story_items(spark, d).withColumns({
        "rank": F.col("article_id"), "framing": F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), (F.col("article_id") % 3 + 1).cast("int")), "focus": F.concat(F.lit("f"), (F.col("article_id") % 4).cast("string")),
        "blocked": F.col("article_id") % 50 == 0, "body_length": F.length(F.trim(F.coalesce("body_text", F.lit("")))), "mismatch": F.col("article_id") % 60 == 7, "sentences": F.filter(found, lambda x: F.length(x) >= 40),
    })
    keep = ["story_id", "article_id", "rank", "outlet", "framing", "headline", "summary", "extraction_quality", "access_signal", "context", "blocked", "body_length", "mismatch", "focus", "sentences"]
    return H.source_texts(items.select(*keep))


def told(spark: SparkSession, d: str) -> DataFrame:
    """The stories' own headlines and summaries, from the articles alone."""
    first = lambda c, name: F.min_by(c, "article_id").alias(name)
    return A.articles(spark, d).groupBy(F.expr("article_id div 5").alias("story_id")).agg(first("headline", "story_headline"), first("summary", "story_summary"), first("outlet", "family"))


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Flagged source rows, written once: what builds on them reads them several times."""
    return durable(H.source_flags(H.source_rows(told(spark, d).drop("family"), texts(spark, d))), "sources")


_SIX = ", ".join(f"{n}_alignment, {n}_overlap" for n in H.ALIGNMENTS)


@query("h1_source_rows", f"WITH {ROWS_SQL} SELECT story_id, article_id, snippet, detail, followup, {_SIX}, title_like, has_body, is_open, substantive FROM sr")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("story_id", "article_id", "snippet", "detail", "followup", *(f"{n}_{k}" for n in H.ALIGNMENTS for k in ("alignment", "overlap")), "title_like", "has_body", "is_open", "substantive")


@query("h2_source_flags", f"WITH {ROWS_SQL} SELECT story_id, article_id, aligned, shell AS shell_aligned, contextual, stub, ready AS comparison_ready, priority FROM sf")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("story_id", "article_id", "aligned", "shell_aligned", "contextual", "stub", "comparison_ready", "priority")


_H3_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]{{4,}}'))"
_LIKE = "CASE WHEN greatest(len({0}), len({1})) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / greatest(len({0}), len({1})) END >= 0.72"


@query("h3_dedupe_sources", f"""
WITH {ROWS_SQL}, tk AS (SELECT story_id, article_id, {_H3_TOKENS.format('snippet')} AS t, {_H3_TOKENS.format('sh')} AS h, count(*) OVER (PARTITION BY story_id) AS c FROM tx3),
fl AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY article_id) AS k FROM tk WHERE NOT (c > 1 AND {_LIKE.format('t', 'h')})),
wk AS (WITH RECURSIVE w(story_id, k, article_id, stays, kept) AS (
    SELECT story_id, k, article_id, true, [t] FROM fl WHERE k = 1
    UNION ALL SELECT story_id, k, article_id, fresh, CASE WHEN fresh THEN list_append(kept, t) ELSE kept END FROM (SELECT fl.*, kept, len(list_filter(kept, lambda u: {_LIKE.format('u', 'fl.t')})) = 0 AS fresh FROM w JOIN fl ON fl.story_id = w.story_id AND fl.k = w.k + 1))
  SELECT story_id, article_id FROM w WHERE stays)
SELECT * FROM wk""")
def h3(spark: SparkSession, d: str) -> DataFrame:
    found = texts(spark, d).join(told(spark, d).select("story_id", "story_headline"), "story_id").select("story_id", "article_id", "rank", "snippet", "story_headline")
    return H.dedupe_sources(found, text="snippet", anchors=["story_headline"]).select("story_id", "article_id")


_BEST = "priority DESC, story_alignment DESC, detail_alignment DESC, has_body DESC, is_open DESC, article_id"


@query("h4_ranked_sources", f"WITH {ROWS_SQL} SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY {_BEST}) AS position FROM sf WHERE ready")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return H.ranked_sources(rows(spark, d), core_only=True).select("story_id", "article_id", "position")


@query("h4_best_sources", f"""
WITH {ROWS_SQL}, al AS (SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY (aligned AND NOT stub) DESC, aligned DESC, {_BEST}) AS k FROM sf) WHERE k = 1),
sh AS (SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY stub, {_BEST}) AS k FROM sf WHERE shell) WHERE k = 1), co AS (SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY {_BEST}) AS k FROM sf WHERE ready) WHERE k = 1)
SELECT al.story_id, al.article_id AS aligned_id, sh.article_id AS shell_id, co.article_id AS comparison_id FROM al LEFT JOIN sh USING (story_id) LEFT JOIN co USING (story_id)""")
def h4_best(spark: SparkSession, d: str) -> DataFrame:
    return H.best_sources(rows(spark, d))


def _repeats(x: str, y: str) -> str:
    a, b = (f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]{{4,}}'))" for t in (x, y))
    n = f"len(list_intersect({a}, {b}))::DOUBLE"
    return f"(contains(lower({y}), lower({x})) OR (greatest(len({a}), len({b})) > 0 AND {n} / greatest(len({a}), len({b}), 1) >= 0.72) OR (least(len({a}), len({b})) > 0 AND {n} / greatest(least(len({a}), len({b})), 1) >= 0.66))"


_T4 = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{4,}}'))"
_DIV = f"""ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY ready DESC, {_BEST}) AS k FROM sf) WHERE k = 1),
pr AS (SELECT f.*, ld.focus AS lf, ld.framing AS lr, list_filter([ld.snippet, ld.detail, ld.followup], lambda t: t <> '') AS given, {_T4.format('f.snippet')} AS ta, {_T4.format('ld.snippet')} AS tb FROM sf f JOIN ld USING (story_id) WHERE f.ready AND f.outlet <> ld.outlet AND f.article_id <> ld.article_id),
fr AS (SELECT *, len(list_intersect(ta, tb))::DOUBLE AS n, len(list_filter([detail, followup, snippet], lambda t: t <> '' AND len(list_filter(given, lambda g: {_repeats('t', 'g')})) = 0)) > 0 AS fresh FROM pr),
dv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY round(priority + CASE WHEN focus <> '' AND focus <> lf THEN 0.3 ELSE 0.0 END + CASE WHEN framing <> lr THEN 0.15 ELSE 0.0 END
  + 0.4 * (1 - greatest(CASE WHEN greatest(len(ta), len(tb)) = 0 THEN 0 ELSE n / greatest(len(ta), len(tb)) END, CASE WHEN least(len(ta), len(tb)) = 0 THEN 0 ELSE n / least(len(ta), len(tb)) END)), 6) DESC, {_BEST}) AS j FROM fr WHERE fresh) WHERE j = 1),
di AS (SELECT ld.story_id, ld.article_id AS lead_id, dv.article_id AS divergent_id FROM ld LEFT JOIN dv USING (story_id))"""


@query("h5_divergent_source", f"WITH {ROWS_SQL}, {_DIV} SELECT * FROM di")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return H.divergent_source(rows(spark, d))


@query("h6_brief_readiness", f"""
WITH {ROWS_SQL}, {_DIV.replace('FROM sf', 'FROM sfs')}, c AS (SELECT story_id, count(*) FILTER (substantive) AS sources, count(DISTINCT outlet) FILTER (substantive) AS substantive, count(DISTINCT outlet) FILTER (substantive AND has_body) AS bodies, count(DISTINCT outlet) FILTER (substantive AND aligned) AS aligned, count(DISTINCT outlet) FILTER (substantive AND shell) AS shell_aligned, count(DISTINCT outlet) FILTER (substantive AND shell AND has_body) AS shell_bodies,
  count(DISTINCT outlet) FILTER (substantive AND ready) AS comparison, count(DISTINCT outlet) FILTER (substantive AND ready) AS core, count(DISTINCT outlet) FILTER (substantive AND shell AND stub) AS stub_shells, count(DISTINCT outlet) FILTER (substantive AND contextual) AS contextual, count(DISTINCT outlet) FILTER (substantive AND is_open) AS open, count(DISTINCT outlet) FILTER (substantive AND access_signal = 'likely_paywalled') AS paywalled FROM sf GROUP BY 1),
r AS (SELECT c.*, substantive >= 2 AND comparison >= 2 AND shell_bodies >= 1 AND core >= 2 AND divergent_id IS NOT NULL AS ready FROM c JOIN di USING (story_id)), b AS (SELECT DISTINCT o_orderkey AS story_id, CASE WHEN o_orderstatus = 'O' THEN 'full' ELSE 'early' END AS brief_status, o_orderpriority AS brief_tag FROM orders)
SELECT r.*, brief_status, brief_tag, CASE WHEN brief_status IS NULL THEN CASE WHEN ready THEN 'missing_full' ELSE 'missing_early' END WHEN ready AND brief_status <> 'full' THEN 'upgrade' WHEN NOT ready AND brief_status = 'full' THEN 'overstated' ELSE 'in_step' END AS state FROM r LEFT JOIN b USING (story_id)""")
def h6(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    stored = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.when(F.col("o_orderstatus") == "O", "full").otherwise("early").alias("brief_status"), F.col("o_orderpriority").alias("brief_tag"))
    return H.brief_readiness(r, H.divergent_source(r.where("substantive")), stored)


@query("h7_open_alternate", f"""
WITH {ROWS_SQL}, o AS (SELECT f.story_id, f.article_id, row_number() OVER (PARTITION BY f.story_id ORDER BY f.ready DESC, {_BEST}) AS k FROM sf f WHERE f.is_open AND (f.ready OR (f.aligned AND NOT f.stub)) AND f.outlet <> 'src0')
SELECT story_id, article_id AS alternate_id FROM o WHERE k = 1""")
def h7(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    return H.open_alternate(r, r.where("outlet = 'src0'").select("story_id", "outlet").distinct())


def _focus_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in [*STOPWORDS, *H.LOW_SIGNAL])
    vague = ", ".join(f"'{w}'" for w in H.VAGUE)
    joined = "|".join(H.CONNECTORS)
    bare = lambda x: f"regexp_extract(regexp_replace(trim(regexp_replace({x}, '[.!?\"'']+', '', 'g')), '(?i)^((the|a|an|{joined}) +)+', ''), '^([^ ]+(?: [^ ]+){{0,7}})', 1)"
    once = lambda x: f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"
    return f"""fa AS (SELECT article_id, outlet, [headline, summary] AS tx FROM articles), fs AS (SELECT *, list_filter(flatten(list_transform(tx, lambda t: string_split_regex({P._SQUEEZE.format('t')}, ' *[:;,–—] *'))), lambda x: x <> '') AS sg FROM fa),
fp AS (SELECT *, list_transform(list_concat(list_transform(sg, lambda x: regexp_extract(x, '(?i)^.*? (?:{joined}) (.+)$', 1)), sg), lambda x: {bare('x')}) AS ph FROM fs),
fq AS (SELECT *, list_filter({once('ph')}, lambda x: x <> '') AS pq FROM fp),
fc AS (SELECT *, list_transform(pq, lambda x: {{'x': x, 'c': list_filter(regexp_extract_all(lower(x), '[a-z0-9'']{{3,}}'), lambda w: w NOT IN ({stop}))}}) AS pc FROM fq),
fd AS (SELECT *, list_transform(pc, lambda r: {{'x': r.x, 'n': len(r.c), 'u': len(list_filter(r.c, lambda w: w NOT IN ({vague}))), 'l': length(coalesce(r.c[1], '')), 'p': len(r.c) + CASE WHEN len(string_split(r.x, ' ')) BETWEEN 2 AND 6 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(r.x, '(?i)(^| )({joined}) ') THEN 0 ELSE 1 END}}) AS pd FROM fc),
fe AS (SELECT *, list_filter(pd, lambda r: r.n >= 3 OR (r.n >= 2 AND r.u > 0) OR (r.n = 1 AND r.u = 1 AND r.l >= 8)) AS sp FROM fd),
ff AS (SELECT *, list_max(list_transform(sp, lambda r: r.p)) AS mp, list_filter(regexp_extract_all(lower(array_to_string(tx, ' ')), '[a-z]{{4,}}'), lambda w: w NOT IN ({stop}, {vague})) AS wd FROM fe),
fo AS (SELECT article_id, coalesce(lower(list_filter(sp, lambda r: r.p = mp)[1].x), CASE WHEN article_id % 2 = 0 THEN 'zulu' END, CASE WHEN len(wd) > 0 THEN array_to_string(({once('wd')})[1:2], ' and ') END, outlet) AS focus FROM ff)"""


@query("h8_focus_phrase", f"WITH {A.ARTICLES_SQL}, {_focus_sql()} SELECT article_id, focus FROM fo")
def h8(spark: SparkSession, d: str) -> DataFrame:
    entities = F.when(F.col("article_id") % 2 == 0, F.array(F.lit("Zulu"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return A.articles(spark, d).select("article_id", H.focus_phrase(F.array("headline", "summary"), entities, F.col("outlet")).alias("focus"))


@query("h9_build_brief")
def h9(spark: SparkSession, d: str) -> DataFrame:
    focus = H.focus_phrase(F.array("headline", "summary"), F.expr("CAST(array() AS array<string>)"), F.col("outlet"))
    members = settled(texts(spark, d).withColumn("focus", focus))
    stories = told(spark, d)
    facts = A.table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("story_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("facts"))
    stories = stories.join(facts, "story_id", "left").withColumn("corrections", F.when(F.col("story_id") % 7 == 0, F.array(F.lit("a figure was corrected"))))
    return H.build_brief(stories, H.source_flags(H.source_rows(stories.select("story_id", "story_headline", "story_summary"), members)), "The desk")


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]{{4,}}'))"


@query("h10_brief_visibility", f"""
WITH p AS (SELECT conv_id AS brief_id, list(text ORDER BY turn) AS p, min(text) AS headline, max(text) AS summary FROM conversations GROUP BY 1),
a AS (SELECT *, [{_TOK.format('headline')}, {_TOK.format('summary')}, {_TOK.format('p[1]')}] AS an, list_transform(p[2:], lambda x: {_TOK.format('x')}) AS lt FROM p),
f AS (SELECT *, len(list_filter(lt, lambda t: len(t) > 0 AND len(list_filter(an, lambda a: CASE WHEN least(len(a), len(t)) = 0 THEN 0 ELSE len(list_intersect(a, t))::DOUBLE / least(len(a), len(t)) END >= 0.82)) = 0)) AS fresh FROM a)
SELECT brief_id, CASE WHEN len(p) < 2 THEN 'too_short' WHEN fresh = 0 THEN 'repeats' END AS reason, len(p) >= 2 AND fresh > 0 AS visible FROM f""")
def h10(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("brief_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("paragraphs"), F.min("text").alias("headline"), F.max("text").alias("summary"))
    return H.brief_visibility(c).select("brief_id", "reason", "visible")


@query("h11_input_signature", """
SELECT o_orderkey, sha256('{"o_clerk_n":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS signature FROM orders""")
def h11(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "orders").withColumn("o_clerk_n", F.col("o_custkey")).select("o_orderkey", J.input_signature("o_orderstatus", "o_clerk_n").alias("signature"))


@query("c11_strong_entities")
def c11_strong(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", strong_entities(named_entities(F.col("text"))).alias("entities"))
