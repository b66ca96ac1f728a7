"""Queries on article features and scores; lexicons are words of the test tables so that both branches occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scoring as S
from newsloom.functions import text as X
from newsloom.operators import stories as ST
from newsloom.plans import adapters as A
from newsloom.plans.catalog import query

STOP = ["the", "and", "that", "with", "was", "for"]
BROAD = ["thea", "anth", "erth"]
RULES = S.RULES | {"context_headline": "(?i)^(the|an|de) ", "context_url": "/2", "commentary": r"(?i)(^|[^A-Za-z0-9_])was($|[^A-Za-z0-9_])", "explainer": ["of the"], "event": r"(?i)(^|[^A-Za-z0-9_])(with|from|es)($|[^A-Za-z0-9_])", "context_tokens": ["are", "thi", "hav"]}
TAGS = {"alpha": ["th", "with"], "beta": ["ch", "und"], "gamma": ["ción"], "generic": ["an"]}
DESKS = [("world", [("thea", 3), ("with", 1)]), ("politics", [("from", 2), ("und", 2)]), ("science", [("ción", 3)])]

_SQUEEZE = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_STEM = "w"
for _ending in X.STEM_ENDINGS:
    _STEM = f"regexp_replace({_STEM}, '{_ending}', '\\1')"


def tokens_sql(name: str, source: str, column: str, stop: list[str]) -> str:
    """CTE (article_id, t): sorted distinct stems."""
    listed = ", ".join(f"'{s}'" for s in stop)
    return f"""{name}_w AS (SELECT article_id, unnest(regexp_extract_all(lower({column}), '[a-z]{{3,}}')) AS w FROM {source}),
{name}_s AS (SELECT DISTINCT article_id, {_STEM} AS s FROM {name}_w),
{name} AS (SELECT a.article_id, coalesce(t, []) AS t FROM {source} a LEFT JOIN (SELECT article_id, list(s ORDER BY s) AS t FROM {name}_s WHERE s NOT IN ({listed}) GROUP BY 1) USING (article_id))"""


def _overlap_tokens(column: str, least: int = 4) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]{{{least},}}'))"


def _title_like(title: str, text: str) -> str:
    a, b = f"lower({_SQUEEZE.format(title)})", f"lower({_SQUEEZE.format(text)})"
    ta, tb = _overlap_tokens(a), _overlap_tokens(b)
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR (CASE WHEN len({tb}) > 0 THEN len(list_intersect({ta}, {tb}))::DOUBLE / len({tb}) ELSE 0 END >= 0.85 AND len({tb}) <= len({ta}) + 2)))"


def _clipped(text: str) -> str:
    c = _SQUEEZE.format(text)
    count = lambda x: f"(length({c}) - length(replace({c}, '{x}', '')))"
    return (
        f"(regexp_matches({c}, '(^|[^A-Za-z0-9_])[A-Z][a-z]+ [A-Z]\\.$') OR (length({c}) >= 80 AND (regexp_matches({c}, '(\\.\\.\\.|…)$') OR {count('“')} > {count('”')} OR {count(chr(34))} % 2 = 1"
        f" OR NOT regexp_matches({c}, '[.!?]$') OR regexp_matches({c}, '(?i)(^|[^a-z''])(a|an|the|to|of|in|on|for|with|from|at)[^a-z'']+[a-z'']{{1,2}}[^a-z'']*$'))))"
    )


def _quality(title: str, summary: str, quality: str, body: str) -> str:
    c = _SQUEEZE.format(summary)
    words = f"len(regexp_extract_all({c}, '[A-Za-z0-9'']+'))"
    return f"""(CASE {quality} WHEN 'article_body' THEN 6 WHEN 'metadata_description' THEN 3 ELSE 0 END
 + CASE WHEN {words} >= 18 THEN 5 WHEN {words} >= 12 THEN 3 WHEN {words} >= 8 THEN 1 ELSE -5 END
 + CASE WHEN length({c}) >= 180 THEN 4 WHEN length({c}) >= 110 THEN 2 WHEN length({c}) >= 80 THEN 1 ELSE -3 END
 + CASE WHEN regexp_matches({c}, '[.!?]$') THEN 1 ELSE 0 END + CASE WHEN length({_SQUEEZE.format(body)}) >= 240 THEN 2 ELSE 0 END
 - CASE WHEN {_clipped(c)} THEN 4 ELSE 0 END - CASE WHEN {_title_like(title, c)} THEN 8 ELSE 0 END)"""


_TWO = rf"regexp_matches({_SQUEEZE.format('body_text')}, '(?s)[.!?] +[A-Z].*[.!?]')"
_STUB = f"({_title_like('headline', 'summary')} AND NOT (extraction_quality = 'article_body' AND {_TWO}))"
_D4 = _quality("headline", "summary", "extraction_quality", "body_text")
SCORED_SQL = f"""{A.ARTICLES_SQL}, {tokens_sql('tok', 'articles', "headline || ' ' || summary", STOP)},
base AS (SELECT a.*, t, 'https://x.example/' || a.article_id AS url, {_STUB} AS stub, {_D4} AS quality,
  list_filter([CASE WHEN contains(body_text, 'th') AND contains(body_text, 'with') THEN 'alpha' END, CASE WHEN contains(body_text, 'ch') AND contains(body_text, 'und') THEN 'beta' END, CASE WHEN contains(body_text, 'ción') THEN 'gamma' END, CASE WHEN contains(body_text, 'an') THEN 'generic' END], lambda x: x IS NOT NULL) AS tags
  FROM articles a JOIN tok USING (article_id)),
ctx AS (SELECT *, regexp_matches(headline, '(?i)^(the|an|de) ') AS ch,
  (CASE WHEN regexp_matches(headline, '(?i)^(the|an|de) ') THEN 3 ELSE 0 END + CASE WHEN contains(url, '/2') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(headline || ' ' || summary, '(?i)(^|[^A-Za-z0-9_])was($|[^A-Za-z0-9_])') THEN 3 ELSE 0 END
   + CASE WHEN contains(headline, '?') THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(list_distinct(t), ['are', 'thi', 'hav'])) >= 2 THEN 1 ELSE 0 END + CASE WHEN contains(lower(headline || ' ' || summary), 'of the') THEN 1 ELSE 0 END
   + CASE WHEN stub THEN 2 ELSE 0 END - CASE WHEN regexp_matches(headline, '(?i)(^|[^A-Za-z0-9_])(with|from|es)($|[^A-Za-z0-9_])') THEN 1 ELSE 0 END) AS plain FROM base),
scored AS (SELECT *, greatest(plain - CASE WHEN extraction_quality = 'article_body' AND plain > 0 AND NOT ch THEN 1 ELSE 0 END, 0) AS context FROM ctx)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with tokens, tags, url, D4 quality, stub and context score."""
    a = A.articles(spark, d).withColumn("url", F.concat(F.lit("https://x.example/"), "article_id"))
    args = [F.col(c) for c in ("headline", "summary", "extraction_quality", "body_text")]
    both = F.concat_ws(" ", "headline", "summary")
    return a.select(
        "*", X.match_tokens(both, STOP).alias("tokens"), X.event_tags(F.col("body_text"), TAGS).alias("tags"),
        S.summary_quality(*args).alias("quality"), S.is_title_only_stub(*args).alias("stub"),
        S.context_score(F.col("headline"), F.col("summary"), F.col("url"), F.col("extraction_quality"), F.col("body_text"), RULES).alias("context"),
    )


def _any(column: str, patterns: list[str]) -> str:
    return " OR ".join("regexp_matches({}, '{}')".format(column, p.replace("'", "''")) for p in patterns)


def non_narrative_sql(s: str) -> str:
    return f"(length({s}) < 60 OR {_any(s, X.NON_NARRATIVE)} OR ({_any(s, [X.CAPTION_OPENING])} AND ({_any(s, [X.DAY_OR_MONTH])} OR ({_any(s, [X.CAPTION_SCENE])} AND NOT {_any(s, [X.REPORTING])}))))"


@query("c7_non_narrative", f"WITH {A.ARTICLES_SQL}, c AS (SELECT article_id, {_SQUEEZE.format('summary')} AS s FROM articles) SELECT article_id, {non_narrative_sql('s')} AS non_narrative FROM c")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", X.is_non_narrative(F.col("summary")).alias("non_narrative"))


@query("c8_looks_clipped", f"WITH {A.ARTICLES_SQL} SELECT article_id, {_clipped('summary')} AS clipped FROM articles")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", X.looks_clipped(F.col("summary")).alias("clipped"))


@query("c8_clean_snippet", rf"""
WITH {A.ARTICLES_SQL}, c AS (SELECT article_id, {_SQUEEZE.format('body_text')} AS c FROM articles), h AS (SELECT article_id, c, substr(c, 1, 320) AS h, regexp_extract(substr(c, 1, 320), '^(.*[.!?])\s', 1) AS st FROM c),
k AS (SELECT article_id, c, CASE WHEN length(c) <= 320 THEN c WHEN length(st) + 1 >= 176 THEN st ELSE trim(regexp_replace(h, '\s+\S*$', '')) || '...' END AS k, regexp_extract(c, '^(.+?[.!?])(?:\s|$)', 1) AS f FROM h)
SELECT article_id, CASE WHEN NOT {_clipped('k')} THEN k WHEN length(f) >= 60 THEN f ELSE '' END AS snippet FROM k""")
def c8_snippet(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", X.clean_snippet(F.col("body_text"), 320).alias("snippet"))


@query("c11_named_entities", r"""
WITH d AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([^A-Za-z0-9_])', '\1\1', 'g') AS t FROM documents), -- every mark twice, so that it may end one run and begin the next
r AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])((?:[A-Z][a-z]+|[A-Z]{2,})(?:  (?:[A-Z][a-z]+|[A-Z]{2,})){0,3})(?:$|[^A-Za-z0-9_])', 1), lambda x: replace(x, '  ', ' ')) AS e FROM d),
u AS (SELECT doc_id, e, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM r),
f AS (SELECT doc_id, x, min(k) AS k FROM u WHERE length(x) >= 4 AND lower(x) NOT IN ('the', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') GROUP BY 1, 2),
n AS (SELECT doc_id, x, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f)
SELECT doc_id, coalesce(string_agg(x, '|' ORDER BY k) FILTER (n <= 8), '') AS entities FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.array_join(X.named_entities(F.col("text")), "|").alias("entities"))


@query("c12_match_tokens", f"WITH {A.ARTICLES_SQL}, {tokens_sql('tok', 'articles', 'body_text', STOP)} SELECT article_id, array_to_string(t, ' ') AS tokens, len(t) AS n FROM tok")
def c12(spark: SparkSession, d: str) -> DataFrame:
    t = X.match_tokens(F.col("body_text"), STOP)
    return A.articles(spark, d).select("article_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query("c13_event_tags", """
SELECT doc_id, concat_ws('|', CASE WHEN contains(text, 'th') AND contains(text, 'with') THEN 'alpha' END, CASE WHEN contains(text, 'ch') AND contains(text, 'und') THEN 'beta' END, CASE WHEN contains(text, 'ción') THEN 'gamma' END, CASE WHEN contains(text, 'an') THEN 'generic' END) AS tags FROM documents""")
def c13(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.array_join(X.event_tags(F.col("text"), TAGS), "|").alias("tags"))


_L, _R = _overlap_tokens("headline"), _overlap_tokens("summary")


@query("c14_token_overlap", f"""
WITH {A.ARTICLES_SQL}, o AS (SELECT article_id, {_L} AS a, {_overlap_tokens('body_text')} AS b, list_filter({_overlap_tokens('body_text')}, lambda x: x NOT IN ('that', 'from', 'with')) AS c FROM articles),
m AS (SELECT *, len(list_intersect(a, b)) AS s, least(len(a), len(b)) AS lo, greatest(len(a), len(b)) AS hi, len(list_intersect(a, c)) AS s2, least(len(a), len(c)) AS lo2 FROM o)
SELECT article_id, s AS shared, CASE WHEN hi = 0 THEN 0 ELSE round(s / hi, 6) END AS similarity, CASE WHEN lo = 0 THEN 0 ELSE round(s / lo, 6) END AS narrative,
 CASE WHEN lo2 < 4 THEN 1.0 ELSE round(s2 / lo2, 6) END AS alignment, CASE WHEN lo2 < 2 THEN 0.0 ELSE round(s2 / lo2, 6) END AS focused FROM m""")
def c14(spark: SparkSession, d: str) -> DataFrame:
    a, b = X.overlap_tokens(F.col("headline")), X.overlap_tokens(F.col("body_text"))
    rows = A.articles(spark, d).select("article_id", a.alias("a"), b.alias("b"), X.overlap_tokens(F.col("body_text"), ["that", "from", "with"]).alias("c"))
    o = lambda r, k: F.round(X.token_overlap(F.col("a"), F.col(r), k), 6).alias(k)
    return rows.select("article_id", X.token_overlap(F.col("a"), F.col("b"), "count").cast("long").alias("shared"), o("b", "similarity"), o("b", "narrative"), o("c", "alignment"), o("c", "focused"))


@query("c15_title_like", f"WITH {A.ARTICLES_SQL} SELECT article_id, {_title_like('headline', 'summary')} AS title_like FROM articles")
def c15(spark: SparkSession, d: str) -> DataFrame:
    return A.articles(spark, d).select("article_id", X.title_like(F.col("headline"), F.col("summary")).alias("title_like"))


@query("d1_context_score", f"WITH {SCORED_SQL} SELECT article_id, context::INTEGER AS context, context >= 2 AS contextual FROM scored")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("article_id", "context", (F.col("context") >= 2).alias("contextual"))


_SIGNAL = """(CASE WHEN regexp_matches(headline, '(?i)(^|[^A-Za-z0-9_])(with|from|es)($|[^A-Za-z0-9_])') THEN 3 ELSE 0 END + CASE WHEN extraction_quality = 'article_body' THEN 2 ELSE 0 END + CASE WHEN access_signal = 'open' THEN 1 ELSE 0 END
 + 2 * least(len(tags), 2) + least(len(list_filter(t, lambda x: length(x) >= 7)), 2) + least(len(list_filter(t, lambda x: starts_with(x, 'th'))), 2) - 2 * context)"""


def signal_column() -> F.Column:
    anchors, entities = F.filter("tokens", lambda x: F.length(x) >= 7), F.filter("tokens", lambda x: F.startswith(x, F.lit("th")))
    return S.event_signal(F.col("headline"), F.col("extraction_quality"), F.col("access_signal"), F.col("tags"), anchors, entities, F.col("context"), RULES)


@query("d2_event_signal", f"WITH {SCORED_SQL} SELECT article_id, {_SIGNAL}::INTEGER AS signal, {_SIGNAL} >= 3 AS event_driven FROM scored")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("article_id", signal_column().alias("signal")).withColumn("event_driven", F.col("signal") >= 3)


@query("d3_title_only_stub", f"WITH {A.ARTICLES_SQL} SELECT article_id, {_STUB} AS stub FROM articles")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("article_id", "stub")


@query("d4_summary_quality", f"WITH {A.ARTICLES_SQL} SELECT article_id, {_D4}::INTEGER AS quality FROM articles")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("article_id", "quality")


GOOD, BAD = [("with", 3), ("ción", 2)], [("!!", 6), (r" \| ", 4)]
_D5 = "(CASE outlet WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END + CASE WHEN contains(h, 'with') THEN 3 ELSE 0 END + CASE WHEN contains(h, 'ción') THEN 2 ELSE 0 END - CASE WHEN contains(h, '!!') THEN 6 ELSE 0 END - CASE WHEN contains(h, ' | ') THEN 4 ELSE 0 END + least(greatest(quality, -8), 8))"
D5_SQL = f"{SCORED_SQL}, item AS (SELECT *, {_D5}::INTEGER AS score FROM (SELECT *, lower(headline || ' ' || summary || ' ' || url) AS h FROM scored))"


def items(spark: SparkSession, d: str) -> DataFrame:
    bonus = F.when(F.col("outlet") == "src0", 3).when(F.col("outlet") == "src1", 2)
    return articles(spark, d).withColumn("score", S.item_quality(F.lower(F.concat_ws(" ", "headline", "summary", "url")), bonus, F.col("quality"), GOOD, BAD))


@query("d5_item_quality", f"WITH {D5_SQL} SELECT article_id, score FROM item")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("article_id", "score")


def _d6_sql(least: int) -> str:
    return f"""
WITH {D5_SQL}, r AS (SELECT article_id, outlet, score, row_number() OVER (PARTITION BY outlet ORDER BY score DESC, article_id) AS k, row_number() OVER (ORDER BY score DESC, article_id) AS g FROM item WHERE score >= {least} OR TRUE),
c AS (SELECT article_id, outlet, score FROM (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY score DESC, article_id) AS kk FROM r WHERE score >= {least}) WHERE kk <= 4),
n AS (SELECT count(*) AS n FROM c), a AS (SELECT count(*) AS a FROM r)
SELECT article_id, outlet, score FROM c, n WHERE n >= 18 UNION ALL SELECT article_id, outlet, score FROM r, n, a WHERE n < 18 AND g <= greatest(18, a // 2)"""


@query("d6_select_candidates", _d6_sql(4))
def d6(spark: SparkSession, d: str) -> DataFrame:
    return ST.select_candidates(items(spark, d).select("article_id", "outlet", "score"), "score", "outlet", "article_id")


@query("d6_select_candidates_fallback", _d6_sql(40))
def d6_fallback(spark: SparkSession, d: str) -> DataFrame:
    return ST.select_candidates(items(spark, d).select("article_id", "outlet", "score"), "score", "outlet", "article_id", least=40)


@query("d7_substantive", f"""
WITH {A.ARTICLES_SQL}, l AS (SELECT article_id, length({_SQUEEZE.format('body_text')}) AS b, length({_SQUEEZE.format('summary')}) AS s, {_D4} AS q FROM articles)
SELECT article_id, b >= 180 OR q >= 6 AS item, b >= 180 OR s >= 110 AS report, b >= 220 OR s >= 120 AS perspective, (b >= 180 AND article_id % 2 = 0) OR s >= 110 AS brief FROM l""")
def d7(spark: SparkSession, d: str) -> DataFrame:
    v = lambda name: S.is_substantive(name, F.col("body_text"), F.col("summary"), F.col("quality"), F.col("article_id") % 2 != 0).alias(name)
    return articles(spark, d).select("article_id", *(v(n) for n in ("item", "report", "perspective", "brief")))


@query("d8_desk_label", """
WITH p AS (SELECT doc_id, CASE WHEN contains(text, 'thea') THEN 3 ELSE 0 END + CASE WHEN contains(text, 'with') THEN 1 ELSE 0 END AS w, CASE WHEN contains(text, 'from') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'und') THEN 2 ELSE 0 END AS p, CASE WHEN contains(text, 'ción') THEN 3 ELSE 0 END AS s FROM documents)
SELECT doc_id, CASE WHEN greatest(w, p, s) = 0 THEN 'general' WHEN w = greatest(w, p, s) THEN 'world' WHEN p = greatest(w, p, s) THEN 'politics' ELSE 'science' END AS desk FROM p""")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", S.desk_label(F.col("text"), DESKS).alias("desk"))


@query("d9_section_key", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)^the') THEN 'front' WHEN contains(text, 'ción') THEN 'south' WHEN contains(text, 'und') THEN 'north' ELSE 'other' END AS section FROM documents""")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", S.first_match(F.col("text"), [("front", "(?i)^the"), ("south", "ción"), ("north", "und")], "other").alias("section"))


@query("d10_family_scope", f"""
WITH {A.OUTLETS_SQL}, f AS (SELECT outlet, name, CASE outlet_type WHEN 'wire' THEN 'wire' WHEN 'regional' THEN 'local' WHEN 'specialist' THEN 'specialist' ELSE CASE WHEN outlet IN (1, 7, 13) THEN 'policy' ELSE 'national' END END AS family FROM outlets)
SELECT outlet, family, CASE WHEN family = 'local' THEN 'local' WHEN outlet IN (2, 3) OR regexp_matches(name, '[05]$') THEN 'international' ELSE 'national' END AS scope FROM f""")
def d10(spark: SparkSession, d: str) -> DataFrame:
    rows = A.outlets(spark, d).withColumn("family", S.source_family(F.col("outlet_type"), F.col("outlet"), [1, 7, 13]))
    return rows.select("outlet", "family", S.coverage_scope(F.col("family"), F.col("outlet"), [2, 3], F.col("name"), "[05]$").alias("scope"))


@query("d11_read_quality", f"""
WITH {A.ARTICLES_SQL} SELECT article_id, ({_D4} + CASE access_signal WHEN 'open' THEN 3 WHEN 'likely_paywalled' THEN -2 ELSE 0 END + CASE WHEN extraction_quality = 'article_body' THEN 2 ELSE 0 END)::INTEGER AS read_quality FROM articles""")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("article_id", S.read_quality(F.col("quality"), F.col("access_signal"), F.col("extraction_quality")).alias("read_quality"))


@query("d12_lead_and_open_alternate", f"""
WITH {A.MEMBERS_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY quality DESC, rank_in_story, outlet) AS k FROM members) WHERE k = 1),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.story_id ORDER BY m.quality DESC, m.rank_in_story, m.outlet) AS j FROM members m JOIN l USING (story_id) WHERE m.is_open AND m.outlet <> l.outlet)
SELECT l.story_id, l.rank_in_story AS lead, l.quality >= 6 AS confident, CASE WHEN o.quality >= 7 THEN o.rank_in_story END AS alternate FROM l LEFT JOIN o ON o.story_id = l.story_id AND o.j = 1""")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return ST.lead_and_open_alternate(A.members(spark, d))
