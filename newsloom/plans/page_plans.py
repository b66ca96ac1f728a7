"""Queries on discovered urls and page markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import outlets as O
from newsloom.operators import tables as T
from newsloom.plans import adapters as A
from newsloom.plans.catalog import query

ALIASES = {"ththst.example.org": "thth.example.org", "tionsh.example.net": "tion.example.net"}
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^https?://', ''), '/.*$', '', 's'), '^www\.', '')"
_ALIASED = "CASE {0} WHEN 'ththst.example.org' THEN 'thth.example.org' WHEN 'tionsh.example.net' THEN 'tion.example.net' ELSE {0} END"
_RAW = r"regexp_extract(url, '://([^/?#]*)', 1)"
_NET = _HOST.format(_RAW)
CANONICAL_SQL = rf"""canon AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, {_ALIASED.format(_NET)} AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '(?i)/index(\.[a-z0-9]+)?$', '/'), '/+$', '') AS p,
         array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: regexp_matches(x, '^[^=]*=.') AND NOT regexp_matches(lower(x), '^(utm_|ga_|mc_|oly_)')
             AND NOT list_contains(['fbclid','gclid','igshid','ocid','cmpid','cmp','ref','ref_src','smid','src','sref','intcmp','taid','mbid','share','output'], lower(string_split(x, '=')[1]))
             AND (ends_with(lower(string_split(x, '=')[1]), 'id') OR list_contains(['id','p','story','article','post'], lower(string_split(x, '=')[1])))), '&') AS q
  FROM pages
), urls AS (SELECT page_id, url, html, host, scheme || '://' || host || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM canon)"""


def canonical_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = A.table(spark, d, "pages")
    host = U.normalize_domain(F.regexp_extract("url", "://([^/?#]*)", 1), ALIASES)
    return pages.select("page_id", "url", host.alias("host"), U.canonical_url(F.col("url"), ALIASES).alias("canonical"))


@query("b1_normalize_domain", f"WITH {CANONICAL_SQL} SELECT page_id, host FROM urls")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return canonical_pages(spark, d).select("page_id", "host")


@query("b2_canonical_url", f"WITH {CANONICAL_SQL} SELECT page_id, canonical FROM urls")
def b2(spark: SparkSession, d: str) -> DataFrame:
    return canonical_pages(spark, d).select("page_id", "canonical")


_PATHLESS = r"regexp_replace(canonical, '/[0-9]+.*$', '')"


@query("b3_dedupe_by_url", f"WITH {CANONICAL_SQL} SELECT {_PATHLESS} AS section, max(page_id) AS page_id, max_by(url, page_id) AS url FROM urls GROUP BY 1")
def b3(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical_pages(spark, d).select(F.regexp_replace("canonical", "/[0-9]+.*$", "").alias("section"), "page_id", "url")
    return T.last_by_key(rows, "section", "page_id")


_TIER = """CASE WHEN page_id % 5 = 0 THEN 'open' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'open'
  WHEN host = 'tion.example.com' OR ends_with(host, '.tion.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') THEN 'likely_paywalled' ELSE 'unknown' END"""


def _tier() -> F.Column:
    signal = F.when(F.col("page_id") % 5 == 0, "open").otherwise("unknown")
    return O.access_tier(signal, F.col("host"), ["example.net"], ["tion.example.com", "example.org"])


@query("b4_access_tier", f"WITH {CANONICAL_SQL} SELECT page_id, {_TIER} AS access_tier FROM urls")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return canonical_pages(spark, d).select("page_id", _tier().alias("access_tier"))


BLOCKS = [("(?i)captcha|track\\([0-9]*7\\)", "challenge", "shield"), ("(?i)class=\"ad\">D", "interstitial", "wall")]


@query("b5_fetch_block", """
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)captcha|track\\([0-9]*7\\)') THEN 'challenge' WHEN regexp_matches(html, '(?i)class="ad">D') THEN 'interstitial' WHEN page_id % 11 = 0 THEN 'http_denied' WHEN page_id % 11 = 1 THEN 'http_throttled' END AS reason,
       CASE WHEN regexp_matches(html, '(?i)captcha|track\\([0-9]*7\\)') THEN 'shield' WHEN regexp_matches(html, '(?i)class="ad">D') THEN 'wall' END AS vendor FROM pages""".replace("\\\\", "\\"))
def b5(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("page_id") % 11 == 0, 403).when(F.col("page_id") % 11 == 1, 429).otherwise(200)
    return A.table(spark, d, "pages").withColumn("b", U.fetch_block(F.col("html"), status, BLOCKS)).select("page_id", "b.reason", "b.vendor")


@query("b8_sitemap_rules", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '\.([a-z]+)(?:[/?#]|$)', 1) AS zone, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
SELECT page_id FROM p WHERE (zone <> 'net' OR (regexp_matches(url, '(?i)/(en|de)/') AND NOT regexp_matches(url, '(?i)utm_'))) AND (zone <> 'org' OR NOT regexp_matches(title, '(?i)^the|^a'))""")
def b8(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"://[^/?#]*\.([a-z]+)(?:[/?#]|$)", 1).alias("zone"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    rules = spark.createDataFrame([("net", "allow_url", "/(en|de)/"), ("net", "deny_url", "utm_"), ("org", "deny_title", "^the|^a")], "zone string, kind string, pattern string")
    return O.sitemap_rules(rows, rules, "page_id", "zone", F.col("url"), F.col("title")).select("page_id")


_WORDS_OF_URL = r"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '\.[A-Za-z0-9]+$', ''), '^.*://[^/]*', ''), '([^/]*)$', 1), '[-_]+', ' ', 'g'), ' +'), lambda x: NOT regexp_matches(x, '^[0-9]*$')), ' ')"
#: title_from_url of a column named url.
TITLE_FROM_URL_SQL = f"CASE WHEN length({_WORDS_OF_URL}) >= 8 THEN upper(substr({_WORDS_OF_URL}, 1, 1)) || substr({_WORDS_OF_URL}, 2) END"


@query("b9_title_from_url", r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '\.[A-Za-z0-9]+$', ''), '^.*://[^/]*', '') || '/the-' || regexp_extract(html, '<title>([A-Za-z]*) ', 1) || '-12_report' AS u FROM pages),
w AS (SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '[-_]+', ' ', 'g'), ' +'), lambda x: NOT regexp_matches(x, '^[0-9]*$')), ' ') AS t FROM s)
SELECT page_id, CASE WHEN length(t) >= 8 THEN upper(substr(t, 1, 1)) || substr(t, 2) END AS title FROM w""")
def b9(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    url = F.concat(bare, F.lit("/the-"), F.regexp_extract("html", "<title>([A-Za-z]*) ", 1), F.lit("-12_report/"))
    return rows.select("page_id", U.title_from_url(url).alias("title"))


@query("b10_usable_keywords", r"""
WITH k AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, CASE WHEN page_id % 3 = 0 THEN replace(regexp_extract(html, '<title>([^<]*)', 1), ' ', ', ') ELSE regexp_extract(html, '<title>([^<]*)', 1) || ' and more about it' END AS k FROM pages),
c AS (SELECT page_id, title, trim(regexp_replace(k, '\s+', ' ', 'g')) AS c FROM k)
SELECT page_id, length(c) >= 40 AND lower(c) <> lower(trim(title)) AND NOT regexp_matches(c, '(?i)\b[a-z]*id[:=_][0-9]+') AND NOT regexp_matches(c, '^[^ ,]+( [^ ,]+)?(, ?[^ ,]+( [^ ,]+)?)+$') AS usable FROM c""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    words = F.when(F.col("page_id") % 3 == 0, F.replace(title, F.lit(" "), F.lit(", "))).otherwise(F.concat(title, F.lit(" and more about it")))
    return A.table(spark, d, "pages").select("page_id", U.usable_keywords(words, title).alias("usable"))


@query("b11_link_integrity", r"""
WITH l AS (SELECT CASE page_id % 4 WHEN 0 THEN url || ').' WHEN 1 THEN url WHEN 2 THEN 'ftp://' || url ELSE 'http://localhost/x' END AS link, regexp_extract(url, '://[^/]*\.([a-z]+)/', 1) AS zone FROM pages),
v AS (SELECT zone, regexp_replace(trim(link), '[.,;:!?)\]]+$', '') AS c FROM l)
SELECT zone, count(*) AS links, count(*) FILTER (regexp_matches(c, '(?i)^https?://[^/\s?#]+\.[^/\s?#]+') AND NOT regexp_matches(c, '(?i)://([^/]*\.)?(example\.invalid|localhost)([/:]|$)')) AS valid FROM v GROUP BY zone""")
def b11(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("page_id") % 4
    link = F.when(kind == 0, F.concat("url", F.lit(")."))).when(kind == 1, F.col("url")).when(kind == 2, F.concat(F.lit("ftp://"), "url")).otherwise("http://localhost/x")
    rows = A.table(spark, d, "pages").select(F.regexp_extract("url", r"://[^/]*\.([a-z]+)/", 1).alias("zone"), U.public_url(link).alias("public"))
    return rows.groupBy("zone").agg(F.count("*").alias("links"), F.count("public").alias("valid"))


@query("flagship_outlet_headlines", f"""
WITH {CANONICAL_SQL}, one AS (SELECT canonical, max(page_id) AS page_id, max_by(host, page_id) AS host, max_by(regexp_extract(html, '<title>([^<]*)', 1), page_id) AS title FROM urls GROUP BY canonical),
t AS (SELECT *, {_TIER} AS tier FROM one)
SELECT host, count(*) AS articles, count(*) FILTER (tier = 'open') AS open_articles, arg_max(title, (length(title), page_id)) AS best_headline FROM t GROUP BY host""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Distinct articles, open ones and the longest headline of each outlet domain."""
    pages = A.table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    rows = pages.select("page_id", "title", U.normalize_domain(F.regexp_extract("url", "://([^/?#]*)", 1), ALIASES).alias("host"), U.canonical_url(F.col("url"), ALIASES).alias("canonical"))
    one = T.last_by_key(rows, "canonical", "page_id").withColumn("tier", _tier())
    return one.groupBy("host").agg(
        F.count("*").alias("articles"), F.count_if(F.col("tier") == "open").alias("open_articles"),
        F.max_by("title", F.struct(F.length("title"), "page_id")).alias("best_headline"),
    )


@query("c2_meta_content", r"""
SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+(?:name|property)=["'']og:title["''][^>]*content=["'']([^"'']*)', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+charset=["'']([^"'']*)', 1), '')) AS content,
       nullif(regexp_extract(html, '(?i)<a[^>]+href=["'']([^"'']*)', 1), '') AS first_link FROM pages""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.functions.markup import first_attribute, meta_content

    return A.table(spark, d, "pages").select("page_id", F.coalesce(meta_content(F.col("html"), ["og:title"]), first_attribute(F.col("html"), "meta", "charset")).alias("content"), first_attribute(F.col("html"), "a", "href").alias("first_link"))


@query("c17_parse_published_at", """
SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE epoch(make_timestamp(2024, 1, 1, 0, 0, 0) + to_minutes(page_id) - CASE page_id % 4 WHEN 1 THEN to_hours(2) ELSE to_hours(0) END)::BIGINT END AS second FROM pages""")
def c17(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds(F.expr("timestamp'2024-01-01 00:00:00Z'")) + 60 * F.col("page_id"))
    form = F.when(F.col("page_id") % 4 == 0, F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("page_id") % 4 == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(F.col("page_id") % 4 == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("last Tuesday")
    return A.table(spark, d, "pages").select("page_id", F.unix_seconds(X.parse_published_at(form)).alias("second"))
