"""Queries on text: markup to text, fragments, sentences and narrative sentences, each with SQL of its whole rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import pages as PG
from newsloom.functions import prose as R
from newsloom.plans import adapters as A
from newsloom.plans import article_plans as P
from newsloom.plans.catalog import query


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _flat(column: str) -> str:
    return f"trim(regexp_replace({column}, {_text(R.BLANKS)}, ' ', 'g'), ' ')"


def _characters() -> str:
    """A CTE with the map of references to characters."""
    known = R.references()
    return f"ch AS (SELECT map([{', '.join(map(_text, known))}], [{', '.join(map(_text, known.values()))}]) AS m)"


_NUMBER = """CASE WHEN length(g) > 7 THEN 16777216 WHEN g = '' THEN 0 WHEN hexadecimal THEN ('0x' || g)::BIGINT ELSE g::BIGINT END"""


@query("c1_strip_html", f"""
WITH {_characters()}, t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, string_split_regex(t, {_text(R.REFERENCE)}) AS between, regexp_extract_all(t, {_text(R.REFERENCE)}) AS found FROM t),
d AS (SELECT DISTINCT unnest(found) AS x FROM u), o AS (SELECT x, regexp_extract(x, {_text(R.UNCLOSED)}) AS old, x[3] IN ('x', 'X') AS hexadecimal, regexp_replace(regexp_replace(x, '^&#[xX]?0*', ''), ';$', '') AS g FROM d),
n AS (SELECT *, CASE WHEN x[2] = '#' THEN {_NUMBER} END AS n FROM o),
c AS (SELECT x, CASE WHEN n BETWEEN 128 AND 159 THEN m['#' || n] WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '{R.REPLACED}'
  WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' WHEN n IS NOT NULL THEN chr(n::INTEGER)
  WHEN m[x] IS NOT NULL THEN m[x] WHEN old <> '' THEN m[old] || substr(x, length(old) + 1) ELSE x END AS c FROM n, ch),
e AS (SELECT coalesce(map(list(x), list(c)), map([''], [''])) AS m FROM c)
SELECT page_id, {_flat("array_to_string(list_transform(list_zip(between, found), lambda z: z[1] || coalesce(m[z[2]], '')), '')")} AS text FROM u, e""")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", R.plain_text(F.col("html")).alias("text"))


def _once(column: str) -> str:
    for f in PG.RULES.fragments:
        column = f"regexp_replace({column}, {_text(f)}, ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({column}, {_text(R.BLANKS)}, ' ', 'g'), ' +([.,;:!?])', '\\1', 'g'), ' ')"


@query("c6_sanitize_text", f"""
WITH RECURSIVE s(doc_id, was, t) AS (SELECT doc_id, NULL::VARCHAR, coalesce(text, '') FROM documents UNION ALL SELECT doc_id, t, {_once('t')} FROM s WHERE t IS DISTINCT FROM was)
SELECT doc_id, t AS text FROM s WHERE t = was""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", R.sanitized(F.col("text"), PG.RULES.fragments).alias("text"))


_count = lambda c: f"(length(p) - length(replace(p, '{c}', '')))"
_SENTENCES = f"""pl AS (SELECT doc_id, string_split(regexp_replace({_flat("coalesce(text, '')")}, {_text(R.CUT)}, '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS l FROM documents),
pp AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS p, unnest(list_prepend('', l)[:len(l)]) AS b FROM pl),
mk AS (SELECT doc_id, i, p, {_count('"')} % 2 = 1 AS odd, {_count('“')} - {_count('”')} AS open, regexp_matches(b, {_text(R.SHORT)}) OR (regexp_matches(b, {_text(R.QUOTED)}) AND regexp_matches(p, {_text(R.ATTRIBUTION)})) AS bound FROM pp),
st(doc_id, i, odd, open, k) AS (SELECT doc_id, i, odd, open, 1 FROM mk WHERE i = 1 UNION ALL
  SELECT doc_id, m.i, CASE WHEN m.bound OR s.odd OR s.open > 0 THEN m.odd <> s.odd ELSE m.odd END, CASE WHEN m.bound OR s.odd OR s.open > 0 THEN m.open + s.open ELSE m.open END, CASE WHEN m.bound OR s.odd OR s.open > 0 THEN k ELSE k + 1 END
  FROM st s JOIN mk m USING (doc_id) WHERE m.i = s.i + 1),
se AS (SELECT doc_id, k, string_agg(p, ' ' ORDER BY i) AS s FROM st JOIN mk USING (doc_id, i) GROUP BY doc_id, k HAVING string_agg(p, ' ' ORDER BY i) <> '')"""


@query("c9_split_sentences", f"WITH RECURSIVE {_SENTENCES} SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY k), '') AS sentences FROM documents LEFT JOIN se USING (doc_id) GROUP BY doc_id")
def c9(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.array_join(R.sentences(F.col("text")), "\n").alias("sentences"))


_NEAR = "len(list_intersect(x.t, {k}.t))::DOUBLE / {over}(len(x.t), len({k}.t)) >= {least}"
_REPEATS = f"(x.s = y.s OR (least(len(x.t), len(y.t)) > 0 AND ({_NEAR.format(k='y', over='greatest', least=0.72)} OR {_NEAR.format(k='y', over='least', least=0.66)})))"


@query("c10_narrative_sentences", f"""
WITH RECURSIVE {_SENTENCES}, go AS (SELECT doc_id, s, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]{{4,}}')) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM se WHERE NOT {P.non_narrative_sql('s')} AND NOT {P._clipped('s')}),
rp AS (SELECT doc_id, x.k, list(y.k) AS like_it FROM go x JOIN go y USING (doc_id) WHERE y.k < x.k AND {_REPEATS} GROUP BY 1, 2),
gr AS (SELECT doc_id, k, coalesce(like_it, []) AS like_it FROM go LEFT JOIN rp USING (doc_id, k)),
kp(doc_id, k, kept) AS (SELECT doc_id, k, [k] FROM gr WHERE k = 1 UNION ALL SELECT doc_id, g.k, CASE WHEN len(list_intersect(like_it, kept)) > 0 THEN kept ELSE list_append(kept, g.k) END FROM kp JOIN gr g USING (doc_id) WHERE g.k = kp.k + 1),
la AS (SELECT doc_id, arg_max(kept, k) AS kept FROM kp GROUP BY doc_id), ks AS (SELECT doc_id, go.k, s FROM go JOIN la USING (doc_id) WHERE list_contains(kept, go.k))
SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY k), '') AS sentences FROM documents LEFT JOIN ks USING (doc_id) GROUP BY doc_id""")
def c10(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.array_join(R.narrative_sentences(F.col("text")), "\n").alias("sentences"))
