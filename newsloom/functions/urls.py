"""Column expressions on urls, domains and access signals; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, by prefix and by name, and those that name an article.
TRACKING_PREFIXES = ["utm_", "ga_", "mc_", "oly_"]
TRACKING_NAMES = ["fbclid", "gclid", "igshid", "ocid", "cmpid", "cmp", "ref", "ref_src", "smid", "src", "sref", "intcmp", "taid", "mbid", "share", "output"]
NAMING_PARAMETERS = ["id", "p", "story", "article", "post"]


def normalize_domain(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Host of a url or domain: lower case, without scheme, path and one leading ``www.``; then by the alias table."""
    host = F.regexp_replace(F.lower(F.trim(value)), r"^https?://|/.*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"(?s)/.*$", ""), r"^www\.", "")
    if aliases:
        host = F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[host], host)
    return F.coalesce(host, F.lit(""))


def canonical_url(value: Column, aliases: dict[str, str] | None = None, drop_prefixes: list[str] = TRACKING_PREFIXES, drop_names: list[str] = TRACKING_NAMES, keep_names: list[str] = NAMING_PARAMETERS) -> Column:
    """One spelling for a url: scheme, normalised host, clean path, and only parameters that name an article."""
    raw = F.trim(value)
    raw = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).when(F.rlike(raw, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = normalize_domain(F.regexp_extract(raw, r"://([^/?#]*)", 1), aliases)
    path = F.regexp_replace(F.regexp_extract(raw, r"://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.regexp_replace(path, r"(?i)/index(\.[a-z0-9]+)?$", "/")
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)

    def wanted(pair: Column) -> Column:
        name = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
        tracks = reduce(lambda a, b: a | b, (F.startswith(name, F.lit(p)) for p in drop_prefixes), name.isin(drop_names))
        return F.rlike(pair, F.lit("^[^=]*=.")) & ~tracks & (F.endswith(name, F.lit("id")) | name.isin(keep_names))

    kept = F.array_join(F.filter(F.split(query, "&"), wanted), "&")
    url = F.concat(scheme, F.lit("://"), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(F.coalesce(raw_blank(value), F.lit(True)), "").otherwise(url)


def raw_blank(value: Column) -> Column:
    return F.trim(value) == ""


def parent_domains(host: Column) -> Column:
    """The host and every domain above it, the host first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def title_from_url(url: Column, least: int = 8) -> Column:
    """A headline from the last segment of a path; null if it would be too short."""
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    slug = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    words = F.filter(F.split(F.regexp_replace(slug, "[-_]+", " "), " +"), lambda w: ~F.rlike(w, F.lit("^[0-9]*$")))
    text = F.array_join(words, " ")
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    return F.when(F.length(text) >= least, text)


def usable_keywords(keywords: Column, title: Column, least: int = 40) -> Column:
    """Whether a keyword list reads like a summary: long, not the title, no id marks, and not bare tags."""
    clean = F.trim(F.regexp_replace(F.coalesce(keywords, F.lit("")), r"\s+", " "))
    bare = F.rlike(clean, F.lit(r"^[^ ,]+( [^ ,]+)?(, ?[^ ,]+( [^ ,]+)?)+$"))
    return (F.length(clean) >= least) & (F.lower(clean) != F.lower(F.trim(F.coalesce(title, F.lit(""))))) & ~F.rlike(clean, F.lit(r"(?i)\b[a-z]*id[:=_][0-9]+")) & ~bare


def public_url(url: Column, seeds: str = r"(?i)://([^/]*\.)?(example\.invalid|localhost)([/:]|$)") -> Column:
    """The url without trailing punctuation if it is http(s), has a host with a dot and is no seed; else null."""
    clean = F.regexp_replace(F.trim(url), r"[.,;:!?)\]]+$", "")
    return F.when(F.rlike(clean, F.lit(r"(?i)^https?://[^/\s?#]+\.[^/\s?#]+")) & ~F.rlike(clean, F.lit(seeds)), clean)


def fetch_block(html: Column, status: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """struct(reason, vendor): the first challenge pattern (pattern, reason, vendor) found, else by HTTP status, else nulls."""
    out = F.when(status.isin(401, 403), F.struct(F.lit("http_denied").alias("reason"), F.lit(None).cast("string").alias("vendor"))).when(
        status == 429, F.struct(F.lit("http_throttled").alias("reason"), F.lit(None).cast("string").alias("vendor"))
    )
    for pattern, reason, vendor in reversed(patterns):
        out = F.when(F.rlike(html, F.lit(pattern)), F.struct(F.lit(reason).alias("reason"), F.lit(vendor).alias("vendor"))).otherwise(out)
    return out
