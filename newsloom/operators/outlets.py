"""Joins of articles to outlets, feeds, rights and access lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import parent_domains

FEED_TYPES = ["rss", "atom", "news_sitemap", "sitemap"]


def active_feeds(feeds: DataFrame, registry: DataFrame) -> DataFrame:
    """Feeds to poll: feed and source active, source in service or onboarding, and a type we can read."""
    usable = registry.where(F.col("is_active") & F.col("ingestion_status").isin("active", "onboarding")).select("source_id")
    return feeds.where(F.col("is_active") & F.col("feed_type").isin(FEED_TYPES)).join(usable, "source_id")


def map_outlets(articles: DataFrame, outlets: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(articles with outlet columns, counts of keys that no outlet claims)."""
    mapped = articles.join(outlets, key, "left")
    return mapped, articles.join(outlets.select(key), key, "left_anti").groupBy(key).count()


def coverage_counts(members: DataFrame, story: str = "story_id", outlet: str = "outlet", framing: str = "framing_group") -> DataFrame:
    """Distinct outlets per story and framing; a framing other than left and right counts as center."""
    group = F.when(F.col(framing).isin("left", "right"), F.col(framing)).otherwise("center")
    folded = members.select(story, outlet, group.alias("g")).distinct()
    return folded.groupBy(story).agg(*(F.count_if(F.col("g") == g).alias(g) for g in ("left", "center", "right")))


def access_tier(signal: Column, host: Column, open_hosts: list[str], paid_hosts: list[str]) -> Column:
    """A stored signal if it decides, else the lists, by the host or a domain above it, else unknown."""
    above = parent_domains(host)
    return (
        F.when(signal.isin("open", "likely_paywalled"), signal)
        .when(F.arrays_overlap(above, F.array(*map(F.lit, open_hosts))), "open")
        .when(F.arrays_overlap(above, F.array(*map(F.lit, paid_hosts))), "likely_paywalled")
        .otherwise("unknown")
    )


def sitemap_rules(items: DataFrame, rules: DataFrame, key: str, source: str, url: Column, title: Column) -> DataFrame:
    """Items that their source's rules let through; rules has source, kind (allow_url, deny_url, deny_title) and pattern.

    A source without rules keeps all; with allow rules one must match, and no deny rule may. Patterns ignore case.
    """
    checked = items.withColumn("_url", url).withColumn("_title", title).join(rules, source, "left")
    hit = F.expr(
        "CASE WHEN kind = 'deny_title' THEN rlike(_title, concat('(?i)', pattern)) WHEN kind IS NOT NULL THEN rlike(_url, concat('(?i)', pattern)) END"
    )
    verdict = checked.groupBy(key).agg(
        F.count_if(F.col("kind") == "allow_url").alias("allows"),
        F.count_if((F.col("kind") == "allow_url") & hit).alias("allowed"),
        F.count_if(F.col("kind").startswith("deny") & hit).alias("denied"),
    )
    kept = verdict.where("denied = 0 AND (allows = 0 OR allowed > 0)").select(key)
    return items.join(kept, key, "left_semi")


def rights_class(articles: DataFrame, policies: DataFrame, key: str, strictest: str = "no_reuse") -> DataFrame:
    """articles with rights_class from the source's policy; no policy gets the strictest."""
    joined = articles.join(policies.select(key, "rights_class_default"), key, "left")
    return joined.withColumn("rights_class", F.coalesce("rights_class_default", F.lit(strictest))).drop("rights_class_default")
