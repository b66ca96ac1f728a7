"""The enrichment job: which articles to fetch, and what to keep of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.stories import lead_and_open_alternate, story_summary

QUALITY_ORDER = {"rss_only": 0, "metadata_description": 1, "article_body": 2}


def grade(quality):
    return F.create_map(*(F.lit(x) for kv in QUALITY_ORDER.items() for x in kv))[quality]


def latest_discovery(articles: DataFrame, discoveries: DataFrame) -> DataFrame:
    """articles (article_id, canonical_url, original_url) with discovery_id: the newest row under either url, the canonical one first.

    discoveries: discovery_id, canonical_url, discovered_url, second."""
    forms = discoveries.select("discovery_id", "second", F.explode(F.array_distinct(F.array("canonical_url", "discovered_url"))).alias("url")).where("url IS NOT NULL")
    newest = forms.groupBy("url").agg(F.max_by("discovery_id", F.struct("second", "discovery_id")).alias("d"))
    found = articles.join(newest.select(F.col("url").alias("canonical_url"), F.col("d").alias("by_canonical")), "canonical_url", "left")
    found = found.join(newest.select(F.col("url").alias("original_url"), F.col("d").alias("by_original")), "original_url", "left")
    return found.select("article_id", F.coalesce("by_canonical", "by_original").alias("discovery_id"))


def needs_enrichment(articles: DataFrame, as_of: int, cooldown: int = 1800) -> DataFrame:
    """Articles worth a fetch: a url, no sound body yet, not fetched with body, and no failure in the last ``cooldown`` seconds.

    articles: url, extraction_quality, mismatch, fetch_status, attempted (second or null)."""
    body = F.col("extraction_quality") == "article_body"
    resting = (F.col("fetch_status") == "failed") & (F.coalesce("attempted", F.lit(0)) > as_of - cooldown)
    return articles.where((F.coalesce("url", F.lit("")) != "") & ~(body & ~F.col("mismatch")) & ~((F.col("fetch_status") == "fetched") & body) & ~resting)


def enrichment_queue(candidates: DataFrame, limit: int = 24) -> DataFrame:
    """The first ``limit`` candidates: of active, one-source, thin stories first, then paywalled, bodiless, thin, by status and time."""
    status = F.create_map(*(F.lit(x) for x in ("pending", 0, "normalized", 1, "failed", 2, "fetched", 3)))[F.col("fetch_status")]
    order = [F.desc("story_active"), F.desc("one_source"), F.desc("thin_story"), F.desc("paywalled"), F.desc("needs_body"), F.desc("thin_summary"), F.asc(status), F.asc("queued"), F.desc("published"), F.asc("article_id")]
    return candidates.orderBy(*order).limit(limit)


def body_mismatch(alignment, residue, has_body, least: float = 0.16):
    """Whether a stored body does not belong to its headline."""
    return has_body & (residue | (alignment < least))


def merge_enrichment(articles: DataFrame, enrichment: DataFrame, attempted_at: int) -> DataFrame:
    """articles patched by enrichment (article_id, new_summary, new_body, new_quality, new_image, mismatch, error).

    A mismatch falls back to the feed summary without body, and is flagged; an error leaves the article and marks it failed; what was enriched bears the time of the attempt."""
    j = articles.join(enrichment, "article_id", "left")
    failed, reset, have = F.col("error").isNotNull(), F.coalesce("mismatch", F.lit(False)), F.col("new_quality").isNotNull()
    keep = failed | ~have
    return j.select(
        "article_id",
        F.when(keep, F.col("summary")).when(reset, F.col("feed_summary")).otherwise(F.coalesce("new_summary", "summary")).alias("summary"),
        F.when(keep, F.col("body_text")).when(reset, F.lit(None)).otherwise(F.coalesce("new_body", "body_text")).alias("body_text"),
        F.when(keep, F.col("extraction_quality")).when(reset, "rss_only").otherwise(F.col("new_quality")).alias("extraction_quality"),
        F.when(failed, "failed").when(~have, "pending").when(reset | (F.col("new_quality") != "article_body"), "normalized").otherwise("fetched").alias("fetch_status"),
        "error",
        F.when(keep | reset, F.col("image")).otherwise(F.coalesce("new_image", "image")).alias("image"), (~keep & reset).alias("body_mismatch"), F.when(~keep, F.lit(attempted_at)).alias("enriched_at"),
    )


def keep_better_enrichment(stored: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """incoming rows, but with the stored values of ``kept`` where the stored grade is higher."""
    old = stored.select(key, *(F.col(c).alias(f"_old_{c}") for c in [*kept, "extraction_quality"]))
    j = incoming.join(old, key, "left")
    better = F.coalesce(grade(F.col("_old_extraction_quality")) > grade(F.col("extraction_quality")), F.lit(False))
    change = {c: F.when(better, F.col(f"_old_{c}")).otherwise(F.col(c)) for c in [*kept, "extraction_quality"]}
    return j.select(*(change[c].alias(c) if c in change else F.col(c) for c in incoming.columns))


def refresh_story(touched: DataFrame, members: DataFrame, titles: DataFrame, product: str) -> DataFrame:
    """Per touched story the summary of F8, its outlets, whether it may lead the page, and the reading options of D12, all from its members as they now are.

    members: as for story_summary, with rank_in_story, is_open and read_quality."""
    m = members.join(touched.select("story_id").distinct(), "story_id", "left_semi")
    summary = story_summary(m, titles, product)
    options = lead_and_open_alternate(m.select("story_id", "rank_in_story", "outlet", "is_open", F.col("read_quality").alias("quality")))
    counts = m.groupBy("story_id").agg(F.countDistinct("outlet").alias("outlets"))
    out = summary.join(counts, "story_id").join(options, "story_id", "left")
    return out.withColumn("eligible", (F.col("outlets") >= 2) & ((F.col("n_sources") >= 2) | (F.col("score") >= 8)))
